"""SQL texts of the sketches, as another engine computes them from the same portable hashes."""

from __future__ import annotations

import math

from rillmark.operators.cardinality import bias


def _list(keys: str, prefix: str = "") -> str:
    return "".join(f"{prefix}{k.strip()}, " for k in keys.split(",") if k.strip())


def hash_of(item: str) -> str:
    return f"('0x' || substr(md5(CAST({item} AS VARCHAR)), 1, 16))::UBIGINT"


def hll_registers(source: str, item: str, p: int, keys: str = "", hashed: bool = False) -> str:
    h = f"({item})" if hashed else hash_of(item)
    return f"""SELECT {_list(keys)}(h >> {64 - p})::INTEGER AS idx,
      max(CASE WHEN h & {2 ** (64 - p) - 1}::UBIGINT = 0 THEN {65 - p} ELSE {65 - p} - length(bin(h & {2 ** (64 - p) - 1}::UBIGINT)) END)::INTEGER AS rho, count(*)::BIGINT AS n
      FROM (SELECT {_list(keys)}{h} AS h FROM {source} WHERE {item} IS NOT NULL) GROUP BY {_list(keys)}idx"""


def hll_estimate(registers: str, p: int, keys: str = "", extra: str = "") -> str:
    m = float(2**p)
    group = f"GROUP BY {_list(keys)[:-2]}" if keys else ""
    return f"""SELECT {_list(keys)}CASE WHEN k = 0 THEN 0e0 WHEN raw <= {2.5 * m}e0 AND z > 0 AND {m}e0 * ln({m}e0 / z) <= {2.5 * m}e0 THEN {m}e0 * ln({m}e0 / z) ELSE raw END AS estimate, n AS n_inserts{extra}
      FROM (SELECT {_list(keys)}count(*) AS k, {m}e0 - count(*) AS z, {bias(2**p) * m * m!r}::DOUBLE / (coalesce(sum(pow(2e0, -rho)), 0e0) + {m}e0 - count(*)) AS raw, coalesce(sum(n), 0)::BIGINT AS n FROM ({registers}) {group})"""


def place(row: str, item: str, width: int) -> str:
    return f"('0x' || substr(md5(CAST({row} AS VARCHAR) || ':' || CAST({item} AS VARCHAR)), 1, 15))::BIGINT % {width}"


def cms_cells(source: str, item: str, width: int, depth: int, weight: str = "1", keys: str = "") -> str:
    return f"""SELECT {_list(keys)}r::INTEGER AS row, {place("r", item, width)} AS col, sum({weight})::BIGINT AS cnt, count(*)::BIGINT AS n
      FROM {source}, range({depth}) t(r) WHERE {item} IS NOT NULL GROUP BY {_list(keys)}r, {place("r", item, width)}"""


def cms_estimate(cells: str, probes: str, item: str, width: int, depth: int) -> str:
    """probes: a select of distinct items named ``item``."""
    return f"""SELECT p.{item}, min(coalesce(c.cnt, 0))::BIGINT AS estimate FROM (SELECT {item}, r::INTEGER AS row, {place("r", item, width)} AS col FROM ({probes}), range({depth}) t(r)) p
      LEFT JOIN ({cells}) c ON c.row = p.row AND c.col = p.col GROUP BY p.{item}"""


def bloom_bits(source: str, item: str, bits: int, hashes: int) -> str:
    return f"SELECT DISTINCT {place('r', item, bits)} AS b FROM {source}, range({hashes}) t(r) WHERE {item} IS NOT NULL"


def digest(source: str, key: str, value: str, compression: float) -> str:
    """Common table expressions v (values in order) and c (k, pos, mean, w, n, lo, hi): the digest of each key.

    Of single values in order, a centroid that begins after ``start`` values ends where the scale has gone up by 1."""
    c, pi = f"{compression}e0", repr(math.pi)
    return f"""v AS (SELECT {key} AS k, {value} AS x, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS i FROM {source} WHERE {value} IS NOT NULL AND NOT isnan({value})),
    e AS (SELECT k, count(*) AS n, min(x) AS lo, max(x) AS hi FROM v GROUP BY k),
    f AS (
      SELECT k, n, -1 AS pos, 0::BIGINT AS start, 0::BIGINT AS stop FROM e
      UNION ALL
      SELECT k, n, pos + 1, stop, CASE WHEN (asin(greatest(least(2e0 * stop / n - 1, 1e0), -1e0)) / {pi} + 0.5e0) * {c} + 1 >= {c} THEN n
        ELSE greatest(stop + 1, floor(n * (sin({pi} * ((asin(greatest(least(2e0 * stop / n - 1, 1e0), -1e0)) / {pi} + 0.5e0) + 1 / {c} - 0.5e0)) + 1) / 2)::BIGINT) END
      FROM f WHERE stop < n
    ),
    c AS (SELECT f.k, f.pos, avg(v.x) AS mean, (f.stop - f.start) AS w, e.n, e.lo, e.hi FROM f JOIN v ON v.k = f.k AND v.i > f.start AND v.i <= f.stop JOIN e ON e.k = f.k WHERE f.pos >= 0 GROUP BY ALL),
    m AS (SELECT k, n, lo, hi, pos, mean, sum(w) OVER (PARTITION BY k ORDER BY pos) - w / 2e0 AS r FROM c),
    g AS (
      SELECT k, n, lo, hi, coalesce(lag(r) OVER o, 0e0) AS r0, coalesce(lag(mean) OVER o, lo) AS v0, r AS r1, mean AS v1, FALSE AS last FROM m WINDOW o AS (PARTITION BY k ORDER BY pos)
      UNION ALL SELECT k, n, lo, hi, arg_max(r, pos), arg_max(mean, pos), n::DOUBLE, hi, TRUE FROM m GROUP BY k, n, lo, hi
    )"""


QUANTILE = "min(CASE WHEN q <= 0 THEN lo WHEN q >= 1 THEN hi WHEN r1 - r0 <= 0 THEN CASE WHEN last THEN hi ELSE v0 END ELSE v0 + (q * n - r0) / (r1 - r0) * (v1 - v0) END)"
QUANTILE_LINES = "r0 <= least(greatest(q, 0e0), 1e0) * n AND (last OR least(greatest(q, 0e0), 1e0) * n < r1)"
