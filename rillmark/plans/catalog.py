"""The query catalogue over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.bounds import contains, relative_width, width
from rillmark.operators import cardinality, heavy_hitters, quantiles, setops
from rillmark.operators.cardinality import HyperLogLog
from rillmark.operators.frequency import CountMin
from rillmark.operators.heavy_hitters import SpaceSaving
from rillmark.operators.membership import BloomFilter
from rillmark.operators.moments import Moments
from rillmark.operators.quantiles import TDigest
from rillmark.operators.sampling import DEFAULT_SEED, Reservoir
from rillmark.plans import sql
from rillmark.sources.store import scratch_root
from rillmark.streaming import windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- running statistics -----------------------------------------------------------------------------------------

STATS = ["mean", "variance", "sample_variance", "stddev", "sample_stddev", "min", "max", "range", "sum"]


def _stats_sql(key: str, source: str, value: str) -> str:
    v = f"CASE WHEN NOT isnan({value}) THEN {value} END"
    return f"""SELECT {key}, count({v})::BIGINT AS n, round(coalesce(avg({v}), 0), 6) AS mean, round(coalesce(var_pop({v}), 0), 6) AS variance,
      round(coalesce(var_samp({v}), 0), 6) AS sample_variance, round(coalesce(stddev_pop({v}), 0), 6) AS stddev, round(coalesce(stddev_samp({v}), 0), 6) AS sample_stddev,
      round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(max({v}) - min({v}), 6) AS range, round(coalesce(sum({v}), 0), 6) AS sum FROM {source} GROUP BY {key}"""


@query(_stats_sql("event_type", "events", "value"))
def stats_all_by_event_type(spark, d):
    return Moments.build(t(spark, d, "events"), "value", by="event_type").stats().select("event_type", "n", *r6(*STATS))


@query(_stats_sql("o_orderpriority", "orders", "o_totalprice").replace("round(coalesce(sum", "round(coalesce(sum").replace(", 6) AS sum", ", 2) AS sum").replace(", 6) AS variance", ", 2) AS variance").replace(", 6) AS sample_variance", ", 2) AS sample_variance"))
def stats_merge_by_segment(spark, d):
    months = Moments.build(t(spark, d, "orders").withColumn("month", F.month("o_orderdate")), "o_totalprice", by=["o_orderpriority", "month"])
    out = months.roll_up("o_orderpriority").stats()
    coarse = {"sum", "variance", "sample_variance"}
    return out.select("o_orderpriority", "n", *[F.round(c, 2 if c in coarse else 6).alias(c) for c in STATS])


@query(_stats_sql("event_type", "(SELECT event_type, value FROM events WHERE event_id = (SELECT min(event_id) FROM events) UNION ALL SELECT DISTINCT event_type || '-none', CAST(NULL AS DOUBLE) FROM events)", "value"))
def stats_empty_and_singleton(spark, d):
    e = t(spark, d, "events")
    one = e.join(F.broadcast(e.agg(F.min("event_id").alias("event_id"))), "event_id").select("event_type", "value")  # one row
    none = e.select(F.concat("event_type", F.lit("-none")).alias("event_type"), F.lit(None).cast("double").alias("value")).distinct()
    return Moments.build(one.union(none), "value", by="event_type").stats().select("event_type", "n", *r6(*STATS))


@query(_stats_sql("event_type", "(SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM events)", "value"))
def stats_nan_ignored(spark, d):
    e = t(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value")))
    return Moments.build(e, "value", by="event_type").stats().select("event_type", "n", *r6(*STATS))


# --- distinct counts --------------------------------------------------------------------------------------------


@query(sql.hll_registers("events", "user_id", 12))
def hll_registers(spark, d):
    return HyperLogLog.build(t(spark, d, "events"), "user_id", 12).table


@query(f"SELECT round(estimate, 6) AS estimate, n_inserts FROM ({sql.hll_estimate(sql.hll_registers('events', 'user_id', 12), 12)})")
def hll_estimate(spark, d):
    return HyperLogLog.build(t(spark, d, "events"), "user_id", 12).estimate().select(*r6("estimate"), "n_inserts")


@query(f"SELECT l_returnflag, round(estimate, 6) AS estimate, n_inserts FROM ({sql.hll_estimate(sql.hll_registers('lineitem', 'l_partkey', 12, 'l_returnflag'), 12, 'l_returnflag')})")
def hll_by_key(spark, d):
    return HyperLogLog.build(t(spark, d, "lineitem"), "l_partkey", 12, by="l_returnflag").estimate().select("l_returnflag", *r6("estimate"), "n_inserts")


def _bounds_sql(inner: str, keys: str, p: int, confidence: float, z: float) -> str:
    margin = f"estimate * {z}e0 * {cardinality.error_for_precision(p)!r}::DOUBLE"
    return f"SELECT {keys}{confidence}e0 AS confidence, round(greatest(estimate - {margin}, 0e0), 6) AS lower, round(estimate, 6) AS estimate, round(estimate + {margin}, 6) AS upper FROM ({inner})"


@query(_bounds_sql(sql.hll_estimate(sql.hll_registers("events", "user_id", 14, "event_type"), 14, "event_type"), "event_type, ", 14, 0.95, 1.96))
def hll_by_event_type(spark, d):
    out = HyperLogLog.build(t(spark, d, "events"), "user_id", 14, by="event_type").estimate(0.95)
    return out.select("event_type", "bounds.confidence", F.round("bounds.lower", 6).alias("lower"), F.round("bounds.estimate", 6).alias("estimate"), F.round("bounds.upper", 6).alias("upper"))


LEVELS = ((0.5, 1.0), (0.8, 1.282), (0.9, 1.645), (0.95, 1.96), (0.99, 2.576))


@query(" UNION ALL ".join(f"SELECT *, round(upper - lower, 4) AS width, round((upper - lower) / estimate, 4) AS relative_width, 150e0 BETWEEN lower AND upper AS holds_150 FROM ({_bounds_sql(sql.hll_estimate(sql.hll_registers('events', 'user_id', 10), 10), '', 10, c, z)})" for c, z in LEVELS))
def hll_bounds_all_levels(spark, d):
    sketch = HyperLogLog.build(t(spark, d, "events"), "user_id", 10)
    out = None
    for confidence, _ in LEVELS:
        b = F.col("bounds")
        one = sketch.estimate(confidence).select("bounds.confidence", F.round("bounds.lower", 6).alias("lower"), F.round("bounds.estimate", 6).alias("estimate"), F.round("bounds.upper", 6).alias("upper"), F.round(width(b), 4).alias("width"), F.round(relative_width(b), 4).alias("relative_width"), contains(b, F.lit(150.0)).alias("holds_150"))
        out = one if out is None else out.union(one)
    return out


@query(sql.hll_registers("events", "(event_id * 2654435761)::UBIGINT", 6, "event_type", hashed=True))
def hll_insert_hash(spark, d):
    e = t(spark, d, "events").withColumn("h", F.col("event_id") * F.lit(2654435761))
    return HyperLogLog.build(e, "h", 6, by="event_type", hash="precomputed").table


@query(f"SELECT round(estimate, 6) AS estimate, n_inserts FROM ({sql.hll_estimate(sql.hll_registers('orders', 'o_orderkey', 12), 12)})")
def hll_merge_disjoint(spark, d):
    o = t(spark, d, "orders")
    parts = [HyperLogLog.build(o.where(c), "o_orderkey", 12) for c in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "coalesce(o_orderstatus, '') not in ('F', 'O')")]
    return parts[0].merge(*parts[1:]).estimate().select(*r6("estimate"), "n_inserts")


@query(f"SELECT round(estimate, 6) AS estimate, n_inserts FROM ({sql.hll_estimate(sql.hll_registers('(SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer)', 'o_custkey', 12), 12)})")
def hll_merge_overlap(spark, d):
    a = HyperLogLog.build(t(spark, d, "orders"), "o_custkey", 12)
    return a.merge(HyperLogLog.build(t(spark, d, "customer"), "c_custkey", 12)).estimate().select(*r6("estimate"), "n_inserts")


@query(f"SELECT event_type, round(estimate, 6) AS estimate, n_inserts FROM ({sql.hll_estimate(sql.hll_registers('events', 'user_id', 12, 'event_type'), 12, 'event_type')})")
def hll_roll_up(spark, d):
    fine = HyperLogLog.build(t(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", 12, by=["event_type", "day"])
    return fine.roll_up("event_type").estimate().select("event_type", *r6("estimate"), "n_inserts")


ERRORS = (0.2, 0.1, 0.05, 0.03, 0.01, 0.005, 0.002)


@query("SELECT e AS error, p::INTEGER AS precision, pow(2, p)::BIGINT AS registers, round(1.04e0 / sqrt(pow(2e0, p)), 9) AS standard_error FROM (SELECT e, least(greatest(ceil(log2(pow(1.04e0 / e, 2))), 4), 18) AS p FROM (VALUES " + ", ".join(f"({e}e0)" for e in ERRORS) + ") x(e))")
def hll_precision_helpers(spark, d):
    rows = [(e, p := cardinality.precision_for_error(e), cardinality.memory_for_precision(p), cardinality.error_for_precision(p)) for e in ERRORS]
    return spark.createDataFrame(rows, "error double, precision int, registers long, standard_error double").withColumn("standard_error", F.round("standard_error", 9))


@query("SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS exact, TRUE AS within FROM lineitem GROUP BY l_returnflag")
def hll_error_within_bounds(spark, d):
    li = t(spark, d, "lineitem")
    exact = li.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("exact"))
    got = HyperLogLog.build(li, "l_partkey", 14, by="l_returnflag", hash="fast").estimate(0.99)
    return exact.join(got, "l_returnflag").select("l_returnflag", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 4 * cardinality.error_for_precision(14) * F.col("exact")).alias("within"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS exact, TRUE AS within FROM events GROUP BY event_type")
def hll_builtin(spark, d):
    e = t(spark, d, "events")
    got = cardinality.builtin_distinct(e, "user_id", by="event_type", error=0.02)
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return exact.join(got, "event_type").select("event_type", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS exact, TRUE AS within FROM events GROUP BY event_type")
def hll_builtin_union(spark, d):
    e = t(spark, d, "events")
    days = cardinality.builtin_hll(e.withColumn("day", F.to_date("ts")), "user_id", by=["event_type", "day"])
    got = cardinality.builtin_hll_union(days, by="event_type")
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return exact.join(got, "event_type").select("event_type", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within"))


@query(sql.hll_registers("events", "user_id", 12))
def sql_hll_registers(spark, d):
    """The registers in SQL, from registered functions."""
    from rillmark import sqlapi

    sqlapi.register_functions(spark)
    hashed = t(spark, d, "events").selectExpr("sketch_hash(CAST(user_id AS STRING)) AS h").where("h is not null")
    return hashed.selectExpr("sketch_register(h, 12) AS idx", "sketch_rank(h, 12) AS rho").groupBy("idx").agg(F.max("rho").alias("rho"), F.count("*").alias("n"))


# --- frequencies ------------------------------------------------------------------------------------------------

W, D = CountMin.dimensions(0.001, 0.01)
USERS = "SELECT DISTINCT user_id FROM events"


@query(sql.cms_cells("events", "user_id", W, D))
def cms_table(spark, d):
    return CountMin.with_error(t(spark, d, "events"), "user_id", 0.001, 0.01).table


@query(sql.cms_estimate(sql.cms_cells("events", "user_id", W, D), f"{USERS} UNION ALL SELECT -1", "user_id", W, D))
def cms_estimate_all(spark, d):
    e = t(spark, d, "events")
    probes = e.select("user_id").distinct().union(spark.createDataFrame([(-1,)], "user_id long"))
    return CountMin.with_error(e, "user_id", 0.001, 0.01).estimate(probes, "user_id")


@query(sql.cms_estimate(sql.cms_cells("lineitem", "l_partkey", 272, 7, "floor(l_quantity)::BIGINT"), "SELECT p_partkey AS l_partkey FROM part", "l_partkey", 272, 7))
def cms_weighted(spark, d):
    sketch = CountMin.with_error(t(spark, d, "lineitem"), "l_partkey", 0.01, 0.001, weight=F.floor("l_quantity"))
    return sketch.estimate(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")


@query(sql.cms_cells("events", "user_id", 1000, 5))
def cms_merge(spark, d):
    e = t(spark, d, "events")
    kinds = CountMin.build(e.where("event_type = 'view'"), "user_id", 1000, 5)
    return kinds.merge(CountMin.build(e.where("event_type = 'click'"), "user_id", 1000, 5), CountMin.build(e.where("event_type not in ('view', 'click') or event_type is null"), "user_id", 1000, 5)).table


@query(f"SELECT min(p)::BIGINT AS inner_product FROM (SELECT r, coalesce(sum(a.cnt * b.cnt), 0) AS p FROM range(5) t(r) LEFT JOIN ({sql.cms_cells('(SELECT * FROM events WHERE event_type = $$view$$)', 'user_id', 500, 5)}) a ON a.row = r LEFT JOIN ({sql.cms_cells('(SELECT * FROM events WHERE event_type = $$click$$)', 'user_id', 500, 5)}) b ON b.row = r AND b.col = a.col GROUP BY r)".replace("$$", "'"))
def cms_inner_product(spark, d):
    e = t(spark, d, "events")
    a, b = (CountMin.build(e.where(F.col("event_type") == k), "user_id", 500, 5) for k in ("view", "click"))
    return a.inner_product(b)


@query(f"SELECT l_returnflag, count(*)::BIGINT AS total_count, floor({math.e / 272!r}::DOUBLE * count(*))::BIGINT AS error_bound, count(*)::BIGINT AS n_updates FROM lineitem GROUP BY l_returnflag")
def cms_error_bound(spark, d):
    s = CountMin.build(t(spark, d, "lineitem"), "l_partkey", 272, 7, by="l_returnflag")
    return s.error_bound().join(s.totals().select("l_returnflag", "n_updates"), "l_returnflag")


@query(f"SELECT * FROM ({sql.cms_estimate(sql.cms_cells('events', 'user_id', W, D), USERS, 'user_id', W, D)}) WHERE estimate >= 75")
def cms_threshold(spark, d):
    e = t(spark, d, "events")
    return CountMin.with_error(e, "user_id", 0.001, 0.01).exceeding(e.select("user_id").distinct(), "user_id", 75)


@query()
def cms_conservative(spark, d):
    return CountMin.conservative(t(spark, d, "events"), "user_id", ["ts", "event_id"], 64, 4).table


@query("SELECT user_id, count(*)::BIGINT AS exact, TRUE AS plain_holds, TRUE AS conservative_holds, TRUE AS not_above_plain FROM events GROUP BY user_id")
def cms_never_underestimates(spark, d):
    e = t(spark, d, "events")
    exact = e.groupBy("user_id").agg(F.count("*").alias("exact"))
    plain = CountMin.build(e, "user_id", 64, 4, hash="fast").estimate(exact, "user_id").withColumnRenamed("estimate", "plain")
    both = CountMin.conservative(e, "user_id", ["ts", "event_id"], 64, 4, hash="fast").estimate(plain, "user_id")
    return both.select("user_id", "exact", (F.col("plain") >= F.col("exact")).alias("plain_holds"), (F.col("estimate") >= F.col("exact")).alias("conservative_holds"), (F.col("estimate") <= F.col("plain")).alias("not_above_plain"))


# --- heavy hitters ----------------------------------------------------------------------------------------------


@query()
def ss_top_k(spark, d):
    return SpaceSaving.build(t(spark, d, "events"), "user_id", ["ts", "event_id"], 20).top_k(10)


@query()
def ss_heavy_hitters(spark, d):
    return SpaceSaving.build(t(spark, d, "events"), "user_id", ["ts", "event_id"], 20).heavy_hitters(0.05)


@query()
def ss_error_guaranteed(spark, d):
    e = t(spark, d, "events")
    return SpaceSaving.build(e, "user_id", ["ts", "event_id"], 20).estimate(e.select("user_id").distinct(), "user_id")


@query("SELECT user_id, count(*)::BIGINT AS exact, TRUE AS tracked, TRUE AS holds FROM events GROUP BY user_id HAVING count(*) > (SELECT count(*) FROM events) / 140.0")
def ss_guarantee(spark, d):
    e = t(spark, d, "events")
    n = e.agg(F.count("*").alias("n"))
    often = e.groupBy("user_id").agg(F.count("*").alias("exact")).crossJoin(F.broadcast(n)).where(F.col("exact") > F.col("n") / 140.0)  # n is one row
    got = SpaceSaving.build(e, "user_id", ["ts", "event_id"], 140).estimate(often, "user_id")
    return got.select("user_id", "exact", "tracked", ((F.col("estimate") >= F.col("exact")) & (F.col("guaranteed_count") <= F.col("exact"))).alias("holds"))


@query("SELECT event_type AS item, count(*)::BIGINT AS cnt, 0::BIGINT AS err FROM events GROUP BY event_type")
def ss_exact_when_fits(spark, d):
    return SpaceSaving.build(t(spark, d, "events"), "event_type", ["ts", "event_id"], 10).table.select("item", "cnt", "err")


@query("SELECT event_type, item, cnt FROM (SELECT event_type, l.item, l.cnt, row_number() OVER (PARTITION BY event_type ORDER BY cnt DESC, first) AS r FROM (SELECT event_type, user_id % 10 AS item, count(*)::BIGINT AS cnt, min((ts, event_id)) AS first FROM events GROUP BY ALL) l) WHERE r <= 3")
def ss_top_k_by_key(spark, d):
    e = t(spark, d, "events").withColumn("u", F.col("user_id") % 10)
    return SpaceSaving.build(e, "u", ["ts", "event_id"], 10, by="event_type").top_k(3).select("event_type", "item", "cnt")


@query("SELECT event_type AS item, count(*)::BIGINT AS count FROM events GROUP BY event_type")
def ss_builtin_top_k(spark, d):
    return heavy_hitters.mergeable_top_k(t(spark, d, "events"), "event_type", 10)


# --- quantiles --------------------------------------------------------------------------------------------------

DIGEST = f"WITH RECURSIVE {sql.digest('events', 'event_type', 'value', 100.0)}"
QS = (0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
VS = (-1.0, 0.5, 10.0, 50.0, 120.0, 1000.0)


def _td(spark, d, **options) -> TDigest:
    return TDigest.build(t(spark, d, "events"), "value", 100.0, by="event_type", **options)


@query(f"{DIGEST} SELECT k AS event_type, pos::INTEGER AS pos, round(mean, 6) AS mean, w::BIGINT AS weight FROM c")
def td_centroids(spark, d):
    return _td(spark, d).table.select("event_type", "pos", *r6("mean"), "weight")


@query(f"{DIGEST} SELECT k AS event_type, q, round({sql.QUANTILE}, 6) AS value FROM g, (VALUES {', '.join(f'({q}e0)' for q in QS)}) x(q) WHERE {sql.QUANTILE_LINES} GROUP BY k, q")
def td_quantiles(spark, d):
    return _td(spark, d).quantiles(QS).select("event_type", "q", *r6("value"))


@query(f"{DIGEST} SELECT k AS event_type, round({sql.QUANTILE}, 6) AS median FROM g, (VALUES (0.5e0)) x(q) WHERE {sql.QUANTILE_LINES} GROUP BY k")
def td_median(spark, d):
    return _td(spark, d).median().select("event_type", *r6("median"))


@query(f"""{DIGEST} SELECT k AS event_type, x AS v, round(max(CASE WHEN x >= hi THEN 1e0 WHEN x <= lo THEN 0e0 WHEN v1 - v0 <= 0 THEN CASE WHEN last THEN 1e0 ELSE r0 / n END ELSE (r0 + (x - v0) / (v1 - v0) * (r1 - r0)) / n END), 6) AS rank
  FROM g, (VALUES {', '.join(f'({v}e0)' for v in VS)}) y(x) WHERE CASE WHEN x >= hi OR x <= lo THEN r0 = 0 ELSE v0 <= x AND (last OR x < v1) END GROUP BY k, x""")
def td_rank_cdf(spark, d):
    return _td(spark, d).cdf(VS).select("event_type", "v", *r6("rank"))


@query("SELECT event_type, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value)::BIGINT AS n_values FROM events GROUP BY event_type")
def td_min_max(spark, d):
    return _td(spark, d).extremes().select("event_type", *r6("min", "max"), "n_values")


HAZEN = ", ".join(f"({q}e0)" for q in (0.1, 0.25, 0.5, 0.75, 0.9))


@query(f"""WITH s AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
  z AS (SELECT DISTINCT user_id, n, q, q * n + 0.5e0 AS p FROM s, (VALUES {HAZEN}) v(q) WHERE n < 127)
  SELECT z.user_id, z.q, round(CASE WHEN a.x IS NULL THEN b.x - (b.x - (SELECT min(x) FROM s WHERE s.user_id = z.user_id)) WHEN b.x IS NULL THEN a.x ELSE a.x + (p - floor(p)) * (b.x - a.x) END, 6) AS value
  FROM z LEFT JOIN s a ON a.user_id = z.user_id AND a.i = floor(p) LEFT JOIN s b ON b.user_id = z.user_id AND b.i = floor(p) + 1""")
def td_small_exact_hazen(spark, d):
    got = TDigest.build(t(spark, d, "events"), "value", 100.0, by="user_id")
    small = got.extremes().where("n_values < 127").select("user_id")  # digests of so few values are exact
    return got.quantiles((0.1, 0.25, 0.5, 0.75, 0.9)).join(small, "user_id", "left_semi").select("user_id", "q", *r6("value"))


@query("SELECT user_id, count(value)::BIGINT AS n_values, TRUE AS near FROM events GROUP BY user_id HAVING count(value) > 0")
def td_by_user(spark, d):
    """All users, however many values they have: the shares up to the quantiles are within 0.02, or one value where
    there are few (the digest is exact then, see td_small_exact_hazen)."""
    e = t(spark, d, "events")
    got = TDigest.build(e, "value", 100.0, by="user_id")
    qs = (0.25, 0.5, 0.9)
    named = got.quantiles(qs).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("m"))  # len(qs) rows a key
    below, upto = ([F.avg(c(F.col("value"), F.col("m")[q]).cast("double")) for q in qs] for c in (lambda a, b: a < b, lambda a, b: a <= b))
    slack = F.lit(0.02) + 1 / F.count("value")
    near = [(lo <= q + slack) & (hi >= q - slack) for lo, hi, q in zip(below, upto, qs, strict=True)]  # equal values share a rank
    return e.join(named, "user_id").groupBy("user_id").agg(F.count("value").alias("n_values"), (near[0] & near[1] & near[2]).alias("near"))


@query("SELECT event_type, count(value)::BIGINT AS n_values, round(min(value), 6) AS min, round(max(value), 6) AS max, TRUE AS near FROM events GROUP BY event_type")
def td_merge(spark, d):
    e = t(spark, d, "events")
    halves = [TDigest.build(e.where(F.col("event_id") % 2 == i), "value", 100.0, by="event_type") for i in (0, 1)]
    merged = halves[0].merge(halves[1])
    near = _near(merged, e, "value", "event_type", (0.25, 0.5, 0.9, 0.99), 0.01)
    return merged.extremes().join(near, "event_type").select("event_type", "n_values", *r6("min", "max"), "near")


def _near(digest: TDigest, rows: DataFrame, value: str, key: str, qs, tolerance: float) -> DataFrame:
    """(key, near): whether the exact share of values up to each estimated quantile is near its rank."""
    got = digest.quantiles(qs).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("m"))  # len(qs) rows a key
    shares = [F.abs(F.avg((F.col(value) <= F.col("m")[q]).cast("double")) - q) <= tolerance for q in qs]
    near = shares[0]
    for s in shares[1:]:
        near = near & s
    return rows.join(got, key).groupBy(key).agg(near.alias("near"))


@query("SELECT l_returnflag, count(*)::BIGINT AS n_values, round(min(l_extendedprice), 6) AS min, round(max(l_extendedprice), 6) AS max, TRUE AS near FROM lineitem GROUP BY l_returnflag")
def td_vs_exact_tolerance(spark, d):
    li = t(spark, d, "lineitem")
    got = TDigest.build(li, "l_extendedprice", 100.0, by="l_returnflag", mode="partial")
    near = _near(got, li, "l_extendedprice", "l_returnflag", (0.01, 0.25, 0.5, 0.75, 0.99), 0.01)
    return got.extremes().join(near, "l_returnflag").select("l_returnflag", "n_values", *r6("min", "max"), "near")


@query("SELECT l_returnflag, count(*)::BIGINT AS n_values, TRUE AS monotone FROM lineitem GROUP BY l_returnflag")
def td_monotone(spark, d):
    got = TDigest.build(t(spark, d, "lineitem"), "l_extendedprice", 100.0, by="l_returnflag", mode="partial")
    steps = got.quantiles([i / 50 for i in range(51)]).groupBy("l_returnflag").agg(F.sort_array(F.collect_list(F.struct("q", "value"))).alias("s"))  # 51 rows a key
    rising = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.col("s")[i]["value"] >= F.col("s")[i - 1]["value"])
    return steps.join(got.extremes(), "l_returnflag").select("l_returnflag", "n_values", rising.alias("monotone"))


@query("SELECT event_type, count(value)::BIGINT AS n_values, TRUE AS near FROM events GROUP BY event_type")
def td_builtin(spark, d):
    e = t(spark, d, "events")
    got = quantiles.builtin_quantiles(e, "value", (0.25, 0.5, 0.9), by="event_type").groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("m"))
    near = [F.abs(F.avg((F.col("value") <= F.col("m")[q]).cast("double")) - q) <= 0.01 for q in (0.25, 0.5, 0.9)]
    return e.join(got, "event_type").groupBy("event_type").agg(F.count("value").alias("n_values"), (near[0] & near[1] & near[2]).alias("near"))


@query("SELECT event_type, count(value)::BIGINT AS n_values, TRUE AS near FROM events GROUP BY event_type")
def td_builtin_kll(spark, d):
    e = t(spark, d, "events")
    got = quantiles.builtin_kll(e, "value", (0.25, 0.5, 0.9), by="event_type").groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("m"))  # three rows a key
    near = [F.abs(F.avg((F.col("value") <= F.col("m")[q]).cast("double")) - q) <= 0.02 for q in (0.25, 0.5, 0.9)]
    return e.join(got, "event_type").groupBy("event_type").agg(F.count("value").alias("n_values"), (near[0] & near[1] & near[2]).alias("near"))


# --- membership -------------------------------------------------------------------------------------------------

BITS, HASHES = BloomFilter.parameters_for(1500, 0.01)
BUILDING = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


def _building(spark, d) -> BloomFilter:
    return BloomFilter.build(t(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey", BITS, HASHES)


@query(f"SELECT word, (CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::BIGINT AS bits FROM (SELECT (b // 64)::BIGINT AS word, bit_or(1::UBIGINT << (b % 64)::UBIGINT) AS u FROM ({sql.bloom_bits(BUILDING, 'c_custkey', BITS, HASHES)}) GROUP BY 1)")
def bloom_words(spark, d):
    return _building(spark, d).table.select("word", "bits")


@query(f"SELECT c_custkey, bool_and(s.b IS NOT NULL) AS contains FROM (SELECT c_custkey, {sql.place('r', 'c_custkey', BITS)} AS b FROM customer, range({HASHES}) t(r)) p LEFT JOIN ({sql.bloom_bits(BUILDING, 'c_custkey', BITS, HASHES)}) s ON s.b = p.b GROUP BY c_custkey")
def bloom_contains(spark, d):
    return _building(spark, d).contains(t(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(f"SELECT word, (CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::BIGINT AS bits FROM (SELECT (b // 64)::BIGINT AS word, bit_or(1::UBIGINT << (b % 64)::UBIGINT) AS u FROM ({sql.bloom_bits('customer', 'c_custkey', BITS, HASHES)}) GROUP BY 1)")
def bloom_merge(spark, d):
    rest = BloomFilter.build(t(spark, d, "customer").where("c_mktsegment <> 'BUILDING' or c_mktsegment is null"), "c_custkey", BITS, HASHES)
    return _building(spark, d).merge(rest).table.select("word", "bits")


@query(f"SELECT k::BIGINT AS bits_set, round(pow(k / {BITS}e0, {HASHES}), 9) AS fpr, round(-{BITS / HASHES!r}::DOUBLE * ln(1 - k / {BITS}e0), 6) AS estimated_count, (SELECT count(*) FROM {BUILDING})::BIGINT AS n_inserts FROM (SELECT count(*) AS k FROM ({sql.bloom_bits(BUILDING, 'c_custkey', BITS, HASHES)}))")
def bloom_stats(spark, d):
    return _building(spark, d).stats().select("bits_set", F.round("fpr", 9).alias("fpr"), *r6("estimated_count"), "n_inserts")


@query(f"SELECT count(*)::BIGINT AS inserted, count(*)::BIGINT AS found FROM {BUILDING}")
def bloom_no_false_negative(spark, d):
    mine = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return _building(spark, d).contains(mine, "c_custkey").agg(F.count("*").alias("inserted"), F.sum(F.col("contains").cast("long")).alias("found"))


@query("SELECT count(*)::BIGINT AS outsiders, TRUE AS within FROM customer WHERE c_mktsegment <> 'BUILDING'")
def bloom_fpr_bound(spark, d):
    others = t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey")
    n = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").count()
    sized = BloomFilter.for_items(t(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey", max(n, 1), 0.01, hash="fast")
    return sized.contains(others, "c_custkey").agg(F.count("*").alias("outsiders"), (F.avg(F.col("contains").cast("double")) < 0.03).alias("within"))


@query("SELECT o_orderkey, TRUE AS kept FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bloom_semi_join(spark, d):
    customers = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    n = customers.count()
    sieve = BloomFilter.for_items(customers, "c_custkey", max(n, 1), 0.01, hash="fast")
    likely = sieve.semi_join(t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return likely.join(customers.select("c_custkey"), "c_custkey", "left_semi").select("o_orderkey", F.lit(True).alias("kept"))


# --- samples ----------------------------------------------------------------------------------------------------


def _priority(item: str) -> str:
    return f"('0x' || substr(md5('{DEFAULT_SEED}:' || CAST({item} AS VARCHAR)), 1, 16))::UBIGINT"


def _signed(item: str) -> str:
    u = f"({_priority(item)})::HUGEINT"
    return f"CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END"


@query(f"SELECT event_id, user_id FROM events ORDER BY {_signed('event_id')}, event_id LIMIT 100")
def reservoir_bottom_k(spark, d):
    return Reservoir.build(t(spark, d, "events").select("event_id", "user_id"), "event_id", 100).sample()


@query(f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_signed('doc_id')}, doc_id) AS r FROM documents) WHERE r <= 25")
def reservoir_by_key(spark, d):
    return Reservoir.build(t(spark, d, "documents").select("lang", "doc_id"), "doc_id", 25, by="lang").sample()


@query(f"SELECT event_id, (SELECT count(*) FROM events)::BIGINT AS items_seen FROM events ORDER BY {_signed('event_id')}, event_id LIMIT 50")
def reservoir_merge(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id")
    a, b = (Reservoir.build(e.where(c).select("event_id"), "event_id", 50) for c in ("user_id % 3 = 0", "user_id % 3 <> 0"))
    return a.merge(b).table.select("event_id", "items_seen")


@query("SELECT lang, count(*)::BIGINT AS items_seen, round(least(1e0, 25e0 / count(*)), 6) AS probability FROM documents GROUP BY lang")
def reservoir_probability(spark, d):
    return Reservoir.build(t(spark, d, "documents").select("lang", "doc_id"), "doc_id", 25, by="lang").probability().select("lang", "items_seen", *r6("probability"))


# --- set operations ---------------------------------------------------------------------------------------------

_SETS = "(SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = '{}')"


def _sets(spark, d) -> DataFrame:
    """The sketches of parts returned (R) and not (N), their estimates, and the exact sizes."""
    li = t(spark, d, "lineitem").where("l_returnflag in ('R', 'N')")
    both = setops.theta_sketches(li, "l_partkey", by="l_returnflag")
    pair = both.agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("sketch"))).alias("a"), F.max(F.when(F.col("l_returnflag") == "N", F.col("sketch"))).alias("b"))
    flags = li.groupBy("l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_returnflag") == "N").cast("int")).alias("n"))
    exact = flags.agg(F.count("*").alias("u"), F.sum(F.col("r") * F.col("n")).alias("i"), F.sum(F.col("r") * (1 - F.col("n"))).alias("m"))
    return setops.compare(pair).crossJoin(exact)  # one row each


def _near_sql(expr: str, name: str = "exact") -> str:
    return f"SELECT ({expr})::BIGINT AS {name}, TRUE AS within FROM (SELECT 1)"


def _set_query(estimate: str, exact: str):
    def run(spark, d):
        return _sets(spark, d).select(F.col(exact).cast("long").alias("exact"), (F.abs(F.col(estimate) - F.col(exact)) <= 0.03 * F.col("u")).alias("within"))

    return run


for _name, _est, _exact, _op in (("set_union", "union_size", "u", "UNION"), ("set_intersection", "intersection_size", "i", "INTERSECT"), ("set_difference", "difference_size", "m", "EXCEPT")):
    QUERIES[_name] = _set_query(_est, _exact)
    ORACLE_SQL[_name] = _near_sql(f"SELECT count(*) FROM ({_SETS.format('R')} {_op} {_SETS.format('N')})")


@query(f"SELECT round((SELECT count(*) FROM ({_SETS.format('R')} INTERSECT {_SETS.format('N')})) / (SELECT count(*) FROM ({_SETS.format('R')} UNION {_SETS.format('N')}))::DOUBLE, 6) AS exact, TRUE AS within")
def set_jaccard(spark, d):
    s = _sets(spark, d)
    return s.select(F.round(F.col("i") / F.col("u"), 6).alias("exact"), (F.abs(F.col("jaccard") - F.col("i") / F.col("u")) <= 0.05).alias("within"))


# --- streams ----------------------------------------------------------------------------------------------------


def _drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there; what it has in the end is written to the shared folder, with the stream's state."""
    spark = stream.sparkSession
    path = f"{scratch_root(spark)}/rillmark-streams/{name}-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows")  # every batch holds all rows (complete mode)

    q = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _event_stream(spark, d, delay: str = "1 hour") -> DataFrame:
    path = f"{str(d).rstrip('/')}/events.parquet"
    return windows.event_time(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"), "ts", delay)


_WEEK = "(SELECT *, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS window_start FROM events)"


@query(f"SELECT strftime(window_start, '%Y-%m-%d') AS week, idx, rho, n FROM ({sql.hll_registers(_WEEK, 'user_id', 8, 'window_start')})")
def stream_hll_weekly(spark, d):
    out = _drain(windows.hyperloglog(_event_stream(spark, d), "user_id", "ts", "7 days", 8), "rillmark_hll_weekly")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("week"), "idx", "rho", "n")


@query(f"SELECT strftime(window_start, '%Y-%m-%d') AS week, row, col, cnt FROM ({sql.cms_cells(_WEEK, 'user_id', 64, 3, '1', 'window_start')})")
def stream_cms_weekly(spark, d):
    out = _drain(windows.count_min(_event_stream(spark, d), "user_id", "ts", "7 days", 64, 3), "rillmark_cms_weekly")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("week"), "row", "col", "cnt")


@query("SELECT strftime(time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance FROM events GROUP BY ALL")
def stream_moments_weekly(spark, d):
    out = _drain(windows.moments(_event_stream(spark, d), "value", "ts", "7 days", by="event_type"), "rillmark_moments_weekly")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("week"), "event_type", "n", *r6("mean", "variance"))
