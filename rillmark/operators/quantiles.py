"""t-digest: quantiles, ranks and distributions from centroids that are finest at both ends."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.operators.core import MergeError, Sketch, as_column, key_names, match
from rillmark.operators.folds import fold_groups

#: Cells per power of two in which values are counted before they are ranked.
CELLS = 2048
CENTROIDS = "pos int, mean double, weight long"
EXTENT = "total long, low double, high double"


def scale(q: np.ndarray | float, compression: float):
    """The scale function: its slope tells how little a centroid may span near q."""
    return compression * (np.arcsin(np.clip(2 * q - 1, -1, 1)) / math.pi + 0.5)


def compress(mean: np.ndarray, weight: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy compression of sorted centroids: the next one is absorbed while the centroid spans at most 1 on the scale.

    The scale is monotone, so each centroid's end is found by bisection over the running weights."""
    if not len(mean):
        return mean, weight
    ends = np.cumsum(weight)
    total = float(ends[-1])
    k = scale(ends / total, compression)
    sums = np.concatenate([[0.0], np.cumsum(mean * weight)])
    out_mean, out_weight = [], []
    start, done, k0 = 0, 0, float(scale(0.0, compression))
    while start < len(mean):
        stop = max(int(np.searchsorted(k - k0, 1.0, side="right")), start + 1)
        w = ends[stop - 1] - done
        part = slice(start, stop)
        out_mean.append(float(mean[start]) if stop == start + 1 else float(mean[start] + ((mean[part] - mean[start]) * (weight[part] / w)).sum()) if np.isfinite(mean[part]).all() else (sums[stop] - sums[start]) / w)
        out_weight.append(w)
        start, done, k0 = stop, ends[stop - 1], float(k[stop - 1])
    return np.array(out_mean), np.array(out_weight, np.int64)


def centroid_ends(total: int, compression: float) -> np.ndarray:
    """Up to which rank each centroid of ``total`` single values in order goes, greedily: as far as the scale rises by 1."""
    out, at = [], 0
    while at < total:
        q = math.asin(max(min(2.0 * at / total - 1, 1.0), -1.0)) / math.pi + 0.5
        if q * compression + 1 >= compression:
            at = total
        else:
            at = max(at + 1, math.floor(total * (math.sin(math.pi * (q + 1 / compression - 0.5)) + 1) / 2))
        out.append(at)
    return np.array(out, np.int64)


class _Stream:
    """Sorted values or centroids of one key, compressed as they pass: holds one chunk and the finished centroids."""

    def __init__(self, compression: float):
        self.compression = compression
        self.means, self.weights = [], []
        self.seen = self.done = 0
        self.mean, self.weight = np.zeros(0), np.zeros(0, np.int64)
        self.extent: tuple | None = None

    def advance(self, mean: np.ndarray, weight: np.ndarray, extent: tuple) -> None:
        self.extent = extent
        total = extent[0]
        self.seen += int(weight.sum())
        mean, weight = np.concatenate([self.mean, mean]), np.concatenate([self.weight, weight])
        ends = self.done + np.cumsum(weight)
        k = scale(ends / total, self.compression)
        start, k0 = 0, float(scale(self.done / total, self.compression))
        while start < len(mean):
            stop = max(int(np.searchsorted(k - k0, 1.0, side="right")), start + 1)
            if stop >= len(mean) and self.seen < total:
                break  # the centroid may go on in the next chunk
            w = int(ends[stop - 1]) - self.done
            part = slice(start, stop)
            self.means.append(float(mean[start]) if stop == start + 1 else float((mean[part] * (weight[part] / w)).sum()))
            self.weights.append(w)
            self.done += w
            start, k0 = stop, float(k[stop - 1])
        mean, weight = mean[start:], weight[start:]
        if len(mean) > 1 << 20:  # all of one centroid
            w = weight.sum()
            mean, weight = np.array([(mean * (weight / w)).sum()]), np.array([w])
        self.mean, self.weight = mean, weight

    def rows(self) -> dict[str, list]:
        n = len(self.means)
        return {"pos": list(range(n)), "mean": self.means, "weight": self.weights, **{c: [x] * n for c, x in zip(("total", "low", "high"), self.extent, strict=True)}}


def _extent(batch: pa.RecordBatch) -> tuple:
    return tuple(batch.column(batch.schema.get_field_index(c))[0].as_py() for c in ("total", "low", "high"))


@dataclass(frozen=True)
class TDigest(Sketch):
    """Rows (keys, pos, mean, weight, total, low, high): centroids in order; the last three repeat per key."""

    compression: float

    KIND = "t-digest"
    COLUMNS = ("pos", "mean", "weight", "total", "low", "high", "num_centroids", "n_values", "min", "max", "r0", "v0", "r1", "v1", "final", "t", "q", "v", "value", "rank", "median")

    @classmethod
    def build(cls, df: DataFrame, value: str | Column, compression: float = 100.0, by=None, mode: str = "sorted") -> TDigest:
        """NaN and null are no values.

        mode="sorted": the greedy digest of all values in order. Single values end their centroids at ranks that depend
        on their number alone, so values are first counted in cells of nearly equal values; a cell that lies within one
        centroid gives its sum, and only the values of cells with a centroid's end inside are ranked, cell by cell.
        No key's values pass through one task, and nothing is sorted but those cells' distinct values.
        mode="partial": a digest per partition, then one compression of all of them per key."""
        if not (math.isfinite(compression) and compression > 0):
            raise ValueError("compression must be finite and positive")
        if mode not in ("sorted", "partial"):
            raise ValueError("mode must be sorted or partial")
        keys = key_names(by, cls.COLUMNS)
        v = as_column(value).cast("double")
        rows = df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
        if mode == "partial":
            return cls(cls._partial(rows, keys, compression), keys, compression)._compressed()
        return cls(cls._ranked(rows, keys, compression), keys, compression)

    @staticmethod
    def _ranked(rows: DataFrame, keys: tuple[str, ...], compression: float) -> DataFrame:
        v = F.col("__v")
        steep = F.floor((F.log2(F.abs(v)) + 1100) * CELLS)  # rises with the size of v
        cell = F.when(v > 0, steep).when(v < 0, -steep).otherwise(0).alias("__cell")
        rows = rows.select(*keys, cell, "__v")
        cells = rows.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        whole = Window.partitionBy(*keys)  # the cells of a key: some thousands per power of two at most
        cells = cells.select(*keys, "__cell", "__n", "__s", F.sum("__n").over(whole).alias("total"), F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"))
        extent = ["total", "low", "high"]

        def step(state: list, batch: pa.RecordBatch) -> None:
            state += batch.to_pylist()

        def finish(found: list) -> dict[str, list]:
            stops = centroid_ends(found[0]["total"], compression)
            out: dict[str, list] = {c: [r[c] for r in found] for c in ("__cell", "__n", "__s", *extent)}
            ends = np.cumsum(out["__n"])
            before = ends - out["__n"]
            pos, last = np.searchsorted(stops, before, side="right"), np.searchsorted(stops, ends, side="left")
            return out | {"__before": before, "pos": pos, "__cuts": [stops[i:j].tolist() for i, j in zip(pos.tolist(), last.tolist(), strict=True)]}

        schema = "__cell long, __n long, __s double, total long, low double, high double, __before long, pos int, __cuts array<long>"
        placed = fold_groups(cells, keys, ["__cell"], ["__cell", "__n", "__s", *extent], list, step, finish, schema)
        inner = placed.where(F.size("__cuts") == 0).select(*keys, "pos", F.col("__n").alias("weight"), "__s", "low", "high", "total", *[F.lit(None).cast("double").alias(c) for c in ("__least", "__most")])
        cut = placed.where(F.size("__cuts") > 0).select(*keys, "__cell", "__before", "pos", "__cuts", *extent)
        met = match(rows, cut, (*keys, "__cell"))
        same = met.groupBy(*keys, "__cell", "__v").agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in ("__before", "pos", "__cuts", *extent)])
        along = Window.partitionBy(*keys, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        same = same.withColumn("__to", F.col("__before") + F.sum("__n").over(along)).withColumn("__from", F.col("__to") - F.col("__n"))
        within = F.filter("__cuts", lambda x: (x > F.col("__from")) & (x < F.col("__to")))
        bounds = F.concat(F.array("__from"), within, F.array("__to"))
        parts = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.struct((F.element_at(bounds, i + 1) - F.element_at(bounds, i)).alias("w"), F.size(F.filter("__cuts", lambda x: x <= F.element_at(bounds, i))).alias("p")))
        split = same.withColumn("__part", F.explode(parts))
        split = split.select(*keys, (F.col("pos") + F.col("__part.p")).alias("pos"), F.col("__part.w").alias("weight"), (F.col("__v") * F.col("__part.w")).alias("__s"), "low", "high", "total", F.col("__v").alias("__least"), F.col("__v").alias("__most"))
        # a centroid of equal values is that value; sums that overflow are infinite, as are sums of infinite values
        least, most = F.min("__least"), F.max("__most")
        mean = F.when((F.count("__least") == F.count("*")) & (least == most), least).otherwise(F.sum("__s") / F.sum("weight"))
        return inner.unionByName(split).groupBy(*keys, "pos").agg(mean.alias("mean"), F.sum("weight").alias("weight"), *[F.first(c).alias(c) for c in extent])

    @staticmethod
    def _partial(rows: DataFrame, keys: tuple[str, ...], compression: float, chunk: int = 1 << 16) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType, _parse_datatype_string

        schema = StructType([*(rows.schema[k] for k in keys), *_parse_datatype_string(f"{CENTROIDS}, {EXTENT}").fields])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}

            def out() -> pa.RecordBatch:
                parts = []
                for key, (mean, weight, low, high) in held.items():
                    n = len(mean)
                    columns = [pa.array([x] * n, arrow.field(i).type) for i, x in enumerate(key)]
                    rest = [np.arange(n, dtype=np.int32), mean, weight, np.full(n, weight.sum()), np.full(n, low), np.full(n, high)]
                    parts.append(pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in rest], schema=arrow))
                held.clear()
                return pa.Table.from_batches(parts, arrow).combine_chunks().to_batches()

            for batch in batches:
                if not batch.num_rows:
                    continue
                values = batch.column(len(keys)).to_numpy()
                if keys:
                    table = pa.Table.from_batches([batch]).append_column("__i", pa.array(np.arange(len(values))))
                    groups = table.group_by(list(keys)).aggregate([("__i", "list")])
                    named = [tuple(groups[k][i].as_py() for k in keys) for i in range(len(groups))]
                    members = [np.array(x) for x in groups["__i_list"].to_pylist()]
                else:
                    named, members = [()], [np.arange(len(values))]
                for key, rows_ in zip(named, members, strict=True):
                    v = np.sort(values[rows_])
                    mean, weight, low, high = held.get(key, (np.zeros(0), np.zeros(0, np.int64), math.inf, -math.inf))
                    mean, weight = np.concatenate([mean, v]), np.concatenate([weight, np.ones(len(v), np.int64)])
                    order = np.argsort(mean, kind="stable")
                    held[key] = (*compress(mean[order], weight[order], compression), min(low, v[0]), max(high, v[-1]))
                if len(held) > 4096:
                    yield from out()
            if held:
                yield from out()

        return rows.mapInArrow(run, schema)

    def _compressed(self) -> TDigest:
        return TDigest(self._combine(self.table, self.keys), self.keys, self.compression)

    def _combine(self, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """All centroids of a key in order of their means, compressed once; extents and totals combine."""
        compression = self.compression
        whole = Window.partitionBy(*keys)  # the centroids of a key's digests
        wide = table.select(*keys, "mean", "weight", F.sum("weight").over(whole).alias("total"), F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"))

        def step(state: _Stream, batch: pa.RecordBatch) -> None:
            state.advance(batch.column(0).to_numpy(), batch.column(1).to_numpy(), _extent(batch))

        return fold_groups(wide, keys, ["mean", "weight"], ["mean", "weight", "total", "low", "high"], lambda: _Stream(compression), step, _Stream.rows, f"{CENTROIDS}, {EXTENT}")

    def _check(self, other: Sketch) -> None:
        close = isinstance(other, TDigest) and abs(other.compression - self.compression) / max(self.compression, other.compression) <= 1e-6
        if not close or other.keys != self.keys:
            raise MergeError("t-digests of different compression or keys do not merge")

    @property
    def size_bytes(self) -> int:
        return int(2 * self.compression) * 24 + 64

    def num_centroids(self) -> DataFrame:
        return self.grouped().agg(F.count("*").alias("num_centroids"), F.coalesce(F.max("total"), F.lit(0)).alias("n_values"))

    def extremes(self) -> DataFrame:
        """(keys, min, max, n_values): exact; null without values."""
        return self.grouped().agg(F.min("low").alias("min"), F.max("high").alias("max"), F.coalesce(F.max("total"), F.lit(0)).alias("n_values"))

    def _anchors(self) -> DataFrame:
        """The lines of the distribution: (keys, r0, v0, r1, v1, final), from each anchor to the next.
        Anchors are (0, min), the middle of each centroid, (n, max). Windows hold one digest (about 2 * compression rows)."""
        along = Window.partitionBy(*self.keys).orderBy("pos")
        upto = along.rowsBetween(Window.unboundedPreceding, 0)
        mid = self.table.withColumn("r1", F.sum("weight").over(upto) - F.col("weight") / 2.0).withColumnRenamed("mean", "v1")
        back = mid.select(*self.keys, F.coalesce(F.lag("r1").over(along), F.lit(0.0)).alias("r0"), F.coalesce(F.lag("v1").over(along), F.col("low")).alias("v0"), "r1", "v1", "total", "low", "high", F.lit(False).alias("final"), F.lead("pos").over(along).isNull().alias("__last"))
        tail = back.where("__last").select(*self.keys, F.col("r1").alias("r0"), F.col("v1").alias("v0"), F.col("total").cast("double").alias("r1"), F.col("high").alias("v1"), "total", "low", "high", F.lit(True).alias("final"))
        return back.drop("__last").unionByName(tail)

    def quantiles(self, ranks: Sequence[float]) -> DataFrame:
        """(keys, q, value). Without keys an empty digest gives nulls."""
        q = F.col("q")
        lines = self._anchors().select("*", F.explode(F.array(*[F.lit(float(r)) for r in ranks])).alias("q"))
        t = F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)) * F.col("total")
        hit = lines.withColumn("t", t).where((F.col("r0") <= F.col("t")) & (F.col("final") | (F.col("t") < F.col("r1"))))
        run = F.col("r1") - F.col("r0")
        inside = F.when(run <= 0, F.when(F.col("final"), F.col("high")).otherwise(F.col("v0"))).otherwise(F.col("v0") + (F.col("t") - F.col("r0")) / run * (F.col("v1") - F.col("v0")))
        value = F.when(q.isNull() | F.isnan(q), None).when(q <= 0, F.col("low")).when(q >= 1, F.col("high")).otherwise(inside)
        got = hit.groupBy(*self.keys, "q").agg(F.min(value).alias("value"))
        if self.keys:
            return got
        spark = self.table.sparkSession
        return spark.createDataFrame([(float(r),) for r in ranks], "q double").distinct().join(got, "q", "left")

    def median(self) -> DataFrame:
        return self.quantiles([0.5]).select(*self.keys, F.col("value").alias("median"))

    def ranks(self, values: Sequence[float]) -> DataFrame:
        """(keys, v, rank): the share of values up to v (the same as ``cdf``); 0 for an empty digest without keys."""
        v = F.col("v")
        lines = self._anchors().select("*", F.explode(F.array(*[F.lit(float(x)) for x in values])).alias("v"))
        outside = (v >= F.col("high")) | (v <= F.col("low"))
        first = F.col("r0") == 0
        hit = lines.where(F.when(outside, first & ~F.col("final") | (F.col("final") & first)).otherwise((F.col("v0") <= v) & (F.col("final") | (v < F.col("v1")))))
        run = F.col("v1") - F.col("v0")
        inside = F.when(run <= 0, F.when(F.col("final"), 1.0).otherwise(F.col("r0") / F.col("total"))).otherwise((F.col("r0") + (v - F.col("v0")) / run * (F.col("r1") - F.col("r0"))) / F.col("total"))
        rank = F.when(v.isNull() | F.isnan(v), None).when(v >= F.col("high"), 1.0).when(v <= F.col("low"), 0.0).otherwise(inside)
        got = hit.groupBy(*self.keys, "v").agg(F.max(rank).alias("rank"))
        if self.keys:
            return got
        spark = self.table.sparkSession
        return spark.createDataFrame([(float(x),) for x in values], "v double").distinct().join(got, "v", "left").withColumn("rank", F.coalesce("rank", F.when(~F.isnan("v"), 0.0)))

    cdf = ranks


def builtin_quantiles(df: DataFrame, value: str, ranks: Sequence[float], by=None, accuracy: int = 10_000) -> DataFrame:
    """(keys, q, value): the engine's own percentile_approx."""
    keys = key_names(by)
    qs = F.array(*[F.lit(float(r)) for r in ranks])
    got = df.groupBy(*keys).agg(F.percentile_approx(value, [float(r) for r in ranks], accuracy).alias("p"))
    return got.select(*keys, F.explode(F.arrays_zip(qs.alias("q"), F.col("p").alias("value"))).alias("z")).select(*keys, F.col("z.q").alias("q"), F.col("z.value").alias("value"))


def builtin_kll(df: DataFrame, value: str, ranks: Sequence[float], by=None, k: int = 400) -> DataFrame:
    """(keys, q, value): the engine's own mergeable KLL sketch (rank errors of about 2.3 / k); NaN is no value."""
    keys = key_names(by)
    v = F.col(value).cast("double")
    got = df.select(*keys, F.when(~F.isnan(v), v).alias("__v")).where("__v is not null").groupBy(*keys).agg(F.kll_sketch_agg_double("__v", F.lit(k)).alias("__s"))
    at = [F.struct(F.lit(float(r)).alias("q"), F.kll_sketch_get_quantile_double("__s", F.lit(float(r))).alias("value")) for r in ranks]
    return got.select(*keys, F.explode(F.array(*at)).alias("__z")).select(*keys, F.col("__z.q").alias("q"), F.col("__z.value").alias("value"))
