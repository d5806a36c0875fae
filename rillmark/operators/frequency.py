"""Count-Min: item frequencies that are never too low."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.hashing import bucket, check_kind
from rillmark.operators.core import BROADCAST_BYTES, MergeError, Sketch, answer, as_column, dense, key_names, match, positive, saturating_sum
from rillmark.operators.folds import fold_groups


@dataclass(frozen=True)
class CountMin(Sketch):
    """Rows (keys, row, col, cnt, n): the non-zero cells, with the number of updates that met each."""

    width: int
    depth: int
    hash: str

    KIND = "count-min"
    COLUMNS = ("row", "col", "cnt", "n", "estimate", "total_count", "n_updates", "error_bound", "inner_product")

    @staticmethod
    def dimensions(epsilon: float, delta: float) -> tuple[int, int]:
        if not (0 < epsilon < 1 and 0 < delta < 1):
            raise ValueError("epsilon and delta must be in (0, 1)")
        return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))

    @classmethod
    def build(cls, df: DataFrame, item: str | Column, width: int, depth: int, weight: str | Column | None = None, by=None, hash: str = "portable") -> CountMin:
        """Counts are linear, so equal items are summed before they are hashed. Null items are none."""
        positive(width=width, depth=depth)
        check_kind(hash)
        keys = key_names(by, cls.COLUMNS)
        rows = df.select(*keys, as_column(item).alias("__i"), (F.lit(1) if weight is None else as_column(weight)).cast("long").alias("__w")).where(F.col("__i").isNotNull())
        sums = rows.groupBy(*keys, "__i").agg(saturating_sum(F.col("__w")).alias("__w"), F.count("*").alias("__n"))
        cells = sums.select(*keys, F.explode(_places(F.col("__i"), width, depth, hash)).alias("__c"), "__w", "__n")
        table = cells.groupBy(*keys, F.col("__c.row").alias("row"), F.col("__c.col").alias("col")).agg(saturating_sum(F.col("__w")).alias("cnt"), F.sum("__n").alias("n"))
        return cls(table, keys, width, depth, hash)

    @classmethod
    def with_error(cls, df: DataFrame, item: str | Column, epsilon: float, delta: float, **options) -> CountMin:
        return cls.build(df, item, *cls.dimensions(epsilon, delta), **options)

    @classmethod
    def conservative(cls, df: DataFrame, item: str | Column, order_by, width: int, depth: int, weight: str | Column | None = None, by=None, hash: str = "portable") -> CountMin:
        """Conservative update in the order of ``order_by`` (end it with a unique column): a cell only rises to the
        item's new estimate. The order makes it a stream per key: rows are sorted, not gathered; the state is the table."""
        positive(width=width, depth=depth)
        keys = key_names(by, cls.COLUMNS)
        order = key_names(order_by)
        places = F.array(*[bucket(as_column(item), r, width, hash) for r in range(depth)])
        rows = df.where(as_column(item).isNotNull()).select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], places.alias("__p"), (F.lit(1) if weight is None else as_column(weight)).cast("long").alias("__w"))

        def start() -> list:
            return [[0] * (width * depth), np.zeros(width * depth, np.int64)]

        def step(state: list, batch: pa.RecordBatch) -> None:
            counts, updates = state
            at = batch.column(0).flatten().to_numpy().reshape(-1, depth) + np.arange(depth) * width
            for p, w in zip(at.tolist(), batch.column(1).to_pylist(), strict=True):  # each update needs the one before
                least = min([counts[i] for i in p]) + w
                for i in p:
                    if counts[i] < least:
                        counts[i] = least
            updates += np.bincount(at.ravel(), minlength=width * depth)

        def finish(state: list) -> dict[str, list]:
            at = np.flatnonzero(state[1])
            return {"row": (at // width).tolist(), "col": (at % width).tolist(), "cnt": [min(state[0][i], 2**63 - 1) for i in at.tolist()], "n": state[1][at].tolist()}

        table = fold_groups(rows, keys, [f"__o{i}" for i in range(len(order))], ["__p", "__w"], start, step, finish, "row int, col long, cnt long, n long")
        return cls(table, keys, width, depth, hash)

    @property
    def size_bytes(self) -> int:
        return self.width * self.depth * 8 + self.depth * 8 + 40

    def _combine(self, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return table.groupBy(*keys, "row", "col").agg(saturating_sum(F.col("cnt")).alias("cnt"), F.sum("n").alias("n"))

    def totals(self) -> DataFrame:
        """(keys, total_count, n_updates): the sum of weights, and how many updates there were (row 0 met all of them).
        After conservative updates the total is a lower bound of the sum of weights."""
        first = self.table.where("row = 0")
        return self.grouped(first).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_updates"))

    def error_bound(self) -> DataFrame:
        """(keys, total_count, error_bound): by how much an estimate is too high at most, with probability 1 - exp(-depth)."""
        return self.totals().select(*self.keys, "total_count", F.floor(F.lit(math.e / self.width) * F.col("total_count")).cast("long").alias("error_bound"))

    def estimate(self, probes: DataFrame, item: str) -> DataFrame:
        """``probes`` (with the sketch's keys, if it has any) and ``estimate``: the least cell of the item, 0 for none.

        Null keys are keys. A sketch without keys and of at most BROADCAST_BYTES goes to the probes as one row, and they
        are not shuffled; else distinct probes are looked up in a join."""
        answer(probes, "estimate")
        if not self.keys and self.width * self.depth * 8 <= BROADCAST_BYTES:
            cells = dense(self.table, F.col("row").cast("long") * self.width + F.col("col"), F.col("cnt"), self.width * self.depth)
            rows = [F.element_at("__cells", (bucket(F.col(item), r, self.width, self.hash) + (r * self.width + 1)).cast("int")) for r in range(self.depth)]
            return probes.crossJoin(F.broadcast(cells)).select(*probes.columns, F.when(F.col(item).isNull(), 0).otherwise(F.least(*rows) if self.depth > 1 else rows[0]).cast("long").alias("estimate"))
        unique = probes.select(*self.keys, item).where(F.col(item).isNotNull()).distinct()
        cells = unique.select(*self.keys, F.col(item).alias("__i"), F.explode(_places(F.col(item), self.width, self.depth, self.hash)).alias("__c")).select(*self.keys, "__i", F.col("__c.row").alias("__row"), F.col("__c.col").alias("__col"))
        mine = self.table.select(*self.keys, F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("cnt").alias("__cnt"))
        looked = match(cells, mine, [*self.keys, "__row", "__col"], "left").groupBy(*self.keys, "__i").agg(F.min(F.coalesce("__cnt", F.lit(0))).alias("estimate"))
        return match(probes, looked.withColumnRenamed("__i", item), [*self.keys, item], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0)))

    def exceeding(self, probes: DataFrame, item: str, threshold: int) -> DataFrame:
        return self.estimate(probes, item).where(F.col("estimate") >= threshold)

    def inner_product(self, other: CountMin) -> DataFrame:
        """(keys, inner_product): the least over rows of the sum of products of cells; rows without common cells give 0."""
        if (self.width, self.depth, self.hash, self.keys) != (other.width, other.depth, other.hash, other.keys):
            raise MergeError("inner products need sketches of equal dimensions and keys")
        mine = self.table.select(*self.keys, "row", "col", F.col("cnt").cast("decimal(19,0)").alias("__a"))
        theirs = other.table.select(*self.keys, "row", "col", F.col("cnt").cast("decimal(19,0)").alias("__b"))
        sums = match(mine, theirs, [*self.keys, "row", "col"]).groupBy(*self.keys, "row").agg(F.sum(F.col("__a") * F.col("__b")).alias("__p"))
        most = F.lit(2**63 - 1).cast("decimal(38,0)")
        if self.keys:
            least = match(self.table.select(*self.keys).distinct(), sums, self.keys, "left").groupBy(*self.keys)
        else:
            least = sums.groupBy()
        value = F.when(F.count("row") == self.depth, F.least(F.min("__p"), most)).otherwise(F.lit(0)).cast("long")
        return least.agg(value.alias("inner_product"))


def _places(item: Column, width: int, depth: int, hash: str) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("row"), bucket(item, r, width, hash).alias("col")) for r in range(depth)])
