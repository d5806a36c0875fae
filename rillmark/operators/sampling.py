"""Uniform samples of fixed size: the k rows of least hash priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.hashing import check_kind, hash64
from rillmark.operators.core import Sketch, key_names, match, positive

DEFAULT_SEED = 0x12345678


@dataclass(frozen=True)
class Reservoir(Sketch):
    """Rows (keys, priority, the sampled columns, items_seen): at most ``capacity`` per key.

    A row's priority is a hash of the seed and its unique column, so the sample does not depend on the order or the
    partitions of rows, merging is taking the least priorities of both, and samples are without replacement."""

    capacity: int
    unique: str
    seed: int
    hash: str

    KIND = "reservoir"
    COLUMNS = ("priority", "items_seen", "probability", "size", "full")

    @classmethod
    def build(cls, df: DataFrame, unique: str, capacity: int, by=None, seed: int = DEFAULT_SEED, hash: str = "portable") -> Reservoir:
        """``unique``: a column that tells rows apart (ties are broken by it); rows where it is null are not sampled."""
        positive(capacity=capacity)
        check_kind(hash)
        keys = key_names(by, cls.COLUMNS)
        item = F.concat(F.lit(f"{seed}:"), F.col(unique).cast("string"))
        rows = df.where(F.col(unique).isNotNull()).withColumn("priority", hash64(item, hash))
        seen = rows.groupBy(*keys).agg(F.count("*").alias("items_seen"))
        best = _least(rows, keys, unique, capacity)
        table = match(best, seen, keys)
        rest = [c for c in df.columns if c not in keys]
        return cls(table.select(*keys, "priority", *rest, "items_seen"), keys, capacity, unique, seed, hash)

    @property
    def size_bytes(self) -> int:
        return self.capacity * 8 + 24

    def merge(self, *others: Reservoir) -> Reservoir:
        """The least priorities of all samples: the sample of all rows together (rows in several samples count once)."""
        for other in others:
            self._check(other)
        parts = [self, *others]
        columns = [c for c in self.table.columns if c != "items_seen"]
        rows = parts[0].table.select(*columns)
        totals = parts[0].items_seen()
        for p in parts[1:]:
            rows, totals = rows.unionByName(p.table.select(*columns)), totals.unionByName(p.items_seen())
        totals = totals.groupBy(*self.keys).agg(F.sum("items_seen").alias("items_seen"))
        best = _least(rows.dropDuplicates([*self.keys, self.unique]), self.keys, self.unique, self.capacity)
        table = match(best, totals, self.keys)
        return Reservoir(table.select(*self.table.columns), self.keys, self.capacity, self.unique, self.seed, self.hash)

    def roll_up(self, *keys: str) -> Reservoir:
        """The sample of coarser keys; the keys left out become sampled columns."""
        totals = self.items_seen().groupBy(*keys).agg(F.sum("items_seen").alias("items_seen"))
        best = _least(self.table.drop("items_seen"), tuple(keys), self.unique, self.capacity)
        table = match(best, totals, keys)
        rest = [c for c in table.columns if c not in (*keys, "priority", "items_seen")]
        return Reservoir(table.select(*keys, "priority", *rest, "items_seen"), tuple(keys), self.capacity, self.unique, self.seed, self.hash)

    def items_seen(self) -> DataFrame:
        return self.grouped().agg(F.coalesce(F.max("items_seen"), F.lit(0)).alias("items_seen"))

    def sizes(self) -> DataFrame:
        """(keys, size, full): how many rows each sample holds, and whether that is its capacity."""
        return self.grouped().agg(F.count("*").alias("size"), (F.count("*") >= self.capacity).alias("full"))

    def sample(self) -> DataFrame:
        return self.table.drop("priority", "items_seen")

    def probability(self) -> DataFrame:
        """(keys, items_seen, probability): min(1, capacity / seen); 0 where nothing was seen."""
        p = F.when(F.col("items_seen") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.lit(float(self.capacity)) / F.col("items_seen")))
        return self.items_seen().withColumn("probability", p)


def _least(rows: DataFrame, keys: tuple[str, ...], unique: str, capacity: int) -> DataFrame:
    """The rows of least priority: without keys a distributed top-k; with keys a rank limit that is applied before the shuffle too."""
    if not keys:
        return rows.orderBy("priority", unique).limit(capacity)
    order = Window.partitionBy(*keys).orderBy("priority", unique)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= capacity).drop("__r")
