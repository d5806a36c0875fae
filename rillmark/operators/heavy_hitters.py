"""Space-Saving: the most frequent items with at most ``capacity`` counters."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.operators.core import MergeError, Sketch, answer, as_column, key_names, match, positive
from rillmark.operators.folds import fold_groups


class _Counters:
    """At most ``capacity`` counted items; an eviction costs the logarithm of the capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.slot, self.items, self.counts, self.errors = capacity, {}, [], [], []
        self.total = self.updates = 0
        self.heap: list[tuple[int, int]] = []

    def least(self) -> tuple[int, int]:
        """The least count and the first slot that has it. Counts only grow, so an entry of the heap is a lower bound of
        its slot's count and is put right when it comes up."""
        if not self.heap:
            self.heap = [(n, i) for i, n in enumerate(self.counts)]
            heapq.heapify(self.heap)
        while True:
            low, at = self.heap[0]
            if self.counts[at] == low:
                return low, at
            heapq.heapreplace(self.heap, (self.counts[at], at))

    def add(self, item, weight: int) -> None:
        self.total += weight
        self.updates += 1
        at = self.slot.get(item)
        if at is not None:
            self.counts[at] += weight
        elif len(self.items) < self.capacity:
            self.slot[item] = len(self.items)
            self.items.append(item)
            self.counts.append(weight)
            self.errors.append(0)
        else:  # the first of the least counters goes to the new item
            low, at = self.least()
            del self.slot[self.items[at]]
            self.slot[item] = at
            self.items[at], self.counts[at], self.errors[at] = item, low + weight, low


@dataclass(frozen=True)
class SpaceSaving(Sketch):
    """Rows (keys, slot, item, cnt, err, total, updates): the tracked items in slot order."""

    capacity: int

    KIND = "space-saving"
    COLUMNS = ("slot", "item", "cnt", "err", "total", "updates", "rank", "estimate", "error", "guaranteed_count", "tracked", "num_tracked", "total_count", "n_updates")

    @classmethod
    def build(cls, df: DataFrame, item: str | Column, order_by, capacity: int, weight: str | Column | None = None, by=None) -> SpaceSaving:
        """Counts items in the order of ``order_by`` (end it with a unique column). Null items are none.

        The result depends on the order, so each key is one stream; it holds ``capacity`` counters."""
        positive(capacity=capacity)
        keys, order = key_names(by, cls.COLUMNS), key_names(order_by)
        rows = df.where(as_column(item).isNotNull()).select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], as_column(item).alias("__item"), (F.lit(1) if weight is None else as_column(weight)).cast("long").alias("__w"))
        kind = rows.schema["__item"].dataType.simpleString()

        def step(state: _Counters, batch: pa.RecordBatch) -> None:
            for value, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state.add(value, w)

        def finish(s: _Counters) -> dict[str, list]:
            n = len(s.items)
            return {"slot": list(range(n)), "item": s.items, "cnt": s.counts, "err": s.errors, "total": [s.total] * n, "updates": [s.updates] * n}

        table = fold_groups(rows, keys, [f"__o{i}" for i in range(len(order))], ["__item", "__w"], lambda: _Counters(capacity), step, finish, f"slot int, item {kind}, cnt long, err long, total long, updates long")
        return cls(table, keys, capacity)

    @property
    def size_bytes(self) -> int:
        return self.capacity * 32 + 48

    def merge(self, *others):
        """Counters of different streams cannot be combined with the guarantee kept; see ``mergeable_top_k``."""
        raise MergeError("space-saving sketches do not merge")

    def roll_up(self, *keys: str):
        raise MergeError("space-saving sketches do not merge")

    def totals(self) -> DataFrame:
        return self.grouped().agg(F.count("*").alias("num_tracked"), F.coalesce(F.max("total"), F.lit(0)).alias("total_count"), F.coalesce(F.max("updates"), F.lit(0)).alias("n_updates"))

    def estimate(self, probes: DataFrame, item: str) -> DataFrame:
        """``probes`` with estimate, error, guaranteed_count (all 0 for untracked items) and tracked."""
        answer(probes, "estimate", "error", "guaranteed_count", "tracked")
        mine = self.table.select(*self.keys, F.col("item").alias(item), F.col("cnt").alias("__cnt"), F.col("err").alias("__err"))
        zero = F.lit(0).cast("long")
        got = match(probes, mine, [*self.keys, item], "left")
        return got.select(*probes.columns, F.coalesce("__cnt", zero).alias("estimate"), F.coalesce("__err", zero).alias("error"), F.coalesce(F.greatest(F.col("__cnt") - F.col("__err"), zero), zero).alias("guaranteed_count"), F.col("__cnt").isNotNull().alias("tracked"))

    def exceeding(self, probes: DataFrame, item: str, threshold: int) -> DataFrame:
        return self.estimate(probes, item).where(F.col("estimate") >= threshold)

    def heavy_hitters(self, threshold: float) -> DataFrame:
        """The items counted at least floor(threshold * total) times, in slot order."""
        return self.table.where(F.col("cnt") >= F.floor(F.lit(float(threshold)) * F.col("total"))).select(*self.keys, "slot", "item", "cnt", "err")

    def top_k(self, k: int) -> DataFrame:
        """(keys, rank, item, cnt, err): the k greatest counters, earlier slots first among equals."""
        if not self.keys:
            best = self.table.orderBy(F.desc("cnt"), "slot").limit(k)
        else:
            best = self.table
        order = Window.partitionBy(*self.keys).orderBy(F.desc("cnt"), "slot")  # at most ``capacity`` rows a key
        return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(*self.keys, "rank", "item", "cnt", "err")


def mergeable_top_k(df: DataFrame, item: str, k: int, by=None, counters: int = 10_000) -> DataFrame:
    """(keys, item, count): the engine's own top-k, whose states merge across partitions."""
    keys = key_names(by)
    got = df.groupBy(*keys).agg(F.expr(f"approx_top_k(`{item}`, {int(k)}, {int(counters)})").alias("t"))
    return got.select(*keys, F.explode("t").alias("t")).select(*keys, F.col("t.item").alias("item"), F.col("t.count").alias("count"))
