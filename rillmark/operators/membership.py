"""Bloom filter: approximate membership without false negatives."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.hashing import bucket, check_kind
from rillmark.operators.core import BROADCAST_BYTES, Sketch, answer, as_column, dense, key_names, match, positive

MOST_HASHES = 32


@dataclass(frozen=True)
class BloomFilter(Sketch):
    """Rows (keys, word, bits, n): the non-zero 64-bit words; n sums, over all words, to the number of inserts."""

    num_bits: int
    num_hashes: int
    hash: str

    KIND = "bloom"
    COLUMNS = ("word", "bits", "n", "contains", "bits_set", "fpr", "estimated_count", "n_inserts")

    @staticmethod
    def parameters_for(expected: int, fpr: float) -> tuple[int, int]:
        """(bits, hashes): the number of hashes comes from the bits before they are rounded up to whole words."""
        positive(expected=expected)
        if not 0 < fpr < 1:
            raise ValueError("fpr must be in (0, 1)")
        bits = max(64, math.ceil(-expected * math.log(fpr) / math.log(2) ** 2))
        return -(-bits // 64) * 64, min(max(math.ceil(bits / expected * math.log(2)), 1), MOST_HASHES)

    @classmethod
    def build(cls, df: DataFrame, item: str | Column, num_bits: int, num_hashes: int, by=None, hash: str = "portable") -> BloomFilter:
        """Inserting twice changes nothing, so items are made distinct before they are hashed. Null items are none."""
        positive(num_bits=num_bits, num_hashes=num_hashes)
        check_kind(hash)
        num_bits = -(-num_bits // 64) * 64
        keys = key_names(by, cls.COLUMNS)
        rows = df.select(*keys, as_column(item).alias("__i")).where(F.col("__i").isNotNull()).groupBy(*keys, "__i").agg(F.count("*").alias("__n"))
        spots = rows.select(*keys, F.posexplode(_spots(F.col("__i"), num_bits, num_hashes, hash)).alias("__h", "__b"), "__n")
        bit = F.expr("shiftleft(1L, cast(__b % 64 as int))")
        table = spots.groupBy(*keys, (F.col("__b") / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"), F.sum(F.when(F.col("__h") == 0, F.col("__n")).otherwise(0)).alias("n"))
        return cls(table, keys, num_bits, num_hashes, hash)

    @classmethod
    def for_items(cls, df: DataFrame, item: str | Column, expected: int, fpr: float, **options) -> BloomFilter:
        return cls.build(df, item, *cls.parameters_for(expected, fpr), **options)

    @property
    def size_bytes(self) -> int:
        return self.num_bits // 8 + self.num_hashes * 8 + 32

    def _combine(self, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return table.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))

    def contains(self, probes: DataFrame, item: str) -> DataFrame:
        """``probes`` with ``contains``: false only for items that were never inserted. Null items give null; null
        keys are keys. A filter without keys and of at most BROADCAST_BYTES goes to the probes as one row, and they are
        not shuffled; else distinct probes are looked up in a join."""
        answer(probes, "contains")
        if not self.keys and self.num_bits // 8 <= BROADCAST_BYTES:
            words = dense(self.table, F.col("word"), F.col("bits"), self.num_bits // 64)
            spots = [bucket(F.col(item), r, self.num_bits, self.hash) for r in range(self.num_hashes)]
            held = [F.getbit(F.element_at("__cells", (F.shiftright(b, 6) + 1).cast("int")), b.bitwiseAND(63).cast("int")) == 1 for b in spots]
            return probes.crossJoin(F.broadcast(words)).select(*probes.columns, F.when(F.col(item).isNotNull(), reduce(lambda x, y: x & y, held)).alias("contains"))
        unique = probes.select(*self.keys, item).where(F.col(item).isNotNull()).distinct()
        spots = unique.select(*self.keys, F.col(item).alias("__i"), F.explode(_spots(F.col(item), self.num_bits, self.num_hashes, self.hash)).alias("__b")).withColumn("__word", F.shiftright("__b", 6))
        got = match(spots, self.table.select(*self.keys, F.col("word").alias("__word"), F.col("bits").alias("__bits")), [*self.keys, "__word"], "left")
        set_ = F.coalesce(F.expr("shiftrightunsigned(__bits, cast(__b % 64 as int)) & 1L") == 1, F.lit(False))
        found = got.groupBy(*self.keys, "__i").agg(F.bool_and(set_).alias("__in")).withColumnRenamed("__i", item)
        out = match(probes, found, [*self.keys, item], "left")
        # every item of a key that has no filter is surely absent
        return out.withColumn("contains", F.when(F.col(item).isNotNull(), F.coalesce("__in", F.lit(False)))).drop("__in")

    def semi_join(self, probes: DataFrame, item: str) -> DataFrame:
        """The rows that may have a partner: an approximate semi-join."""
        return self.contains(probes, item).where("contains").drop("contains")

    def anti_join(self, probes: DataFrame, item: str) -> DataFrame:
        """Rows that surely have no partner (some such rows are missing)."""
        return self.contains(probes, item).where("not contains").drop("contains")

    def stats(self) -> DataFrame:
        """(keys, bits_set, fpr, estimated_count, n_inserts); a full filter estimates infinity."""
        got = self.grouped().agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("bits_set"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_inserts"))
        share = F.col("bits_set") / F.lit(float(self.num_bits))
        count = F.when(F.col("bits_set") >= self.num_bits, F.lit(float("inf"))).otherwise(-F.lit(self.num_bits / self.num_hashes) * F.log1p(-share))
        return got.select(*self.keys, "bits_set", F.pow(share, F.lit(float(self.num_hashes))).alias("fpr"), count.alias("estimated_count"), "n_inserts")


def _spots(item: Column, num_bits: int, num_hashes: int, hash: str) -> Column:
    return F.array(*[bucket(item, r, num_bits, hash) for r in range(num_hashes)])
