"""HyperLogLog: distinct counts from the greatest leading-zero rank of each register."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.bounds import error_bounds, z_score
from rillmark.functions.hashing import check_kind, hash64, leading_rank
from rillmark.operators.core import Sketch, as_column, key_names

LOWEST, HIGHEST = 4, 18


def precision_for_error(error: float) -> int:
    """The least precision whose standard error is at most ``error``, within 4..18."""
    if not error > 0:
        raise ValueError("error must be positive")
    return min(max(math.ceil(math.log2((1.04 / error) ** 2)), LOWEST), HIGHEST)


def error_for_precision(precision: int) -> float:
    return 1.04 / math.sqrt(2**precision)


def memory_for_precision(precision: int) -> int:
    return 2**precision


def bias(registers: int) -> float:
    # Fixed values of the published estimator.
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(registers, 0.7213 / (1 + 1.079 / registers))


@dataclass(frozen=True)
class HyperLogLog(Sketch):
    """Rows (keys, idx, rho, n): the non-zero registers, with the number of inserts that met each."""

    precision: int
    hash: str

    KIND = "hyperloglog"
    COLUMNS = ("idx", "rho", "n", "estimate", "bounds", "n_inserts")

    @classmethod
    def build(cls, df: DataFrame, item: str | Column, precision: int = 14, by=None, hash: str = "portable") -> HyperLogLog:
        """Nulls are no items. hash="precomputed" takes the item itself as 64 hash bits."""
        if not LOWEST <= precision <= HIGHEST:
            raise ValueError(f"precision must be in {LOWEST}..{HIGHEST}")
        keys = key_names(by, cls.COLUMNS)
        hashed = df.select(*keys, hash64(as_column(item), check_kind(hash)).alias("__h")).where(F.col("__h").isNotNull())
        placed = hashed.select(*keys, F.shiftrightunsigned("__h", 64 - precision).cast("int").alias("idx"), leading_rank(F.col("__h"), precision).alias("rho"))
        return cls(placed.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"), F.count("*").alias("n")), keys, precision, hash)

    @classmethod
    def with_error(cls, df: DataFrame, item: str | Column, error: float, **options) -> HyperLogLog:
        return cls.build(df, item, precision_for_error(error), **options)

    @property
    def registers(self) -> int:
        return 2**self.precision

    @property
    def relative_error(self) -> float:
        return error_for_precision(self.precision)

    @property
    def size_bytes(self) -> int:
        return self.registers + 16

    def _combine(self, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return table.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"), F.sum("n").alias("n"))

    def estimate(self, confidence: float = 0.95) -> DataFrame:
        """(keys, estimate, bounds, n_inserts). Registers without a row count as zero; small counts by linear counting."""
        m = float(self.registers)
        found = self.grouped().agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("__s"), F.count("*").alias("__k"), F.sum("n").alias("__n"))
        raw = F.lit(bias(self.registers) * m * m) / (F.coalesce("__s", F.lit(0.0)) + m - F.col("__k"))
        zeros = F.lit(m) - F.col("__k")
        linear = F.lit(m) * F.log(F.lit(m) / zeros)
        limit = 2.5 * m
        value = F.when(F.col("__k") == 0, 0.0).when((raw <= limit) & (zeros > 0), F.when(linear <= limit, linear).otherwise(raw)).otherwise(raw)
        out = found.select(*self.keys, value.alias("estimate"), F.coalesce("__n", F.lit(0)).alias("n_inserts"))
        return out.withColumn("bounds", error_bounds(F.col("estimate"), F.col("estimate") * z_score(confidence) * self.relative_error, confidence))


def builtin_distinct(df: DataFrame, item: str, by=None, error: float = 0.05) -> DataFrame:
    """The engine's own estimator, for errors of 1 % or more (it slows sharply below)."""
    if not 0.01 <= error < 0.4:
        raise ValueError("error must be in 0.01..0.4")
    return df.groupBy(*key_names(by)).agg(F.approx_count_distinct(item, error).alias("estimate"))


def builtin_hll(df: DataFrame, item: str, by=None, log_k: int = 14) -> DataFrame:
    """(keys, sketch): the engine's own binary sketch (4 to 21 bits of registers), which ``builtin_hll_union`` merges."""
    return df.groupBy(*key_names(by)).agg(F.hll_sketch_agg(item, log_k).alias("sketch"))


def builtin_hll_union(sketches: DataFrame, by=None) -> DataFrame:
    """(keys, estimate): the binary sketches of each key merged and estimated."""
    keys = key_names(by)
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch")).select(*keys, F.hll_sketch_estimate("sketch").alias("estimate"))
