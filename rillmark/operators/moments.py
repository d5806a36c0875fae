"""Running statistics: count, mean, variances, extremes and sum in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.operators.core import Sketch, as_column, key_names, match


@dataclass(frozen=True)
class Moments(Sketch):
    """Rows (keys, n, mean, m2, min, max): one per key."""

    KIND = "moments"
    COLUMNS = ("n", "mean", "m2", "min", "max", "variance", "sample_variance", "stddev", "sample_stddev", "range", "sum")

    @classmethod
    def build(cls, df: DataFrame, value: str | Column, by=None) -> Moments:
        """NaN and null are no values."""
        keys = key_names(by, cls.COLUMNS)
        v = as_column(value).cast("double")
        rows = df.select(*keys, F.when(~F.isnan(v), v).alias("__v"))
        v = F.col("__v")
        table = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"))
        return cls(table, keys)

    @property
    def size_bytes(self) -> int:
        return 40

    def _combine(self, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """Deviations from the common mean, not differences of large squares: the mean first, then the rest around it."""
        means = table.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("__m"))
        wide = match(table, means, keys)
        m2 = F.sum(F.when(F.col("n") > 0, F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("__m"), F.lit(2.0))))
        return wide.groupBy(*keys).agg(F.sum("n").alias("n"), F.first("__m").alias("mean"), m2.alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))

    def stats(self) -> DataFrame:
        """(keys, n, mean, variance, sample_variance, stddev, sample_stddev, min, max, range, sum). Without values the
        first six are 0 and so is the sum; min, max and range are null. Variance is the population's."""
        zero = F.lit(0.0)
        var = F.when(F.col("n") > 0, F.col("m2") / F.col("n")).otherwise(zero)
        sample = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).otherwise(zero)
        mean = F.coalesce("mean", zero)
        return self.table.select(
            *self.keys, F.coalesce("n", F.lit(0)).alias("n"), mean.alias("mean"), var.alias("variance"), sample.alias("sample_variance"), F.sqrt(var).alias("stddev"), F.sqrt(sample).alias("sample_stddev"),
            "min", "max", (F.col("max") - F.col("min")).alias("range"), (mean * F.coalesce("n", F.lit(0))).alias("sum"),
        )
