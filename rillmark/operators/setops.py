"""Set operations on distinct items: the engine's theta sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.operators.core import as_column, key_names


def theta_sketches(df: DataFrame, item: str | Column, by=None, log_entries: int = 14) -> DataFrame:
    """(keys, sketch): a mergeable binary sketch per key, exact up to about 2**log_entries items."""
    return df.groupBy(*key_names(by)).agg(F.theta_sketch_agg(as_column(item), log_entries).alias("sketch"))


def compare(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` of sketches with the estimated sizes of union, intersection and difference (a less b), and jaccard."""
    union, both, less = (F.theta_sketch_estimate(x).cast("double") for x in (F.theta_union(a, b), F.theta_intersection(a, b), F.theta_difference(a, b)))
    out = pairs.withColumns({"union_size": union, "intersection_size": both, "difference_size": less}).drop(a, b)
    return out.withColumn("jaccard", F.when(F.col("union_size") > 0, F.col("intersection_size") / F.col("union_size")).otherwise(0.0))
