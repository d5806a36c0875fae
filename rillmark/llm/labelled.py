"""Bounded samples of labelled rows for fitting, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def training_rows(labels: DataFrame, label_col: str, id_col: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(id, y): at most ``rows`` labelled rows outside the held-out fold, those of smallest id hash.

    Rows without an id or label are left out; of several labels of one id the largest counts.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    usable = usable.where(fold("id", folds) != held_out).groupBy("id").agg(F.max("y").alias("y"))
    return usable.orderBy(F.xxhash64("id"), "id").limit(rows)
