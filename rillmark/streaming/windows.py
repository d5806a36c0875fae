"""Sketches over event-time windows of a stream: the same aggregates, kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rillmark.functions.hashing import bucket, hash64, leading_rank
from rillmark.operators.core import as_column, key_names


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """``df`` with the column as a timestamp (files often hold it without a time zone) and a watermark on it."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def _windowed(df: DataFrame, time: str, window: str, slide: str | None, keys: tuple[str, ...], **columns: Column) -> DataFrame:
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return df.select(w.alias("w"), *keys, *[c.alias(n) for n, c in columns.items()])


def hyperloglog(df: DataFrame, item: str | Column, time: str, window: str, precision: int = 12, by=None, slide: str | None = None, hash: str = "portable") -> DataFrame:
    """(window_start, keys, idx, rho, n): registers per window. Sliding windows share nothing; panes merge by max."""
    keys = key_names(by)
    h = hash64(as_column(item), hash)
    rows = _windowed(df, time, window, slide, keys, h=h).where("h is not null")
    out = rows.groupBy("w", *keys, F.shiftrightunsigned("h", 64 - precision).cast("int").alias("idx")).agg(F.max(leading_rank(F.col("h"), precision)).alias("rho"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "idx", "rho", "n")


def count_min(df: DataFrame, item: str | Column, time: str, window: str, width: int, depth: int, by=None, slide: str | None = None, hash: str = "portable") -> DataFrame:
    """(window_start, keys, row, col, cnt): cells per window."""
    keys = key_names(by)
    places = F.array(*[F.struct(F.lit(r).alias("row"), bucket(as_column(item), r, width, hash).alias("col")) for r in range(depth)])
    rows = _windowed(df.where(as_column(item).isNotNull()), time, window, slide, keys, c=F.explode(places))
    out = rows.groupBy("w", *keys, F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(F.count("*").alias("cnt"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "row", "col", "cnt")


def bloom(df: DataFrame, item: str | Column, time: str, window: str, num_bits: int, num_hashes: int, by=None, hash: str = "portable") -> DataFrame:
    """(window_start, keys, word, bits): words per window."""
    keys = key_names(by)
    spots = F.array(*[bucket(as_column(item), r, num_bits, hash) for r in range(num_hashes)])
    rows = _windowed(df.where(as_column(item).isNotNull()), time, window, None, keys, b=F.explode(spots))
    out = rows.groupBy("w", *keys, (F.col("b") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "word", "bits")


def moments(df: DataFrame, value: str, time: str, window: str, by=None, session_gap: str | None = None) -> DataFrame:
    """(window_start, keys, n, mean, variance, min, max) per tumbling or, with a gap, session window (these need keys)."""
    keys = key_names(by)
    if session_gap and not keys:
        raise ValueError("session windows need keys")
    w = F.session_window(time, session_gap) if session_gap else F.window(time, window)
    v = F.when(~F.isnan(value), F.col(value))
    out = df.groupBy(w.alias("w"), *keys).agg(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "mean", "variance", "min", "max")


class SpaceSavingProcessor(StatefulProcessor):
    """Space-Saving counters as keyed state, in order of arrival; emits the counters after each batch of a key."""

    def __init__(self, capacity: int, item: str = "item"):
        self.capacity, self.item = capacity, item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counters", "items array<string>, counts array<long>, errors array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        from rillmark.operators.heavy_hitters import _Counters

        c = _Counters(self.capacity)
        if self.state.exists():
            items, counts, errors = self.state.get()
            c.items, c.counts, c.errors = list(items), list(counts), list(errors)
            c.slot = {x: i for i, x in enumerate(c.items)}
        for part in rows:
            for value in part[self.item]:
                if value is not None:
                    c.add(str(value), 1)
        self.state.update((c.items, c.counts, c.errors))
        yield pd.DataFrame({"key": [str(key[0])] * len(c.items), "slot": range(len(c.items)), "item": c.items, "cnt": c.counts, "err": c.errors})

    def close(self) -> None:
        pass


def space_saving(df: DataFrame, item: str, by: str, capacity: int) -> DataFrame:
    """(key, slot, item, cnt, err): keyed counters updated with every micro-batch (output mode update)."""
    return df.select(F.col(by).cast("string").alias("key"), F.col(item).cast("string").alias("item")).groupBy("key").transformWithStateInPandas(
        SpaceSavingProcessor(capacity), outputStructType="key string, slot int, item string, cnt long, err long", outputMode="update", timeMode="None"
    )
