"""What all sketches have in common: a parameter record on the driver and a DataFrame with one row per part."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce
from typing import Self

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MergeError(ValueError):
    """Two sketches cannot be merged: their parameters differ, or the kind does not merge."""


class DecodeError(ValueError):
    """A stored sketch does not hold what its parameters call for."""


@dataclass(frozen=True)
class Sketch:
    """``table``: the sketch's rows, with the columns ``keys`` first; one sketch for each combination of keys.

    All rows of an update are planned as ordinary grouped aggregates, so a sketch is built where the data is, merged
    by union and re-aggregation, stored as parquet, and rolled up to coarser keys without the data.
    """

    table: DataFrame
    keys: tuple[str, ...]

    KIND = "sketch"
    #: Columns that a sketch and its answers have, so that no key can be called so.
    COLUMNS = ()

    def parameters(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("table", "keys")}

    def _check(self, other: Sketch) -> None:
        if type(other) is not type(self) or other.parameters() != self.parameters() or other.keys != self.keys:
            raise MergeError(f"{self.KIND}: {self.parameters()} with keys {self.keys} and {getattr(other, 'parameters', dict)()} with keys {getattr(other, 'keys', ())} do not merge")

    def _combine(self, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        raise NotImplementedError

    def merge(self, *others: Self) -> Self:
        """All rows of all sketches, aggregated once."""
        for other in others:
            self._check(other)
        return replace(self, table=self._combine(reduce(DataFrame.unionByName, [o.table for o in others], self.table), self.keys))

    def roll_up(self, *keys: str) -> Self:
        """The sketches of coarser keys, from these sketches alone."""
        if not set(keys) <= set(self.keys):
            raise ValueError(f"{keys} are not among {self.keys}")
        return replace(self, table=self._combine(self.table, keys), keys=keys)

    def clear(self) -> Self:
        return replace(self, table=self.table.limit(0))

    def cache(self) -> Self:
        return replace(self, table=self.table.cache())

    def is_empty(self) -> bool:
        return self.table.isEmpty()

    def grouped(self, table: DataFrame | None = None):
        return (self.table if table is None else table).groupBy(*self.keys)


def key_names(by: Sequence[str] | str | None, taken: Sequence[str] = ()) -> tuple[str, ...]:
    """The names of key columns; those in ``taken`` are the sketch's own columns, and names with two underscores its helpers'."""
    keys = (by,) if isinstance(by, str) else tuple(by or ())
    for k in keys:
        if k.lower() in taken or k.startswith("__"):
            raise ValueError(f"a key cannot be called {k!r}: the sketch has a column of that name; rename the key")
    return keys


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where all keys are equal; a null key equals a null key."""
    named = right.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    if not keys:
        return left.crossJoin(F.broadcast(named))  # only for a right side of one row
    on = [left[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(keys)]
    return left.join(named, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def answer(probes: DataFrame, *names: str) -> DataFrame:
    """``probes``, unless it has columns of these names already."""
    taken = {c.lower() for c in probes.columns} & set(names)
    if taken:
        raise ValueError(f"the probes have a column {sorted(taken)[0]!r}, as the answer has; rename it")
    return probes


#: Sketches without keys of up to so many bytes are sent to the probes as one row; larger ones are joined.
BROADCAST_BYTES = 8 << 20


def dense(table: DataFrame, at: Column, value: Column, size: int) -> DataFrame:
    """One row (__cells): an array of ``size`` numbers, those of the table at their places and zeros elsewhere."""
    every = table.sparkSession.range(size).join(table.select(at.cast("long").alias("__at"), value.alias("__v")), F.col("id") == F.col("__at"), "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("__v", F.lit(0)).alias("v")))).alias("__c"))
    return row.select(F.transform("__c", lambda x: x["v"]).alias("__cells"))


def as_column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def saturating_sum(column: Column) -> Column:
    """A sum of non-negative longs that stays at the greatest long instead of overflowing."""
    return F.coalesce(F.try_sum(column), F.when(F.count(column) > 0, F.lit(2**63 - 1)))


def positive(**values: int) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")
