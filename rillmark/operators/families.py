"""What the sketches of a family can answer, whatever their kind: checked with ``isinstance``."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class CardinalitySketch(Protocol):
    """How many different items there are."""

    relative_error: float

    def estimate(self, confidence: float = 0.95) -> DataFrame: ...


@runtime_checkable
class FrequencySketch(Protocol):
    """How often items occur."""

    def estimate(self, probes: DataFrame, item: str) -> DataFrame: ...

    def exceeding(self, probes: DataFrame, item: str, threshold: int) -> DataFrame: ...

    def totals(self) -> DataFrame: ...


@runtime_checkable
class HeavyHitters(Protocol):
    """Which items occur most."""

    def heavy_hitters(self, threshold: float) -> DataFrame: ...

    def top_k(self, k: int) -> DataFrame: ...


@runtime_checkable
class QuantileSketch(Protocol):
    """How values are distributed."""

    def quantiles(self, ranks: Sequence[float]) -> DataFrame: ...

    def ranks(self, values: Sequence[float]) -> DataFrame: ...

    def median(self) -> DataFrame: ...

    def extremes(self) -> DataFrame: ...


@runtime_checkable
class MembershipSketch(Protocol):
    """Whether items occur."""

    def contains(self, probes: DataFrame, item: str) -> DataFrame: ...

    def stats(self) -> DataFrame: ...


@runtime_checkable
class SamplingSketch(Protocol):
    """Which rows stand for all."""

    def sample(self) -> DataFrame: ...

    def items_seen(self) -> DataFrame: ...

    def sizes(self) -> DataFrame: ...

    def probability(self) -> DataFrame: ...
