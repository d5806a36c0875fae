"""Estimates with intervals: struct(lower, estimate, upper, confidence)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard score used from each confidence level on.
Z_SCORES = ((0.99, 2.576), (0.95, 1.96), (0.90, 1.645), (0.80, 1.282))


def z_score(confidence: float) -> float:
    return next((z for level, z in Z_SCORES if confidence >= level), 1.0)


def error_bounds(estimate: Column, margin: Column, confidence: float) -> Column:
    """The interval estimate -+ margin, its lower end not below zero."""
    lower = F.greatest(estimate - margin, F.lit(0.0))
    return F.struct(lower.alias("lower"), estimate.alias("estimate"), (estimate + margin).alias("upper"), F.lit(float(confidence)).alias("confidence"))


def contains(bounds: Column, value: Column) -> Column:
    return (value >= bounds["lower"]) & (value <= bounds["upper"])


def width(bounds: Column) -> Column:
    return bounds["upper"] - bounds["lower"]


def relative_width(bounds: Column) -> Column:
    """Width over estimate; zero where the estimate is zero."""
    return F.when(bounds["estimate"] == 0, 0.0).otherwise(width(bounds) / bounds["estimate"])
