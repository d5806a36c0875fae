"""Mergeable stream summaries as ordinary Spark DataFrames."""

from rillmark.functions.bounds import contains, error_bounds, relative_width, width
from rillmark.operators.cardinality import HyperLogLog, error_for_precision, memory_for_precision, precision_for_error
from rillmark.operators.core import DecodeError, MergeError, Sketch
from rillmark.operators.families import CardinalitySketch, FrequencySketch, HeavyHitters, MembershipSketch, QuantileSketch, SamplingSketch
from rillmark.operators.frequency import CountMin
from rillmark.operators.heavy_hitters import SpaceSaving
from rillmark.operators.membership import BloomFilter
from rillmark.operators.moments import Moments
from rillmark.operators.quantiles import TDigest
from rillmark.operators.sampling import Reservoir
from rillmark.sources.store import load, save

__all__ = ["BloomFilter", "CardinalitySketch", "CountMin", "DecodeError", "FrequencySketch", "HeavyHitters", "HyperLogLog", "MembershipSketch", "MergeError", "Moments", "QuantileSketch", "Reservoir", "SamplingSketch", "Sketch", "SpaceSaving", "TDigest", "contains", "error_bounds", "error_for_precision", "load", "memory_for_precision", "precision_for_error", "relative_width", "save", "width"]
