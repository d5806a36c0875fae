"""Hash columns: ``portable`` (from MD5, which other SQL engines can recompute) or ``fast`` (XXH64)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("portable", "fast", "precomputed")
#: The step between the seeds of a sketch's rows, modulo 2**64.
SEED_STEP = 0x9E3779B97F4A7C15


def check_kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"hash must be one of {KINDS}")
    return kind


def seed_of(row: int) -> int:
    """The seed of a sketch's row, as a signed 64-bit number."""
    seed = row * SEED_STEP % 2**64
    return seed - 2**64 if seed >= 2**63 else seed


def hash64(item: Column, kind: str = "portable") -> Column:
    """64 hash bits as a signed long; null for a null item."""
    if check_kind(kind) == "precomputed":
        return item.cast("long")
    if kind == "fast":
        return F.when(item.isNotNull(), F.xxhash64(item))
    return F.conv(F.substring(F.md5(item.cast("string").cast("binary")), 1, 16), 16, -10).cast("long")


def bucket(item: Column, row: int, width: int, kind: str = "portable") -> Column:
    """The place 0..width-1 of an item in a row of a sketch; rows hash independently."""
    if kind == "fast":
        return F.pmod(F.xxhash64(F.lit(seed_of(row)), item), F.lit(width).cast("long"))
    text = F.concat(F.lit(f"{row}:"), item.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(width).cast("long")


def leading_rank(hashed: Column, precision: int) -> Column:
    """1 + the number of leading zeros of the bits after the first ``precision``, at most 64 - precision + 1."""
    rest = F.shiftleft(hashed, precision)
    return F.when(rest < 0, 1).when(rest == 0, 64 - precision + 1).otherwise(F.lit(65) - F.length(F.bin(rest))).cast("int")
