"""Sketches as parquet: saved with their parameters, checked when they are read."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.operators.cardinality import HIGHEST, LOWEST, HyperLogLog
from rillmark.operators.core import DecodeError, Sketch
from rillmark.operators.frequency import CountMin
from rillmark.operators.heavy_hitters import SpaceSaving
from rillmark.operators.membership import BloomFilter
from rillmark.operators.moments import Moments
from rillmark.operators.quantiles import TDigest
from rillmark.operators.sampling import Reservoir

KINDS = {c.KIND: c for c in (HyperLogLog, CountMin, SpaceSaving, TDigest, BloomFilter, Reservoir, Moments)}
VERSION = 1


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="rillmark-")


def save(sketch: Sketch, path: str) -> None:
    """Writes ``path``/table and ``path``/parameters."""
    spark = sketch.table.sparkSession
    record = json.dumps({"version": VERSION, "kind": sketch.KIND, "keys": sketch.keys, "parameters": sketch.parameters()})
    sketch.table.write.mode("overwrite").parquet(f"{path}/table")
    spark.createDataFrame([(record,)], "record string").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")


def _faults(sketch: Sketch) -> DataFrame | None:
    """The rows that a sketch of these parameters cannot hold."""
    t = sketch.table
    if isinstance(sketch, HyperLogLog):
        if not LOWEST <= sketch.precision <= HIGHEST:
            raise DecodeError("precision out of range")
        return t.where(~(F.col("idx").between(0, sketch.registers - 1) & F.col("rho").between(1, 65 - sketch.precision)))
    if isinstance(sketch, CountMin):
        return t.where(~(F.col("row").between(0, sketch.depth - 1) & F.col("col").between(0, sketch.width - 1) & (F.col("cnt") >= 0)))
    if isinstance(sketch, BloomFilter):
        return t.where(~F.col("word").between(0, sketch.num_bits // 64 - 1))
    if isinstance(sketch, TDigest):
        return t.where((F.col("weight") <= 0) | F.isnan("mean") | (F.col("low") > F.col("high")))
    if isinstance(sketch, SpaceSaving):
        return t.where(~F.col("slot").between(0, sketch.capacity - 1) | (F.col("err") > F.col("cnt")))
    if isinstance(sketch, Moments):
        return t.where((F.col("n") < 0) | (F.col("m2") < 0))
    return None


def load(spark: SparkSession, path: str, validate: bool = True) -> Sketch:
    """Reads a sketch; DecodeError if the record is not one, or if rows lie outside what the parameters allow."""
    try:
        record = json.loads(spark.read.parquet(f"{path}/parameters").first()["record"])
        kind, keys, parameters = KINDS[record["kind"]], tuple(record["keys"]), record["parameters"]
    except (KeyError, TypeError, ValueError) as e:
        raise DecodeError(f"{path} holds no sketch") from e
    if record.get("version") != VERSION:
        raise DecodeError(f"version {record.get('version')} is not known")
    sketch = kind(spark.read.parquet(f"{path}/table"), keys, **parameters)
    if validate:
        bad = _faults(sketch)
        if bad is not None and not bad.isEmpty():
            raise DecodeError(f"{path}: rows outside the sketch's bounds")
    return sketch
