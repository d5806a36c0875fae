"""Shared pieces of the training-data operators: inputs, scratch tables, text batches and words.

Text operators run inside ``mapInArrow``: a batch of rows arrives as Arrow, is cut into slices of a
few megabytes (so memory does not depend on how long single texts are), and the bytes of a slice are
handled with numpy as one array.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 20
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; an own one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rillmark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, survives lost executors. The table
    is deleted by ``discard``, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/rillmark/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out._rillmark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing needs any more."""
    path = getattr(df, "_rillmark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gets batches of bounded size and leaves its worker's memory to the system.

    Workers live on after a task and would keep what they have freed; and a batch is else bounded by rows alone."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > SLICE_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{SLICE_BYTES}b")

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def _bytes(setting: str) -> int:
    digits = setting.strip().lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(digits[-1:], 1)
    return int(digits.rstrip("kmg") or 0) * unit


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or a longer one if a column is already called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_filter(ids: DataFrame, column: str, kind: str = "long") -> np.ndarray:
    """A bit table (1 to 32 MB, sixteen bits an id while they suffice) in which every id of the column has its bit; others
    are mostly without. Beyond 17 million ids more rows that need not move do so."""
    count = ids.agg(F.approx_count_distinct(column)).first()[0]
    size = min(max(1 << (16 * count).bit_length(), LEAST_BITS), MOST_BITS)
    bit = F.pmod(F.xxhash64(F.col(column).cast(kind)), F.lit(size))
    words = ids.select(bit.alias("b")).groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def id_bit(bits: np.ndarray, id_col: str = "id", kind: str = "long") -> Column:
    """An id's place in the bit table."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(id_col).cast(kind)), F.lit(len(bits) * 64)), F.lit(0))


def with_bit(rows: DataFrame, bits: np.ndarray, id_col: str, keep: bool, kind: str = "long") -> DataFrame:
    """The rows whose id has its bit (or has not)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            some = pa.array((((bits[at // 64] >> (at % 64)) & 1) == 1) == keep)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(some)

    return rows.withColumn(free_name(rows.columns, "bit"), id_bit(bits, id_col, kind)).mapInArrow(tidy(run), schema)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches holding about ``limit`` bytes of text each (one row at least), null texts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        offsets = offsets_of(texts)
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), len(texts))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins (with the end as last)."""
    offsets = offsets_of(texts)
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Words:
    """The words (runs without ASCII white space) of a slice of texts, A-Z in lower case unless told otherwise.
    ``between``: the bytes that stand between words.

    ``data``: the words' bytes with one space after each; word i is data[start[i]:start[i]+length[i]].
    ``first``: index of each text's first word, with the number of words as last.
    ``begin``: where each word begins in its own text, in bytes.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, between: np.ndarray = SPACE):
        raw, at = bytes_of(texts)
        solid = ~between[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        opens, closes = solid.copy(), solid.copy()
        if len(raw):
            opens[1:] &= ~solid[:-1] | edge[1:-1]
            closes[:-1] &= ~solid[1:] | edge[1:-1]
        opened = np.flatnonzero(opens)
        self.length = np.flatnonzero(closes) + 1 - opened
        self.first = np.searchsorted(opened, at)
        count = len(opened)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.begin = opened - at[self.text] if count else opened
        self.start = np.cumsum(self.length + 1) - (self.length + 1)
        self.data = np.full(int(self.length.sum()) + count, 32, np.uint8)
        if count:
            filled = np.ones(len(self.data), bool)
            filled[self.start + self.length] = False
            self.data[filled] = LOWER[raw[solid]] if lower else raw[solid]

    def __len__(self) -> int:
        return len(self.start)

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """The number of each word in the list of distinct words, and that list."""
        at = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int32)
        solid = np.ones(len(self.data), bool)
        solid[self.start + self.length] = False
        words = pa.StringArray.from_buffers(len(self), pa.py_buffer(at), pa.py_buffer(self.data[solid])).dictionary_encode()
        return words.indices.to_numpy(zero_copy_only=False), words.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of a polynomial over its bytes."""
        out = np.zeros(len(self), np.uint64)
        low = 0
        while low < len(self):  # block by block, so that the powers stay few
            base = self.start[low]
            high = max(int(np.searchsorted(self.start, base + HASH_BYTES)), low + 1)
            start, length = self.start[low:high] - base, self.length[low:high]
            data = self.data[base : base + start[-1] + length[-1]]
            up, down = powers(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_CODES[data] * up[: len(data)], out=total[1:])
            out[low:high] = mix((total[start + length] - total[start]) * down[start] + length.astype(np.uint64))
            low = high
        return out


BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 2**64)
        size = max(n, HASH_BYTES)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(x), np.uint64)])) for x in (base, inverse)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), then the same for the next start."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label
