"""Canonical exact fingerprints: Unicode normalisation, case and white-space folding, XXH3-128, bytes compared in buckets.

Two texts have equal fingerprints exactly if their canonical forms are equal: wherever several documents share a
digest, the canonical bytes of all are compared (smallest against greatest of the bucket, an aggregate with partial
maxima and no gathered group), and a bucket that holds different bytes has SHA-256 added to its fingerprints.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import id_filter, materialize, shuffle_width, table, text_slices, tidy, with_bit

ROWS_CHARS = 128 << 20


def canonical(text: str) -> bytes:
    """NFKC, full case folding, NFKC again (folding can undo it), runs of white space as one space, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def marks(docs: DataFrame) -> DataFrame:
    """(id, n_chars, digest) of rows (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            values = texts.to_pylist()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in values], pa.int64()), pa.array([digest(canonical(t)) for t in values], pa.string())], ["id", "n_chars", "digest"])

    return docs.mapInArrow(tidy(run), "id long, n_chars long, digest string")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the next row by id (rows of equal id in the order of their compressed bytes), after the last the first. Likeness of exact fingerprints is 1
    where canonical bytes are equal and 0 elsewhere. Null texts are empty (the empty form has a fingerprint too);
    rows without an id are left out (ids must be whole numbers); repeated ids are rows each; an empty table gives an
    empty one. Edited forms are compared with their own document's bytes, not with those of other documents.

    Documents are dealt out by ranges of ids, compressed, with a copy of the first document of the next range; a
    task then streams its range in order and holds two documents at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    known = materialize(marks(rows), "marks")
    total = known.agg(F.sum("n_chars").alias("c"), F.count("*").alias("n"), F.min("id").alias("low")).first()
    shared = materialize(known.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "shared")
    parts = max(shuffle_width(spark), int((total["c"] or 0) // ROWS_CHARS))
    cuts = np.unique(np.array(known.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts) if total["n"] else [], np.int64))  # bounded by the number of parts
    n_parts = len(cuts) + 1

    def range_no(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, batch.column(0).to_numpy(), side="right").astype(np.int32)), batch.column(0)], ["p", "id"])

    firsts = {r["p"]: r["id"] for r in known.select("id").mapInArrow(tidy(range_no), "p int, id long").groupBy("p").agg(F.min("id").alias("id")).collect()}
    full = sorted(firsts)
    before = {firsts[p]: full[i - 1] for i, p in enumerate(full)}  # the first id of a range is also sent to the range before; the lowest to the last

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for rows_, texts in text_slices(batches):
            ids = rows_.column(0).to_numpy()
            part = np.searchsorted(cuts, ids, side="right").astype(np.int32)
            packed = pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.binary())
            tail = np.flatnonzero(np.isin(ids, list(before)))
            take = pa.array(np.concatenate([np.arange(len(ids)), tail]))
            where = np.concatenate([part, [before[x] for x in ids[tail].tolist()]]).astype(np.int32)
            kind = np.concatenate([np.ones(len(ids)), np.full(len(tail), 2)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(kind == 2), rows_.column(0).take(take), pa.array(kind), pa.nulls(len(take), pa.string()), packed.take(take)], ["p", "last", "id", "kind", "digest", "packed"])

    def flag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            part = np.searchsorted(cuts, batch.column(0).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(n, bool)), batch.column(0), pa.array(np.zeros(n, np.int32)), batch.column(1), pa.nulls(n, pa.binary())], ["p", "last", "id", "kind", "digest", "packed"])

    schema = "p int, last boolean, id long, kind int, digest string, packed binary"
    # a digest whose bit is set by another one only has its bytes compared in vain
    several = with_bit(known.select("id", "digest"), id_filter(shared, "digest", "string"), "digest", keep=True, kind="string").mapInArrow(tidy(flag), schema)
    dealt = rows.mapInArrow(tidy(deal), schema).union(several).repartitionById(n_parts, "p").sortWithinPartitions("p", "last", "id", "kind", "packed")
    names = ["id", "n_chars", "edited_sha256", "digest", "edited_digest", "sha", "edited_sha", "near_edited", "near_next", "canon"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64(), pa.binary()]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        held: tuple | None = None
        multi: dict[int, set[str]] = {}
        sent: dict[str, bytes] = {}  # of this range: a digest of several documents, with the canonical form (as SHA-512)
        out: list[tuple] = []
        now = None

        def emit(following: str, following_canon: bytes) -> None:
            id_, text, canon = held
            new = edited(text, following)
            new_canon = canonical(new)
            mark, payload = digest(canon), None
            if mark in multi.get(id_, ()):
                form = hashlib.sha512(canon).digest()
                if sent.get(mark) != form:
                    sent[mark], payload = form, press.compress(canon)
            out.append((id_, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, digest(new_canon), hashlib.sha256(canon).hexdigest(), hashlib.sha256(new_canon).hexdigest(), float(new_canon == canon), float(following_canon == canon), payload))

        for batch in batches:
            for p, last, id_, kind, mark, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != now:
                    now, held = p, None
                    multi.clear()
                    sent.clear()
                if kind == 0:
                    multi.setdefault(id_, set()).add(mark)
                    continue
                if last and held is None:
                    continue  # further rows of the next range's first id
                text = unpack.decompress(packed).decode("utf-8", "surrogatepass") if packed else ""
                canon = canonical(text)
                if held is not None:
                    emit(text, canon)
                    if held[0] != id_:
                        multi.pop(held[0], None)
                held = None if last else (id_, text, canon)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    got = materialize(dealt.mapInArrow(tidy(stream), "id long, n_chars long, edited_sha256 string, digest string, edited_digest string, sha string, edited_sha string, near_edited double, near_next double, canon binary"), "fingerprints")
    # equal compressed forms are equal texts; forms that differ are compared by the digests of what they hold
    clash = got.where(F.col("canon").isNotNull()).groupBy("digest").agg(F.min("canon").alias("a"), F.max("canon").alias("b"), F.min("sha").alias("c"), F.max("sha").alias("d")).where("a != b and c != d").select("digest")
    out = got
    if not clash.isEmpty():
        for mark, sha in (("digest", "sha"), ("edited_digest", "edited_sha")):
            out = out.join(clash.select(F.col("digest").alias(mark), F.lit(True).alias("clash")), mark, "left").withColumn(mark, F.when(F.col("clash"), F.concat(mark, F.lit("-"), sha)).otherwise(F.col(mark))).drop("clash")
    return out.select("id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")


def op5(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
