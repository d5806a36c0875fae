"""Chat formatting over a prefix tree.

Turns are marked by a template whose control strings are escaped inside texts. Conversations that begin with the
same turns share these as nodes of a tree; nodes are emitted once, depth first, as one long sequence. Every node
has its place in that sequence, the position ids it starts from (its depth in characters within a conversation) and
the intervals of the sequence it may attend to: its ancestors and itself, with adjacent intervals merged.

Depth-first order is the order of conversations sorted by their paths (a path: the chained digests of its turns), so
it comes from one distributed sort; offsets come from two passes over the sorted partitions, and only the borders
between partitions meet on the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import materialize, shuffle_width, table, tidy

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|: ")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
KEY = 16  # bytes of a node's digest
LOSS_ROLE = "assistant"


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head = OPEN + escape(role, role=True) + COLON
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text."""
    out, at = [], 0
    mark = re.compile(r"\\(?:\\|###|</turn>|: )|: |</turn>\n")
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        at += len(OPEN)
        for until, m in ((m[0], m) for m in mark.finditer(formatted, at)):
            if until == COLON:
                role, at = unescape(formatted[at : m.start()]), m.end()
                break
        for until, m in ((m[0], m) for m in mark.finditer(formatted, at)):
            if until == CLOSE:
                out.append((role, unescape(formatted[at : m.start()])))
                at = m.end()
                break
        else:
            raise ValueError("a turn has no end")
    return out


def turns(rows: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, i, node, parent, body, loss_start, loss_end, path, lengths): formatted turns in order; the last turn
    of a conversation carries its path and the lengths along it. Streams: one turn is held at a time."""
    names = ["conv_id", "i", "node", "parent", "body", "loss_start", "loss_end", "path", "lengths"]
    schema = "conv_id long, i int, node binary, parent binary, body string, loss_start int, loss_end int, path binary, lengths array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, i, parent, path, lengths, held = None, 0, b"", bytearray(), [], None

        def close() -> list:
            return [*held, bytes(path), list(lengths)]

        for batch in batches:
            out: list[list] = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held is not None and c == conv:
                    out.append([*held, None, None])
                elif held is not None:
                    out.append(close())
                if held is None or c != conv:
                    conv, i, parent = c, 0, b""
                    path.clear()
                    lengths.clear()
                body, low, high = render(role, text)
                node = hashlib.sha256(parent + b"%d\n" % len(role.encode()) + role.encode() + text.encode()).digest()[:KEY]
                if role != loss_role:
                    low = high = 0
                held = [c, i, node, parent, body, low, high]
                path += node
                lengths.append(len(body))
                parent, i = node, i + 1
            if out:
                yield _batch(out, names)
        if held is not None:
            yield _batch([close()], names)

    def _batch(out: list[list], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    clean = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "turn")
    order = clean.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return order.select("conv_id", "role", "text").mapInArrow(tidy(run), schema)


def _shared(a: bytes, b: bytes) -> int:
    """How many nodes two paths have in common."""
    if a == b:
        return len(a) // KEY
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * KEY] == b[: mid * KEY] else (low, mid - 1)
    return low


class Walk:
    """Walks sorted paths; gives each new node its start in the sequence."""

    def __init__(self, cursor: int = 0, path: bytes = b"", starts: list[int] | None = None):
        self.cursor, self.path, self.starts, self.least = cursor, path, list(starts or []), None

    def step(self, path: bytes, lengths: list[int]) -> int:
        shared = _shared(self.path, path)
        del self.starts[shared:]
        for n in lengths[shared:]:
            self.starts.append(self.cursor)
            self.cursor += n
        self.least = len(lengths) if self.least is None else min(self.least, shared)
        self.path = path
        return shared


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[int]]]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)


@dataclass
class Forest:
    """``nodes``: (node, parent, start, position, n_chars, attention, body, loss_start, loss_end), the body at ``start``
    of the sequence; ``conversations``: (conv_id, n_turns, path, leaf)."""

    nodes: DataFrame
    conversations: DataFrame


def prefix_forest(rows: DataFrame, loss_role: str = LOSS_ROLE) -> Forest:
    """Formats all conversations (conv_id, turn, role, text) and merges what they begin with.

    Turns are ordered by turn (null first), role and text, so ties have one result; repeated rows are turns each.
    Null roles and texts are empty strings; rows without conv_id are left out; an empty table gives empty ones.
    """
    spark = rows.sparkSession
    width = shuffle_width(spark)
    all_turns = materialize(turns(rows, loss_role), "turns")
    convs = all_turns.where(F.col("path").isNotNull()).select("conv_id", (F.col("i") + 1).cast("long").alias("n_turns"), "path", F.col("node").alias("leaf"))
    distinct = all_turns.where(F.col("path").isNotNull()).groupBy("path").agg(F.first("lengths").alias("lengths"))
    paths = materialize(distinct.repartitionByRange(width, "path").sortWithinPartitions("path").withColumn("pid", F.spark_partition_id()).select("pid", "path", "lengths"), "paths")
    dealt = paths.repartition(width, "pid").sortWithinPartitions("pid", "path")

    def borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk, first = None, Walk(), None
        done = []
        for pid, path, lengths in _runs(batches):
            if pid != now:
                if now is not None:
                    done.append((now, *first, walk.path, walk.starts, walk.least, walk.cursor))
                now, walk, first = pid, Walk(), (path, lengths)
            walk.step(path, lengths)
        if now is not None:
            done.append((now, *first, walk.path, walk.starts, walk.least, walk.cursor))
            kinds = [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], ["pid", "first", "lengths", "last", "starts", "least", "total"])

    seen = dealt.mapInArrow(tidy(borders), "pid int, first binary, lengths array<int>, last binary, starts array<long>, least int, total long").collect()  # a row per partition
    begin: dict[int, tuple[int, bytes, list[int]]] = {}
    cursor, path, starts = 0, b"", []
    for r in sorted(seen, key=lambda r: r["pid"]):
        shared = _shared(path, bytes(r["first"]))
        begin[r["pid"]] = (cursor, path, list(starts))
        shift = cursor - sum(r["lengths"][:shared])
        kept = min(shared, r["least"])
        starts = starts[:kept] + [x + shift for x in r["starts"][kept:]]
        cursor, path = r["total"] + shift, bytes(r["last"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk, out = None, Walk(), []

        def flush() -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            got = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["node", "start", "position", "n_chars", "attention"])
            out.clear()
            return got

        for pid, path, lengths in _runs(batches):
            if pid != now:
                now, walk = pid, Walk(*begin[pid])
            shared = walk.step(path, lengths)
            spans: list[list[int]] = []
            position = 0
            for d, (start, n) in enumerate(zip(walk.starts, lengths, strict=True)):
                if spans and spans[-1][1] == start:
                    spans[-1][1] += n
                else:
                    spans.append([start, start + n])
                if d >= shared:
                    out.append((path[d * KEY : (d + 1) * KEY], start, position, n, [{"begin": a, "end": b} for a, b in spans]))
                position += n
            if len(out) >= 4096:
                yield flush()
        if out:
            yield flush()

    placed = dealt.mapInArrow(tidy(place), "node binary, start long, position long, n_chars long, attention array<struct<begin:long,end:long>>")
    bodies = all_turns.groupBy("node").agg(F.first(F.struct("parent", "body", "loss_start", "loss_end")).alias("b"))  # equal nodes have equal bodies
    nodes = placed.join(bodies, "node").select("node", "b.parent", "start", "position", "n_chars", "attention", "b.body", "b.loss_start", "b.loss_end")
    return Forest(materialize(nodes, "nodes"), convs)


def read_back(forest: Forest) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the forest's texts and masks."""
    steps = forest.conversations.select("conv_id", "path", F.explode(F.sequence(F.lit(0), F.col("n_turns").cast("int") - 1)).alias("i"))
    steps = steps.select("conv_id", "i", F.substring("path", F.col("i") * KEY + 1, F.lit(KEY)).alias("node"))
    got = steps.join(forest.nodes.select("node", "body", "loss_start", "loss_end"), "node").select("conv_id", "i", "body", "loss_start", "loss_end")
    got = got.repartition(shuffle_width(got.sparkSession), "conv_id").sortWithinPartitions("conv_id", "i")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, [], []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return rows

        def close() -> None:
            n, all_, chars, loss, total = state
            out.append((now, n, all_.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for conv, _, body, low, high in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if conv != now:
                    if now is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(body):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if high > low:
                    text = unescape(body[low:high])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(body)
            if out:
                yield flush()
        if now is not None:
            close()
            yield flush()

    return got.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "\\### Assistant: </turn> ok"


def op2(spark, sf_dir):
    extra = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(prefix_forest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
