"""Best-fit packing of tokenised documents into sequences of a fixed length.

The number of pieces of each length (at most ``capacity`` numbers) is all that the driver sees. Lengths are grouped into
classes of nearly equal ones (at most CLASSES, each as long as its longest), and the configuration linear program is
posed over them: how often to use each pattern (multiset of classes that fits a sequence) so that all pieces are covered
by as few sequences as possible. Multiplicative weights on the classes act as dual prices; a knapsack dynamic program
prices the best patterns in each round. The fractional cover is rounded, and pieces are poured into the patterns (a
class that has run out is replaced by the next shorter one). What is left over goes best-fit, longest first, into the
space that is left.

A piece finds its place by its length and its rank among the pieces of that length: its number within the task that
made it, plus the numbers of the tasks before. So pieces are neither sorted nor moved, but for a join with these sums
where they are too many to be broadcast.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.common import materialize, ragged, table, text_slices, tidy
from rillmark.llm.tokens import text_ids

CAPACITY, END_ID, CLASSES, ROUNDS, LOSS, TRIES, STEP = 2048, 0, 1024, 60, 0.005, 6, 0.3
#: Rows of sums (24 bytes each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], part, nth): each document's token ids and one end id, cut into pieces
    of ``capacity`` where longer; nth: the piece's number among those of its length in its task, ``part``. Null and
    empty texts have the end id alone. Rows of equal or null id are documents each. To be written before it is packed."""
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["part", "nth"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, texts in text_slices(batches):
            ids, at = text_ids(texts, path)
            size = np.diff(at) + 1
            flat = np.full(int(size.sum()), end_id, "<u4")
            begin = np.cumsum(size) - size
            flat[ragged(begin, size - 1)] = ids
            count = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(size[owner] - start, capacity)
            low = begin[owner] + start
            data = flat.tobytes()
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(low.tolist(), (low + length).tolist(), strict=True)]
            out = [rows.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([low, [len(flat)]]).astype(np.int32)), pa.array(flat.astype(np.int32))))
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            out += [pa.array(np.full(len(length), part, np.int32)), pa.array(nth)]
            del ids, at, flat, data, crc
            yield pa.RecordBatch.from_arrays(out, names)
            del out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", part int, nth long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity``: the greatest value of a multiset of lengths that fits, and its last length's number."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        gain = best[room - lengths[: ends[room]]] + value[: ends[room]]
        i = int(gain.argmax())
        if gain[i] > best[room - 1]:
            best[room], took[room] = gain[i], i
        else:
            best[room] = best[room - 1]
    return best, took


def pattern_from(lengths: np.ndarray, took: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while room > 0:
        if took[room] < 0:
            room -= 1
            continue
        length = int(lengths[took[room]])
        out[length] = out.get(length, 0) + 1
        room -= length
    return out


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, boost: dict[int, float] | None = None, rate: float = 0.2, slack: float = 0.05) -> list[tuple[float, dict[int, int]]]:
    """A fractional cover of the histogram: (times, pattern). Weights begin as lengths, times ``boost`` where given.

    In each round one knapsack prices the patterns; every length in turn takes its best pattern if that is near the
    best of all (within a share that rises to ``slack`` with the rounds), and half of what the pattern could still
    cover is used, in the last third all. A length's weight falls by a factor with the share of it that is covered, so
    later rounds turn to what is short.
    """
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[x] for x in lengths], float)
    price = lengths / capacity * np.array([(boost or {}).get(x, 1.0) for x in lengths.tolist()])
    covered, used = np.zeros(len(lengths)), {}
    where = {int(x): i for i, x in enumerate(lengths)}
    for turn in range(rounds):
        open_ = np.flatnonzero(demand - covered > 0.01)
        if not len(open_):
            break
        share = covered[open_] / demand[open_]
        weight = price[open_] * np.exp(-rate * (share - share.min()))
        best, took = knapsack(lengths[open_], weight, capacity)
        for i in range(len(open_) - 1, -1, -1):
            length = int(lengths[open_[i]])
            if weight[i] + best[capacity - length] < (1 - slack * (turn + 1) / rounds) * best[capacity]:
                continue
            pattern = pattern_from(lengths[open_], took, capacity - length)
            pattern[length] = pattern.get(length, 0) + 1
            rows, copies = np.array([where[x] for x in pattern]), np.array([*pattern.values()], float)
            times = float(((demand - covered)[rows] / copies).min()) * (0.5 if 3 * turn < 2 * rounds else 1.0)
            if times > 0.01:
                covered[rows] += times * copies
                key = tuple(sorted(pattern.items()))
                used[key] = used.get(key, 0.0) + times
    return [(x, dict(k)) for k, x in used.items()]


def best_fit(histogram: dict[int, int], capacity: int, bins: list[list] | None = None) -> list[list]:
    """Best-fit, longest first, over counts: equal bins are one entry [times, {length: copies}, room]."""
    done: list[list] = []
    open_: list[tuple[int, int]] = []  # (room, number of the entry), sorted
    entries: list[list] = []

    def put(times: int, pattern: dict[int, int], room: int) -> None:
        if room:
            bisect.insort(open_, (room, len(entries)))
            entries.append([times, pattern, room])
        else:
            done.append([times, pattern, room])

    for times, pattern, room in bins or []:
        put(times, pattern, room)
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(open_, (length, -1))
            if at < len(open_):
                room, no = open_.pop(at)
                times, pattern, _ = entries[no]
            else:
                times, pattern, room = left, {}, capacity
            copies = min(room // length, left)
            fit = min(times, left // copies)
            put(fit, pattern | {length: pattern.get(length, 0) + copies}, room - copies * length)
            if times > fit and pattern:
                put(times - fit, pattern, room)
            left -= fit * copies
    return done + [entries[no] for _, no in open_]


def pour(stock: dict[int, list[list[int]]], times: int, pattern: dict[int, int], capacity: int, out: list[list]) -> None:
    """Fills ``times`` sequences after a pattern of classes from the stock of (length, number) of each class. Equal
    sequences are one entry; where a class has run out the next shorter one takes its place."""
    while times > 0:
        wanted: dict[int, int] = {}
        for c, copies in pattern.items():
            while c > 0 and not stock.get(c):
                c -= 1
            if c:
                wanted[c] = wanted.get(c, 0) + copies
        if not wanted:
            return
        step = min([times, *(stock[c][-1][1] // copies for c, copies in wanted.items())])
        filled: dict[int, int] = {}
        for c, copies in wanted.items():
            left = copies * max(step, 1)
            while left and stock[c]:  # with step 0 one sequence gets the last of a length and some of the next
                length, n = stock[c][-1]
                some = min(left, n)
                filled[length] = filled.get(length, 0) + some // max(step, 1)
                left -= some
                stock[c][-1][1] -= some
                if some == n:
                    stock[c].pop()
        out.append([max(step, 1), filled, capacity - sum(x * k for x, k in filled.items())])
        times -= max(step, 1)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, classes: int = CLASSES, loss: float = LOSS, tries: int = TRIES) -> tuple[list[list], int]:
    """Sequences for all pieces of the histogram, [times, {length: copies}, room] each, and how many pieces the program's
    patterns placed (best-fit placed the others).

    Sequences that rounding leaves emptier than ``loss`` are undone. While the plan takes more than ``loss`` beyond the
    least number there can be, the weights of classes that were left over are multiplied up and the program is solved
    again, at most ``tries`` times; the best of its plans counts."""
    unit = -(-capacity // classes)
    class_of = {length: min(-(-length // unit), capacity // unit) for length, n in histogram.items() if n}  # the longest class is alone in its sequences
    demand: dict[int, int] = {}
    for length, c in class_of.items():
        demand[c] = demand.get(c, 0) + histogram[length]
    least = -(-sum(length * n for length, n in histogram.items()) // capacity)
    best, boost = ([], 0), dict.fromkeys(demand, 1.0)
    for turn in range(tries if demand else 0):
        stock: dict[int, list[list[int]]] = {}
        for length in sorted(class_of):
            stock.setdefault(class_of[length], []).append([length, histogram[length]])
        made: list[list] = []
        due, done = 0.0, 0
        for times, pattern in sorted(configurations(demand, capacity // unit, rounds, boost), key=lambda x: -x[0]):
            due += times
            pour(stock, int(due + 0.5) - done, pattern, capacity, made)
            done = int(due + 0.5)
        left = {length: n for rows in stock.values() for length, n in rows if n}
        full = [entry for entry in made if entry[2] <= loss * capacity]
        for times, pattern, room in made:
            if room > loss * capacity:
                for length, copies in pattern.items():
                    left[length] = left.get(length, 0) + times * copies
        placed = sum(t * sum(p.values()) for t, p, _ in full)
        bins = best_fit(left, capacity, full)
        if not turn or sum(b[0] for b in bins) < sum(b[0] for b in best[0]):
            best = bins, placed
        if sum(b[0] for b in best[0]) <= (1 + loss) * least + 1:
            break
        missed: dict[int, int] = {}
        for length, n in left.items():
            missed[class_of[length]] = missed.get(class_of[length], 0) + n
        for c, n in missed.items():
            boost[c] *= 1 + STEP * n / demand[c]
    return best


def slots(bins: list[list]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: from which rank on, into which sequences, at which offset."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for times, pattern, _ in bins:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            rows.append((length, rank.get(length, 0), base, copies, offset))
            rank[length] = rank.get(length, 0) + times * copies
            offset += length * copies
        base += times
    rows.sort()
    table_ = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table_[:, 0] << 48) + table_[:, 1], "rank": table_[:, 1], "base": table_[:, 2], "copies": table_[:, 3], "offset": table_[:, 4]}


def pack(parts: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to pieces (see ``pieces``); ``parts`` must be a written table, as tasks' numbers are
    not the same when they run again in another way. The places of all lengths (at most rounds * CLASSES patterns and
    capacity lengths, whatever the table's size) go to the tasks. An empty table gives an empty one.
    """
    counts = materialize(parts.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan(histogram, capacity, rounds)[0])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    if counts.count() <= BROADCAST_ROWS:
        shifts = F.broadcast(shifts)
    kept = [c for c in parts.columns if c not in ("part", "nth")]
    ranked = parts.join(shifts, ["part", "length"]).select(*kept, (F.col("nth") + F.col("shift")).alias("rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(where["key"], (length << 48) + rank, side="right") - 1
            beyond = rank - where["rank"][at]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(where["base"][at] + beyond // where["copies"][at]), pa.array(where["offset"][at] + beyond % where["copies"][at] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(run), schema)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents; with_ids also returns each piece's token ids."""
    return pack(materialize(pieces(docs, path, id_col, text_col, capacity, with_ids=with_ids), "pieces"), capacity)


def op3(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
