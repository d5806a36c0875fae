"""Passages that repeat across documents, found by collinear chaining of shared k-mer seeds.

1. Seeds are pairs of neighbouring syncmers. A k-mer is a syncmer if its least word hash stands at one of its ends,
   which depends on its own words alone, so that changed words spoil no seeds around them; one of any three k-mers in
   a row is one. Any nine words that two documents share hold a seed, and a seed spans five to seven words.
2. Seeds meet by hash; each occurrence is matched with the first one (smallest document, then place), so a seed that a
   third of all documents holds gives one match per occurrence, not one per pair. Where two earlier documents hold a
   passage's parts, the seeds across the joint still lead to a document that holds both. A slice of texts sends one
   occurrence of a frequent seed and hands that one's match on to the others, whatever the slices are.
3. The matches of a document with one earlier document are joined into runs on a diagonal, and runs are chained in
   order of both texts with costs for gaps, best predecessors coming from a Fenwick tree of prefix maxima.
4. Both sides of each chain are fetched and aligned word by word; a chain counts if it spans enough words with
   enough of them equal, as do the longest stretches of it where the whole does not.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import Words, free_name, id_bit, id_filter, materialize, mix, powers, shuffle_width, table, text_slices, tidy, with_bit

KMER, MIN_WORDS, IDENTITY = 4, 45, 0.8
#: Words that any seed spans at least, and how near one text repeats a seed for its repeats to be numbered.
SEED, NEAR = 5, 32
#: Seeds on a diagonal join into a run up to MAX_GAP words apart; a passage does not go on across LONGEST_GAP words
#: without a seed (its parts are passages each); MARGIN exceeds MIN_WORDS, so a part that is no passage alone is seen whole.
MAX_GAP, LONGEST_GAP, GAP_COST, MARGIN, DROP = 32, 250, 0.25, 48, 8
FREQUENT, LEAST_SPAN = 4, 12
#: A place is one number: the word's, 16 bits of what stands around the seed, and what kind of occurrence it is.
DIRECT, HEAD, MEMBER, KIND_BITS, PLACE_BITS = 1, 2, 0, 2, 18


def seeds_of(words: Words, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The seeds of a slice: text number, place (in words), hash, and 8 bits each of the syncmers before and after (0: none)."""
    n = np.diff(words.first)
    count = len(words) - kmer + 1
    if count < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    up, down = powers(len(words) + 1)
    hashes = words.hashes()
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[: len(words)], dtype=np.uint64)])
    low = np.minimum.reduce([hashes[i : i + count] for i in range(kmer)])
    place = np.arange(count) - words.first[:-1][words.text[:count]]
    chosen = np.flatnonzero(((hashes[:count] == low) | (hashes[kmer - 1 :] == low)) & (place <= n[words.text[:count]] - kmer))
    grams = mix((total[chosen + kmer] - total[chosen]) * down[chosen])
    text, place = words.text[chosen], place[chosen]
    one, two = np.flatnonzero(text[1:] == text[:-1]), np.flatnonzero(text[1:] == text[:-1]) + 1
    step = (place[two] - place[one]).astype(np.uint64)
    seed = mix(grams[one] + mix(grams[two] + step * np.uint64(0x9E3779B97F4A7C15)))
    short = (grams >> np.uint64(57)).astype(np.int64) + 1
    last = np.minimum(two + 1, len(text) - 1)
    before = np.where((one > 0) & (text[one - 1] == text[one]), short[one - 1], 0)
    after = np.where((two + 1 < len(text)) & (text[last] == text[two]), short[last], 0)
    text, place = text[one], place[one]
    # where a phrase goes on and on its seeds are numbered, so that such stretches meet place by place
    order = np.argsort(seed, kind="stable")
    again = np.zeros(len(seed), bool)
    again[1:] = (seed[order][1:] == seed[order][:-1]) & (text[order][1:] == text[order][:-1]) & (place[order][1:] - place[order][:-1] <= NEAR)
    since = np.arange(len(seed)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(seed))))
    numbered = order[since > 0]
    seed[numbered] = mix(seed[numbered] + since[since > 0].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return text, place, seed, before << 8 | after


def seed_rows(docs: DataFrame) -> DataFrame:
    """(seed, id, place, rid, rplace): occurrences of seeds; those that stand for others of their slice (HEAD), and these
    others (MEMBER, with the place of their head, dealt anywhere)."""
    names = ["seed", "id", "place", "rid", "rplace"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            text, pos, seed, around = seeds_of(Words(texts))
            ids, place = rows.column(0).to_numpy()[text], pos << PLACE_BITS | around << KIND_BITS
            order = np.lexsort((place, ids, seed))
            ids, place, seed = ids[order], place[order], seed[order]
            start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([start, [len(seed)]]))
            head = np.repeat(start, size)
            member = (np.repeat(size, size) >= FREQUENT) & (ids != ids[head])  # all of the first holder's own travel on
            kind = np.full(len(seed), DIRECT)
            kind[head[member]] = HEAD
            kind[member] = MEMBER
            place |= kind
            met, rest = np.flatnonzero(member), np.flatnonzero(~member)
            null = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(seed[rest].view(np.int64)), pa.array(ids[rest]), pa.array(place[rest]), null, null], names)
            if len(met):
                anywhere = mix(seed[met] + ids[met].view(np.uint64) + place[met].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anywhere, ids[met], place[met], ids[head[met]], place[head[met]])], names)

    return docs.mapInArrow(tidy(run), "seed long, id long, place long, rid long, rplace long")


def matches(seeds: DataFrame) -> DataFrame:
    """(id, pos, rid, rpos, sure): each occurrence of a seed with the seed's first occurrence, in other documents;
    sure: the syncmers on both sides agree too."""
    names, schema = ["id", "place", "rid", "rplace"], "id long, place long, rid long, rplace long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            member = batch.column(2).to_numpy() & (1 << KIND_BITS) - 1 == MEMBER
            if member.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(member)).columns[1:], names)
            own = batch.filter(pa.array(~member))
            if not own.num_rows:
                continue
            seed, ids, place = (own.column(i).to_numpy() for i in range(3))
            start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
            size = np.diff(np.concatenate([start, [len(seed)]]))
            rid, rplace = ids[start], place[start]
            if now is not None and now[0] == seed[0]:
                rid[0], rplace[0] = now[1:]
            now = (seed[-1], rid[-1], rplace[-1])
            rid, rplace = np.repeat(rid, size), np.repeat(rplace, size)
            met = np.flatnonzero((ids != rid) | (place & (1 << KIND_BITS) - 1 == HEAD))
            yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (ids, place, rid, rplace)], names)

    def handed_on(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            member = batch.column(2).to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(member, -1, np.arange(len(member))))
            to = [np.where(at < 0, h, x[at]) for x, h in zip((batch.column(3).to_numpy(), batch.column(4).to_numpy()), held, strict=True)]
            held = (to[0][-1], to[1][-1])
            some = pa.array(member)
            yield pa.RecordBatch.from_arrays([batch.column(3).filter(some), batch.column(4).filter(some), pa.array(to[0]).filter(some), pa.array(to[1]).filter(some)], names)

    width = shuffle_width(seeds.sparkSession)
    found = materialize(seeds.repartition(width, "seed").sortWithinPartitions("seed", "id", "place").mapInArrow(tidy(run), schema), "matches")
    kind = F.col("place").bitwiseAND((1 << KIND_BITS) - 1)
    heads = found.where(kind == HEAD).select(F.col("id").alias("hid"), F.col("place").alias("hplace"), F.lit(False).alias("member"), "rid", "rplace")
    members = found.where(kind == MEMBER).select(F.col("rid").alias("hid"), F.col("rplace").alias("hplace"), F.lit(True).alias("member"), "id", "place")
    members = heads.union(members).repartition(width, "hid", "hplace").sortWithinPartitions("hid", "hplace", "member").mapInArrow(tidy(handed_on), schema)
    every = found.where(kind != MEMBER).unionByName(members).where("id != rid")
    around = [F.shiftright(c, KIND_BITS).bitwiseAND(0xFFFF) for c in ("place", "rplace")]
    sure = (around[0] == around[1]) & (around[0] > 0xFF) & (around[0].bitwiseAND(0xFF) > 0)
    return every.select("id", F.shiftright("place", PLACE_BITS).cast("int").alias("pos"), "rid", F.shiftright("rplace", PLACE_BITS).cast("int").alias("rpos"), sure.alias("sure"))


class Fenwick:
    """Prefix maxima over ranks, with who holds them."""

    def __init__(self, n: int):
        self.value, self.who = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, rank: int, value: float, who: int) -> None:
        rank += 1
        while rank < len(self.value):
            if value > self.value[rank]:
                self.value[rank], self.who[rank] = value, who
            rank += rank & -rank

    def best(self, rank: int) -> tuple[float, int]:
        """Over the ranks below ``rank``."""
        value, who = float("-inf"), -1
        while rank > 0:
            if self.value[rank] > value:
                value, who = self.value[rank], self.who[rank]
            rank -= rank & -rank
        return value, who


def chain(runs: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[list[int]]:
    """Chains of runs (a, b, length), each before the next in both texts; every run in at most one, best chains first."""
    n = len(runs)
    a_end, b_end = [r[0] + r[2] for r in runs], [r[1] + r[2] for r in runs]
    ranks = {b: i for i, b in enumerate(sorted(set(b_end)))}
    keys = sorted(ranks)
    tree, worth, came = Fenwick(len(keys)), [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: a_end[i])
    nxt = 0
    for i in sorted(range(n), key=lambda i: runs[i][:2]):
        while nxt < n and a_end[waiting[nxt]] <= runs[i][0]:
            j = waiting[nxt]
            tree.put(ranks[b_end[j]], worth[j] + gap_cost * (a_end[j] + b_end[j]), j)
            nxt += 1
        value, j = tree.best(int(np.searchsorted(keys, runs[i][1], side="right")))
        gain = value - gap_cost * (runs[i][0] + runs[i][1])
        worth[i], came[i] = runs[i][2] + max(gain, 0.0), j if gain > 0 else -1
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -worth[i]):
        line = []
        while i >= 0 and not used[i]:
            used[i] = True
            line.append(i)
            i = came[i]
        if line:
            out.append(line[::-1])
    return out


def parted(runs: list[tuple[int, int, int]], lines: list[list[int]], longest: int = LONGEST_GAP) -> list[list[int]]:
    """The chains, cut where a gap is longer than ``longest`` words in either text."""
    out = []
    for line in lines:
        out.append(line[:1])
        for i, j in zip(line, line[1:], strict=False):
            if max(runs[j][0] - runs[i][0] - runs[i][2], runs[j][1] - runs[i][1] - runs[i][2]) > longest:
                out.append([])
            out[-1].append(j)
    return out


def chains(found: DataFrame) -> DataFrame:
    """(id, rid, runs): chains of each document with each earlier one; runs: a, b, length in words, one after another.

    A chain goes on to be aligned if it spans LEAST_SPAN words, or if a seed of it has both neighbours in common too."""

    def settle(ids: np.ndarray, pos: np.ndarray, rid: np.ndarray, rpos: np.ndarray, sure: np.ndarray) -> Iterator[pa.RecordBatch]:
        diagonal = rpos - pos
        order = np.lexsort((pos, diagonal, rid, ids))
        ids, pos, rid, diagonal, sure = (x[order] for x in (ids, pos, rid, diagonal, sure))
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (rid[1:] != rid[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > MAX_GAP)
        start = np.flatnonzero(fresh)
        stop = np.concatenate([start[1:], [len(ids)]]) - 1
        a, length, b = pos[start], pos[stop] + SEED - pos[start], pos[start] + diagonal[start]
        sure = np.maximum.reduceat(sure, start) if len(start) else sure
        ids, rid = ids[start], rid[start]
        edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (rid[1:] != rid[:-1])])) if len(ids) else np.zeros(0, np.int64)
        out_id, out_rid, out_runs = [], [], []
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
            runs = list(zip(a[i:j].tolist(), b[i:j].tolist(), length[i:j].tolist(), strict=True))
            for line in parted(runs, chain(runs)) if j - i > 1 else [[0]]:
                first, last = runs[line[0]], runs[line[-1]]
                if last[0] + last[2] - first[0] >= LEAST_SPAN or any(sure[i + k] for k in line):
                    out_id.append(ids[i])
                    out_rid.append(rid[i])
                    out_runs.append([x for k in line for x in runs[k]])
        yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_rid, pa.int64()), pa.array(out_runs, pa.list_(pa.int32()))], ["id", "rid", "runs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                parts = [np.concatenate(x) for x in zip(rest, parts, strict=True)]
            other = np.flatnonzero((parts[0] != parts[0][-1]) | (parts[2] != parts[2][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from settle(*(x[:cut] for x in parts))
            rest = [x[cut:] for x in parts]
        if rest is not None:
            yield from settle(*rest)

    width = shuffle_width(found.sparkSession)
    return found.repartition(width, "id", "rid").sortWithinPartitions("id", "rid", "pos").mapInArrow(tidy(run), "id long, rid long, runs array<int>")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words of a that stand in b in the same order (longest common subsequence), for gaps of at most LONGEST_GAP words."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(step)
    return int(row[-1])


def _stretch(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far an alignment goes on along two texts, and how many words are equal, until it falls DROP below its best."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    equal = a[:n] == b[:n]
    score = np.cumsum(np.where(equal, 1, -1))
    fell = np.flatnonzero(np.maximum(np.maximum.accumulate(score), 0) - score > DROP)
    if len(fell):
        score = score[: fell[0]]
    top = int(score.argmax()) if len(score) else 0
    return (top + 1, int(equal[: top + 1].sum())) if len(score) and score[top] > 0 else (0, 0)


def align(runs: np.ndarray, a: np.ndarray, a_from: int, b: np.ndarray, b_from: int, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> list[tuple[int, int, int, int, float]]:
    """(start, end, rstart, rend, identity) of a chain's passages; a, b: word hashes from a_from and b_from on.

    Where the whole chain is no passage, stretches of its consecutive runs are: the longest first."""
    runs = runs.reshape(-1, 3)
    equal, gaps = [], []
    for k, (i, j, n) in enumerate(runs.tolist()):
        equal.append(int((a[i - a_from : i - a_from + n] == b[j - b_from : j - b_from + n]).sum()))
        if k + 1 < len(runs):
            i2, j2, _ = runs[k + 1].tolist()
            gaps.append(_common(a[i + n - a_from : i2 - a_from], b[j + n - b_from : j2 - b_from]))

    i, j, n = runs.T.astype(np.int64)
    left = np.array([_stretch(a[: x - a_from][::-1], b[: y - b_from][::-1]) for x, y in zip(i, j, strict=True)])
    right = np.array([_stretch(a[x - a_from :], b[y - b_from :]) for x, y in zip(i + n, j + n, strict=True)])
    start, rstart, end, rend = i - left[:, 0], j - left[:, 0], i + n + right[:, 0], j + n + right[:, 0]
    inner = np.concatenate([[0], np.cumsum(np.array(equal[:-1], np.int64) + np.array(gaps, np.int64))])  # up to where each run begins
    out, parts = [], [(0, len(runs) - 1)]
    while parts:  # the longest stretch of runs that passes, then what is left before and after it
        lo, hi = parts.pop()
        best, most = None, 0
        for x in range(lo, hi + 1):
            most_left = int(max((end[x : hi + 1] - start[x]).max(), (rend[x : hi + 1] - rstart[x]).max()))
            if most_left <= most:
                continue
            own, theirs = end[x : hi + 1] - start[x], rend[x : hi + 1] - rstart[x]
            share = (inner[x : hi + 1] - inner[x] + np.array(equal[x : hi + 1]) + left[x, 1] + right[x : hi + 1, 1]) / np.maximum(own, theirs)
            good = np.flatnonzero((np.minimum(own, theirs) >= min_words) & (share >= identity))
            if len(good):
                y = int(good[own[good].argmax()])
                if own[y] > most:
                    best, most = (x, x + y, float(share[y])), int(own[y])
        if best:
            x, y, share = best
            out.append((int(start[x]), int(end[y]), int(rstart[x]), int(rend[y]), share))
            parts += [part for part in ((lo, x - 1), (y + 1, hi)) if part[0] <= part[1]]
    return sorted(out)


def one_row_each(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, text) with each different text of an id once, under a number of its own; where an id occurs more than
    once also (num, id, text_hash) of these. The least text hash of an id keeps the id as its number, others follow all ids."""
    several = materialize(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    if several.isEmpty():
        return rows, None
    ends = rows.agg(F.min("id").alias("low"), F.max("id").alias("top")).first()
    bits = id_filter(several, "id")
    moved = with_bit(rows, bits, "id", keep=True).withColumn("text_hash", F.xxhash64("text"))
    texts = moved.join(several, "id", "left_semi").select("id", "text_hash").distinct()
    least = texts.groupBy("id").agg(F.min("text_hash").alias("least"))
    after = F.lit(ends["top"] + 1) + F.monotonically_increasing_id() if ends["top"] < 1 << 62 else F.lit(ends["low"] - 1) - F.monotonically_increasing_id()
    names = materialize(texts.join(least, "id").select(F.when(F.col("text_hash") == F.col("least"), F.col("id")).otherwise(after).alias("num"), "id", "text_hash"), "names")
    moved = moved.join(names, ["id", "text_hash"], "left").select(F.coalesce("num", "id").alias("id"), "text").groupBy("id").agg(F.first("text").alias("text"))
    return with_bit(rows, bits, "id", keep=False).union(moved), names


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """(id, start, end, rid, rstart, rend, identity, text_hash): words start..end-1 of document id also stand, nearly so,
    in the earlier document rid (words are runs without ASCII white space, A-Z in lower case; rid < id). A span that
    reaches beyond a longer one of its document by less than a seed is left out; of equal ones the earliest source stays.

    Null, empty and short texts give none; rows without an id are left out; an empty table gives an empty one. Rows of
    equal id and text are one document; different texts of one id are documents each, those but one later than all
    others: text_hash (xxhash64, else null) tells which of them a row is about. Texts may be long: one document's words
    must fit a task. The rows do not depend on partitions or the order of rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    rows, names_of = one_row_each(rows)
    lines = chains(matches(seed_rows(rows))).withColumn("cno", F.monotonically_increasing_id())
    lines = materialize(lines, "chains")
    count = lines.count()
    # documents that many chains refer to are dealt out in several copies, each serving a share of the chains
    heap = max(500, count // 4000)
    hot = {r["rid"]: -(-r["count"] // heap) for r in lines.groupBy("rid").count().where(F.col("count") > heap).collect()}  # at most count / heap rows
    hot_id = np.array(sorted(hot), np.int64)
    hot_n = np.array([hot[x] for x in hot_id.tolist()], np.int64)
    bits = id_filter(lines.select("id").union(lines.select("rid")), "id")
    schema = "id long, salt int, kind int, packed binary, cno long, lo int, hi int, runs array<int>"
    names = ["id", "salt", "kind", "packed", "cno", "lo", "hi", "runs"]

    def copies(ids: np.ndarray) -> np.ndarray:
        if not len(hot_id):
            return np.ones(len(ids), np.int64)
        at = np.minimum(np.searchsorted(hot_id, ids), len(hot_id) - 1)
        return np.where(hot_id[at] == ids, hot_n[at], 1)

    def texts_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch, texts in text_slices(batches):
            bit = batch.column(2).to_numpy()
            some = pa.array(np.flatnonzero((bits[bit // 64] >> (bit % 64)) & 1))
            batch, texts = batch.take(some), texts.take(some)
            ids = batch.column(0).to_numpy()
            n = copies(ids)
            who = np.repeat(np.arange(len(ids)), n)
            packed = pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.binary())
            null = pa.nulls(len(who), pa.int32())
            salt = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(salt.astype(np.int32)), pa.array(np.zeros(len(who), np.int32)), packed.take(pa.array(who)), null.cast("int64"), null, null, pa.nulls(len(who), pa.list_(pa.int32()))], names)

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rid, cno = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            runs = batch.column(2)
            flat, at = runs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(runs).to_numpy())]).astype(np.int64)
            for side, who in ((0, ids), (1, rid)):
                lo = np.maximum(flat[at[:-1] + side] - MARGIN, 0)
                hi = flat[at[1:] - 3 + side] + flat[at[1:] - 1] + MARGIN
                salt = (mix(cno.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % copies(who)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(salt.astype(np.int32)), pa.array(np.full(len(who), 1 + side, np.int32)), pa.nulls(len(who), pa.binary()), pa.array(cno), pa.array(lo), pa.array(hi.astype(np.int32)), runs if not side else pa.nulls(len(who), pa.list_(pa.int32()))], names)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, words = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            out = []
            for id_, salt, kind, packed, cno, lo, hi, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    now = (id_, salt)
                    words = (Words(pa.array([unpack.decompress(packed).decode("utf-8", "surrogatepass") if packed else ""])).hashes() >> np.uint64(32)).astype("<u4")
                elif now == (id_, salt):
                    out.append((cno, kind - 1, id_, lo, words[lo:hi].tobytes(), runs))
            for i in range(0, len(out), 1024):
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[i : i + 1024], strict=True), kinds, strict=True)], ["cno", "side", "id", "lo", "words", "runs"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            out = []
            for cno, side, id_, lo, data, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side == 0:
                    first = (cno, id_, lo, data, runs)
                elif first and first[0] == cno:
                    _, own, a_from, a, line = first
                    for start, end, rstart, rend, share in align(np.array(line), np.frombuffer(a, "<u4"), a_from, np.frombuffer(data, "<u4"), lo, min_words, identity):
                        out.append((own, start, end, id_, rstart, rend, share))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "start", "end", "rid", "rstart", "rend", "identity"])

    width = shuffle_width(spark)
    sources = rows.withColumn("bit", id_bit(bits)).mapInArrow(tidy(texts_out), schema)
    regions = sources.union(lines.select("id", "rid", "runs", "cno").mapInArrow(tidy(asked), schema))
    regions = regions.repartition(width, "id", "salt").sortWithinPartitions("id", "salt", "kind").mapInArrow(tidy(cut), "cno long, side int, id long, lo int, words binary, runs array<int>")
    out = regions.repartition(width, "cno").sortWithinPartitions("cno", "side").mapInArrow(tidy(compare), "id long, start int, end int, rid long, rstart int, rend int, identity double")
    out = widest(out)
    if names_of is None:
        return out.withColumn("text_hash", F.lit(None).cast("long"))
    own = names_of.select(F.col("num").alias("id"), F.col("id").alias("own"), "text_hash")
    theirs = names_of.select(F.col("num").alias("rid"), F.col("id").alias("theirs"))
    out = out.join(own, "id", "left").join(theirs, "rid", "left")
    return out.select(F.coalesce("own", "id").alias("id"), "start", "end", F.coalesce("theirs", "rid").alias("rid"), "rstart", "rend", "identity", "text_hash")


def widest(spans: DataFrame) -> DataFrame:
    """The rows without those whose span another, longer one of the same document covers but for less than a seed's words."""
    names = spans.columns

    def chosen(rows: pa.Table) -> pa.RecordBatch:
        start, end, rid, rstart, rend = (rows.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4, 5))
        kept, low, high = [], np.full(len(start), np.iinfo(np.int64).max), np.zeros(len(start), np.int64)
        for i in np.lexsort((rend, rstart, rid, start, start - end)).tolist():  # the longest first
            if not ((low[: len(kept)] < start[i] + SEED) & (high[: len(kept)] > end[i] - SEED)).any():
                low[len(kept)], high[len(kept)] = start[i], end[i]
                kept.append(i)
        return rows.take(pa.array(kept)).combine_chunks().to_batches()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the last document so far
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            out = []
            for i, j in zip(edges, edges[1:], strict=False):
                if rest and rest[0].column(0)[0].as_py() != ids[i]:
                    out.append(chosen(pa.Table.from_batches(rest)))
                    rest = []
                rest.append(batch.slice(i, j - i))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if rest:
            yield chosen(pa.Table.from_batches(rest))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.schema)
    return spans.repartition(shuffle_width(spans.sparkSession), names[0]).sortWithinPartitions(names[0]).mapInArrow(tidy(run), schema)


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of the texts; rows without spans are left as they are, to the byte.

    ``spans`` should be a written table. Only documents that may have spans are moved to meet them. A span with a
    text_hash is cut from rows of that text only.
    """
    if "text_hash" not in spans.columns:
        spans = spans.withColumn("text_hash", F.lit(None).cast("long"))
    bits = id_filter(spans.select("id"), "id")
    names = docs.columns
    key, hash_col, cuts_col = (free_name(names, x) for x in ("key", "text_hash", "cuts"))
    cuts = spans.groupBy(F.col("id").alias(key), F.col("text_hash").alias(hash_col)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cuts_col))  # at most one span for every few words of a document
    still = with_bit(docs, bits, id_col, keep=False)
    moved = with_bit(docs, bits, id_col, keep=True)
    met = (moved[id_col].cast("long") == cuts[key]) & (cuts[hash_col].isNull() | (cuts[hash_col] == F.xxhash64(moved[text_col].cast("string"))))
    moved = moved.join(cuts, met, "left").select(*[moved[c] for c in names], cuts_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts, lists = batch.column(k).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, spans_ in enumerate(lists):
                if not spans_ or not texts[i]:
                    continue
                raw = texts[i].encode("utf-8", "surrogatepass")
                words = Words(pa.array([texts[i]]))
                keep, done = [], 0
                for s in spans_:
                    if s["start"] >= len(words):
                        continue
                    low = int(words.begin[s["start"]])
                    high = int(words.begin[s["end"]]) if s["end"] < len(words) else len(raw)
                    keep.append(raw[done : max(low, done)])
                    done = max(high, done)
                texts[i] = (b"".join(keep) + raw[done:]).decode("utf-8", "surrogatepass")
            columns = batch.columns[:-1]
            columns[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return still.union(moved.mapInArrow(tidy(run), schema))


def op6(spark, sf_dir):
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("rid").alias("source_id"), F.col("rstart").alias("source_start"), F.col("rend").alias("source_end"), "identity")
