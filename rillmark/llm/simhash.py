"""SimHash near-duplicates: pigeonhole blocks.

Fingerprints that differ in at most d of 64 bits agree in at least (blocks - d) of ``blocks`` bit blocks.
Distinct fingerprints are dealt out once for each choice of (blocks - d) blocks by the bits of these blocks;
those that meet are compared bit by bit. Only a spanning forest of the links found in a bucket leaves it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import Words, id_bit, id_filter, local_components, materialize, mix, ragged, shuffle_width, text_slices, tidy
from rillmark.llm.graph import connected_components
from rillmark.llm.xxh import xxh64

SEED, SHINGLE, MAX_BITS, BLOCKS = 42, 3, 2, 4
#: SPREAD[x] holds the eight bits of x in eight lanes of eight bits.
SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)
LANE = 255


def shingle_hashes(words: Words, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a slice of texts, and how many each text has."""
    n = np.diff(words.first)
    each = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    head = np.repeat(words.first[:-1] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    tail = head + np.repeat(np.minimum(n, size) - 1, each)
    return xxh64(words.data, words.start[head], words.start[tail] + words.length[tail] - words.start[head], seed), each


def majority_bits(hashes: np.ndarray, each: np.ndarray) -> np.ndarray:
    """For each text the 64 bits that are set in over half of its hashes; zero where it has none."""
    out = np.zeros(len(each), np.uint64)
    full = np.flatnonzero(each)
    if not len(full):
        return out
    parts = -(-each[full] // LANE)  # lanes hold up to 255, so sum short runs first
    owner = np.repeat(np.arange(len(full)), parts)
    first = np.cumsum(each[full]) - each[full]
    cut = first[owner] + LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    runs = np.cumsum(parts) - parts
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(SPREAD[octets[:, byte]], cut).view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(lanes, runs, axis=0, dtype=np.int64)
        bits = (2 * count > each[full][:, None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)
        out[full] |= bits.sum(axis=1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the SimHash of each whole text; null, empty and blank texts have fingerprint zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(majority_bits(*shingle_hashes(Words(texts))).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "id long, fp long")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - max_bits)]


def _flips(mask: int, max_bits: int) -> np.ndarray:
    """All changes of up to max_bits bits outside the mask."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return np.array([sum(c) for k in range(1, max_bits + 1) for c in combinations(free, k)], np.uint64)


def _links(node: np.ndarray, fp: np.ndarray, key: np.ndarray, mask_no: np.ndarray, masks: list[int], max_bits: int, dense: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs of equal (mask_no, key); rows are sorted by both and by fp."""
    edge = np.flatnonzero((key[1:] != key[:-1]) | (mask_no[1:] != mask_no[:-1])) + 1
    begin = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([begin, [len(key)]]))
    label = np.arange(len(key))
    small = np.flatnonzero((size > 1) & (size <= dense))
    rows = np.repeat(begin[small], size[small]) + (np.arange(int(size[small].sum())) - np.repeat(np.cumsum(size[small]) - size[small], size[small]))
    end = np.repeat(begin[small] + size[small], size[small])
    step = 1
    while len(rows):
        inside = rows + step < end
        rows, end = rows[inside], end[inside]
        near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= max_bits
        a, b = rows[near], rows[near] + step
        apart = label[a] != label[b]
        if apart.any():
            label = local_components(len(label), np.concatenate([a[apart], np.arange(len(label))]), np.concatenate([b[apart], label]))
        step += 1
    for r in np.flatnonzero(size > dense):  # large runs: probe the changed fingerprints instead of comparing pairs
        i, j = begin[r], begin[r] + size[r]
        run = fp[i:j]
        order = np.argsort(run, kind="stable")
        ranked = run[order]
        for flip in _flips(masks[mask_no[i]], max_bits):
            at = np.minimum(np.searchsorted(ranked, ranked ^ flip), len(ranked) - 1)
            a = np.flatnonzero(ranked[at] == ranked ^ flip)
            b = order[at[a]] + i
            a = order[a] + i
            apart = label[a] != label[b]
            if apart.any():
                part = local_components(j - i, np.concatenate([a[apart] - i, np.arange(j - i)]), np.concatenate([b[apart] - i, label[i:j] - i]))
                label[i:j] = part + i
    far = np.flatnonzero(label != np.arange(len(label)))
    return node[far], node[label[far]]


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links that join all of ``nodes`` (node, distinct fp) within max_bits of each other, as a forest per bucket."""
    masks = block_masks(blocks, max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = nodes.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(signed)])).alias("b"), "node", "fp"
    ).select("b.m", "b.k", "node", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []  # of the last run so far

        def found(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            m, k, node, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = _links(node, fp.view(np.uint64), k, m, masks, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            last = np.flatnonzero((parts[0] != parts[0][-1]) | (parts[1] != parts[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last run may go on in the next batch
            if cut or rest and (rest[-1][0][-1], rest[-1][1][-1]) != (parts[0][-1], parts[1][-1]):
                yield found([*rest, [x[:cut] for x in parts]])
                rest = []
            rest.append([x[cut:] for x in parts])
        if rest:
            yield found(rest)

    width = shuffle_width(nodes.sparkSession)
    return dealt.repartition(width, "m", "k").sortWithinPartitions("m", "k", "fp").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id reachable over links of up to max_bits bits.

    Rows of equal fingerprint meet in an aggregate with partial sums, and one of them stands for all in the block
    join. Ids must be whole numbers (others, and nulls, name no row and are left out); repeated ids are kept as rows,
    and texts of one id are not linked by it; an empty table gives an empty one.
    """
    marks = materialize(fingerprints(docs, id_col, text_col).where("id is not null"), "simhash")
    nodes = materialize(marks.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = connected_components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), max_bits, blocks))
    tied = nodes.join(roots, nodes["fp"] == roots["node"])
    least = tied.groupBy("root").agg(F.min("least").alias("component"))
    named = tied.join(least, "root").select("fp", "component")
    # written, so that the join below is one of two plain shuffles, which adaptive execution can split at a hot fingerprint
    named = materialize(nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")), "simhash-named")
    return marks.join(named, "fp").select("id", "fp", "component")


# --- documents of similar content -------------------------------------------------------------------------------

#: Words of a shingle; bands of equal minima of the shingle set and minima of a band: a pair of Jaccard similarity s
#: meets in none with probability (1 - s ** ROWS) ** BANDS, which is 0.0008 at 0.8; bytes kept of a shingle's hash;
#: runs of up to FEW sets are compared pair by pair, all at once; buckets of more than BLOCK sets are cut into blocks,
#: each with the same LEADERS sets.
WORDS, BANDS, ROWS, KEPT, FEW, BLOCK, LEADERS = 5, 10, 3, 5, 6, 2048, 8
KEPT_BITS = np.uint64(8 * KEPT)
ODD = np.random.default_rng(20240307).integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a slice, as 40-bit hashes in order, and how many each text has."""
    hashes, each = shingle_hashes(words, size)
    owner = np.repeat(np.arange(len(each), dtype=np.uint64), each)
    flat = np.unique(owner << KEPT_BITS | hashes >> (np.uint64(64) - KEPT_BITS))
    return flat & ((np.uint64(1) << KEPT_BITS) - np.uint64(1)), np.bincount((flat >> KEPT_BITS).astype(np.int64), minlength=len(each))


def set_marks(values: np.ndarray, each: np.ndarray) -> list[np.ndarray]:
    """For each set two sums that tell it from others, then its band keys; zeros for an empty set."""
    out = [np.zeros(len(each), np.uint64) for _ in range(2 + BANDS)]
    full = np.flatnonzero(each)
    if not len(full):
        return out
    begin = (np.cumsum(each) - each)[full]
    for i in range(2):
        out[i][full] = np.add.reduceat(mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)), begin)
    mixed = mix(values)
    for i in range(BANDS):
        key = np.full(len(full), i, np.uint64)
        for odd in ODD[i * ROWS : (i + 1) * ROWS]:
            key = mix(key + np.minimum.reduceat(mixed * odd, begin))
        out[2 + i][full] = key
    return out


def _alike(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b members with so many in common have a Jaccard similarity of 0.8 (in whole numbers)."""
    return 9 * common >= 4 * (a + b)


def _grow(values: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Components of a run: those similar to a set leave the rest at once, so a group of n copies costs n steps, not n * n."""
    label, left = np.arange(len(each)), np.arange(len(each))
    known, number = np.unique(values, return_inverse=True)
    begin, mark = np.cumsum(each) - each, np.zeros(len(known), bool)
    rest = number
    while len(left):
        seed, left, rest = left[0], left[1:], rest[each[left[0]] :]
        queue = [seed]
        while queue and len(left):
            now = queue.pop()
            own = number[begin[now] : begin[now] + each[now]]
            mark[own] = True
            common = np.add.reduceat(mark[rest], np.cumsum(each[left]) - each[left], dtype=np.int64)
            mark[own] = False
            near = _alike(common, each[now], each[left])
            if near.any():
                label[left[near]] = seed
                queue += left[near].tolist()
                rest, left = rest[np.repeat(~near, each[left])], left[~near]
    return label


def _similar(node: np.ndarray, run_no: np.ndarray, values: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs (rows of one run_no stand together); no set is empty."""
    begin = np.flatnonzero(np.concatenate([[True], run_no[1:] != run_no[:-1]]))
    size = np.diff(np.concatenate([begin, [len(node)]]))
    first = np.cumsum(each) - each
    few = np.flatnonzero((size > 1) & (size <= FEW))
    rows, end, step = ragged(begin[few], size[few]), np.repeat(begin[few] + size[few], size[few]), 1
    a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rows):
        inside = rows + step < end
        rows, end = rows[inside], end[inside]
        a, b = rows, rows + step
        some = _alike(np.minimum(each[a], each[b]), each[a], each[b])
        a, b = a[some], b[some]
        pair = np.arange(len(a), dtype=np.uint64) << KEPT_BITS
        both = np.sort(np.concatenate([np.repeat(pair, each[x]) | values[ragged(first[x], each[x])] for x in (a, b)]))
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> KEPT_BITS).astype(np.int64), minlength=len(a))
        near = _alike(common, each[a], each[b])
        a_all.append(a[near])
        b_all.append(b[near])
        step += 1
    label = local_components(len(node), np.concatenate(a_all), np.concatenate(b_all))
    for r in np.flatnonzero(size > FEW):
        i, j = begin[r], begin[r] + size[r]
        label[i:j] = i + _grow(values[first[i] : first[j - 1] + each[j - 1]], each[i:j])
    far = np.flatnonzero(label != np.arange(len(label)))
    return node[far], node[label[far]]


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(id, text_hash, component, first) for every row with an id: the smallest id reachable over pairs of similar texts,
    and whether the row's id and text are the first of the group (smallest id, then hash).

    Texts are similar if the sets of their shingles of ``words`` words have a Jaccard similarity of 0.8 or more. Equal
    sets collapse first. Sets meet where their texts' SimHash fingerprints are linked as in ``near_duplicates`` (2 bits,
    block by block), however few bands agree; and, as fingerprints of a pair of 0.8 mostly differ in more bits, where
    all minima of a band are equal, which depends on their similarity alone, not on where or how a text was changed: of
    pairs of 0.8 one in 1,300 meets in no band, and fewer above. The sets that meet are fetched and compared whole (as
    40-bit hashes), so that links are exact. Where many sets meet, they do so in
    blocks, with a few sets that stand in all blocks; after that only sets outside the bucket's largest component are
    compared with the blocks they have not met, so no link between components is lost. A text shorter than a shingle is
    one shingle; null, empty and blank texts are each other's copies. Texts under one id are documents each, told apart
    by text_hash (xxhash64). Ids must be whole numbers: others, like nulls, name no row. An empty table gives an empty one.
    """
    sums, bands = ["d0", "d1"], [f"k{i}" for i in range(BANDS)]
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where("id is not null")

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, slice_ in text_slices(batches):
            split = Words(slice_)
            out = [*set_marks(*shingle_sets(split, words)), majority_bits(*shingle_hashes(split))]
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], *[pa.array(x.view(np.int64)) for x in out]], ["id", "text_hash", *sums, *bands, "fp"])

    marks = materialize(texts.mapInArrow(tidy(marked), "id long, text_hash long, " + ", ".join(f"{n} long" for n in [*sums, *bands, "fp"])), "profiles")
    own = F.struct("id", "text_hash")
    nodes = marks.groupBy(*sums).agg(F.min(own).alias("one"), *[F.min(k).alias(k) for k in bands])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "profile-nodes")
    full = nodes.where("d0 != 0 or d1 != 0").select("node", F.col("one.id").alias("id"), *sums, *bands)
    dealt = full.select(F.explode(F.array(*bands)).alias("k"), "node", "id", *sums)
    dealt = dealt.union(materialize(_print_keys(marks).join(full, sums).select("k", "node", "id", *sums), "profile-prints"))
    met = dealt.join(dealt.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "k")
    part = F.struct("k", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = materialize(met.groupBy("node", "id", *sums).agg(F.collect_list(part).alias("ks")), "profile-met")  # BANDS keys, and one for each group of fingerprints that texts of this set have
    crowded = not met.where(F.exists("ks", lambda x: x["blocks"] > 1)).isEmpty()
    bits = id_filter(met, "id")

    def fetched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, slice_ in text_slices(batches):
            bit = rows.column(3).to_numpy()
            some = pa.array(np.flatnonzero((bits[bit // 64] >> (bit % 64)) & 1))
            values, each = shingle_sets(Words(slice_.take(some)), words)
            tell = set_marks(values, each)[:2]
            at = np.concatenate([[0], np.cumsum(each)]) * KEPT
            data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT])
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(some), *[pa.array(x.view(np.int64)) for x in tell], packed], ["id", *sums, "packed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            key, node = (rows.column(i).to_numpy() for i in (0, 1))
            sets = [np.frombuffer(x.as_py(), np.uint8) for x in rows.column(2)]
            each = np.array([len(x) // KEPT for x in sets])
            wide = np.zeros((int(each.sum()), 8), np.uint8)
            wide[:, :KEPT] = np.concatenate(sets).reshape(-1, KEPT)
            a, b = _similar(node, key, wide.view("<u8").reshape(-1), each)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            other = np.flatnonzero(key != key[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or rest and rest[-1].column(0)[-1].as_py() != key[-1]:  # the last run may go on in the next batch
                yield found([*rest, batch.slice(0, cut)])
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield found(rest)

    sets = texts.withColumn("bit", id_bit(bits)).mapInArrow(tidy(fetched), "id long, d0 long, d1 long, packed binary")
    held = met.join(sets, ["id", *sums]).select("node", "ks", "packed")
    if crowded:
        held = materialize(held, "profile-sets")
    rows = _in_blocks(held).select("key", "node", "packed")
    if crowded:
        own_hash = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"].alias(f"l{i}") for i in range(LEADERS)]
        leaders = _in_blocks(met).where("blocks > 1").groupBy("k", "blocks").agg(*own_hash).select("k", "blocks", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("node"))
        rows = rows.union(_everywhere(leaders.join(held.select("node", "packed"), "node")).select("key", "node", "packed"))
    width = shuffle_width(docs.sparkSession)
    links = rows.repartition(width, "key").sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long")
    roots = connected_components(links)
    if crowded:
        roots = _rejoined(held, roots, width)
    tied = nodes.select("node", "one", *sums).join(roots, "node")
    least = tied.groupBy("root").agg(F.min("one").alias("best"))
    named = tied.join(least, "root").select(*sums, "best")
    best = materialize(nodes.select(*sums, "one").join(named, sums, "left").select(*sums, F.coalesce("best", "one").alias("best")), "profile-best")  # for a join that can be split
    return marks.join(best, sums).select("id", "text_hash", F.col("best.id").alias("component"), (own == F.col("best")).alias("first"))


def _print_keys(marks: DataFrame) -> DataFrame:
    """(d0, d1, k): a key for each group of linked fingerprints that the texts of a set have."""
    prints = materialize(marks.where("d0 != 0 or d1 != 0").select("d0", "d1", "fp").distinct(), "prints")
    roots = connected_components(near_links(prints.select(F.col("fp").alias("node"), "fp").distinct()))
    named = prints.join(roots, prints["fp"] == roots["node"], "left")
    return named.select("d0", "d1", F.xxhash64(F.coalesce("root", "fp"), F.lit("print")).alias("k")).distinct()


def _in_blocks(held: DataFrame) -> DataFrame:
    """Each bucket of each set: k, blocks, the set's block and the key of both, with the columns of ``held``."""
    rest = [c for c in held.columns if c != "ks"]
    rows = held.select(F.explode("ks").alias("b"), *rest).select("b.k", "b.blocks", *rest)
    return rows.withColumn("key", _key(F.pmod(F.xxhash64("node"), F.col("blocks"))))


def _everywhere(rows: DataFrame) -> DataFrame:
    """Rows (k, blocks, ...) once for every block of their bucket."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("key", _key(F.col("block")))


def _key(block: Column) -> Column:
    return F.when(F.col("blocks") > 1, F.xxhash64("k", block.cast("long"))).otherwise(F.col("k"))


def _rejoined(held: DataFrame, roots: DataFrame, width: int) -> DataFrame:
    """(node, root) after the sets outside the largest component of a bucket in blocks have met all of its blocks."""
    labels = materialize(_in_blocks(held.select("node", "ks")).where("blocks > 1").join(roots, "node", "left").select("k", "blocks", "key", "node", F.coalesce("root", "node").alias("root")), "profile-labels")
    largest = labels.groupBy("k", "root").count().groupBy("k").agg(F.max(F.struct("count", "root"))["root"].alias("main"))
    lone = materialize(labels.join(largest, "k").where("root != main").select("k", "blocks", "node", "root"), "profile-lone")
    if lone.isEmpty():
        return roots
    members = labels.join(lone.select("k").distinct(), "k", "left_semi").select("key", F.lit(False).alias("lone"), "node", "root")
    every = members.union(_everywhere(lone).select("key", F.lit(True), "node", "root")).join(held.select("node", "packed"), "node").select("key", "lone", "node", "root", "packed")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table_ = None, [], None
        for batch in batches:
            a, b = [], []
            for key, lone_, node, root, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, parts, table_ = key, [], None
                own = np.frombuffer(packed, np.uint8)
                wide = np.zeros((len(own) // KEPT, 8), np.uint8)
                wide[:, :KEPT] = own.reshape(-1, KEPT)
                values = wide.view("<u8").reshape(-1)
                if not lone_:
                    parts.append((node, root, values))
                    continue
                if not parts:
                    continue
                if table_ is None:
                    each = np.array([len(x[2]) for x in parts])
                    known, number = np.unique(np.concatenate([x[2] for x in parts]), return_inverse=True)
                    table_ = each, np.cumsum(each) - each, known, number, np.array([x[0] for x in parts]), np.array([x[1] for x in parts])
                each, begin, known, number, nodes, theirs = table_
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                mark = np.zeros(len(known), bool)
                mark[at[known[at] == values]] = True
                common = np.add.reduceat(mark[number], begin, dtype=np.int64)
                near = np.flatnonzero(_alike(common, len(values), each) & (theirs != root))
                _, one = np.unique(theirs[near], return_index=True)
                a += [node] * len(one)
                b += nodes[near[one]].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    more = every.repartition(width, "key").sortWithinPartitions("key", "lone").mapInArrow(tidy(run), "a long, b long")
    return connected_components(more.union(roots.select("node", "root")))


def op8(spark, sf_dir):
    from rillmark.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
