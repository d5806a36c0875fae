"""SimHash and vectors against brute force, and what odd rows give."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rillmark.llm import embeddings, graph, simhash
from rillmark.llm.common import Words, local_components, table
from rillmark.llm.xxh import xxh64
from tests.conftest import SMALL

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in SPACES:
        out = out.replace(s, " ")
    return [w for w in out.split(" ") if w]


def fingerprint(text):
    w = words_of(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(keys, linked):
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_xxh64_of_many():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5_000, dtype=np.uint8)
    start, length = rng.integers(0, 4_000, 400), rng.integers(0, 120, 400)
    length[:6] = [0, 1, 31, 32, 33, 1000]
    want = [xxhash.xxh64_intdigest(data[i : i + n].tobytes(), 42) for i, n in zip(start, length, strict=True)]
    assert xxh64(data, start, length, 42).tolist() == want


def test_op8_is_brute_force(spark):
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    fp = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    ids = sorted(fp)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    root = components(ids, links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8(spark, SMALL).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in ids}


def test_simhash_odd_rows(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, 1), (2, "", 2), (3, " \n ", 3), (4, "One", 4), (5, "one ", 5), (6, long_, 6), (7, long_, 7), (7, long_, 7), (None, "x y z", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = sorted((r["id"], r["fp"], r["component"]) for r in simhash.near_duplicates(df).collect())
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    assert got == sorted([(1, 0, 1), (2, 0, 1), (3, 0, 1), (4, signed(fingerprint("one")), 4), (5, signed(fingerprint("one")), 4), *[(i, signed(fingerprint(long_)), 6) for i in (6, 7, 7)]])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_large_runs_are_probed():
    rng = np.random.default_rng(1)
    masks = simhash.block_masks(4, 2)
    base = rng.integers(0, 2**63, dtype=np.int64).astype(np.uint64)
    free = [b for b in range(64) if not masks[0] >> b & 1]
    fps = np.unique(np.array([base] + [base ^ np.uint64(sum(1 << b for b in rng.choice(free, rng.integers(1, 9), replace=False))) for _ in range(1500)], np.uint64))
    key, no = (fps & np.uint64(masks[0])).view(np.int64), np.zeros(len(fps), np.int32)
    found = [simhash._links(np.arange(len(fps)), fps, key, no, masks, 2, dense=d) for d in (10, 100_000)]
    labels = [local_components(len(fps), np.concatenate([a, np.arange(len(fps))]), np.concatenate([b, np.arange(len(fps))])) for a, b in found]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    a, b = np.nonzero(np.triu(near, 1))
    want = local_components(len(fps), a, b)
    assert (labels[0] == want).all() and (labels[1] == want).all() and all(len(x[0]) < len(fps) for x in found)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(rng, base, kind, share):
    """A copy of a list of words with about this share of it changed in one way."""
    n = max(1, round(share * len(base)))
    fresh = [f"n{rng.integers(10**9)}" for _ in range(n)]
    at = int(rng.integers(0, len(base) - n + 1))
    if kind == "scattered":
        out = list(base)
        for i in rng.choice(len(base), max(1, n // 5), replace=False):
            out[i] = f"n{rng.integers(10**9)}"
        return out
    return {"cut": base[: len(base) - n], "appended": base + fresh, "block": base[:at] + fresh + base[at + n :]}[kind]


def test_similar_documents_are_brute_force(spark):
    """Copies of a similarity about 0.8, cut, appended to, with a block replaced or words scattered: links of all kinds."""
    rng = np.random.default_rng(21)
    shares = {"cut": (0.14, 0.24), "appended": (0.18, 0.3), "block": (0.07, 0.13), "scattered": (0.08, 0.14)}
    texts, kinds = {}, {}
    for g in range(400):
        kind = list(shares)[g % 4]
        base = [f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(120, 500))) % 5000]
        texts[2 * g], texts[2 * g + 1], kinds[g] = base, edited(rng, base, kind, rng.uniform(*shares[kind])), kind
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    near = {g: len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) >= 0.8 for g in kinds}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.similar_documents(df.repartition(4)).collect()}
    assert all(got[2 * g] == 2 * g for g in kinds)
    for kind in shares:
        of = [g for g in kinds if kinds[g] == kind]
        assert 20 <= sum(near[g] for g in of) <= 80
        assert not [g for g in of if not near[g] and got[2 * g + 1] != 2 * g + 1]
        assert sum(near[g] and got[2 * g + 1] != 2 * g for g in of) <= 1


def test_linked_fingerprints_meet_without_a_band(spark):
    """Copies whose fingerprints are within two bits are found though no band of minima agrees."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(500):
        base, phrase = [f"w{x}" for x in rng.integers(0, 5000, 60)], [f"p{x}" for x in rng.integers(0, 5000, 4)] * 60
        cut = rng.integers(4, 8)
        texts += [" ".join(phrase + base), " ".join(phrase + base[cut:] + [f"n{x}" for x in rng.integers(0, 5000, 2)])]
    words = Words(pa.array(texts))
    fp, (values, each) = simhash.majority_bits(*simhash.shingle_hashes(words)), simhash.shingle_sets(words)
    marks, sets = simhash.set_marks(values, each), [set(x.tolist()) for x in np.split(values, np.cumsum(each)[:-1])]
    near = [g for g in range(0, 1000, 2) if (int(fp[g]) ^ int(fp[g + 1])).bit_count() <= 2 and len(sets[g] & sets[g + 1]) >= 0.8 * len(sets[g] | sets[g + 1])]
    unmet = [g for g in near if all(k[g] != k[g + 1] for k in marks[2:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.similar_documents(df.repartition(4)).collect()}
    assert unmet and all(got[g] == got[g + 1] == g for g in near)


def test_similar_runs_are_brute_force():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**40, 60)) for _ in range(6)]
    sets = [np.unique(np.concatenate([rng.choice(s, len(s) - rng.integers(0, 8), replace=False), rng.integers(0, 2**40, rng.integers(1, 8))])) for s in sets for _ in range(12)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    values, each = np.concatenate(sets).astype(np.uint64), np.array([len(s) for s in sets])
    for size in (2, 5, 12, 72):
        run_no = np.arange(72) // size
        links = [(i, j) for i in range(72) for j in range(i) if run_no[i] == run_no[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        a, b = simhash._similar(np.arange(72), run_no, values, each)
        want = components(range(72), links)
        assert components(range(72), list(zip(a.tolist(), b.tolist(), strict=True))) == want and len(a) == 72 - len(set(want.values()))


def brute(vectors, threshold=0.95):
    out = {}
    good = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    good = {i: v / np.abs(v).max() for i, v in good.items()}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    root = components(vectors, links)
    for i in vectors:
        out[i] = (sum(i in x for x in links), root[i], root[i] == i)
    return out


@pytest.mark.parametrize(("block", "cells", "dense"), [(2048, 64, 10**9), (16, 64, 4), (40, 3, 2)])
def test_vectors_are_brute_force(spark, block, cells, dense):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=8).tolist() for i in range(150)}
    for g in range(12):
        c = rng.normal(size=8)
        vectors |= {1000 + 20 * g + j: (c + (0.04, 0.12, 0.3)[g % 3] * rng.normal(size=8)).tolist() for j in range(15)}
    vectors |= {2000: None, 2001: [], 2002: [0.0] * 8, 2003: [float("nan")] + [1.0] * 7, 2004: [None] + [1.0] * 7, 2005: [float("inf")] * 8, 2006: [1.0, 2.0], 2007: [1.0, 2.0], 2008: vectors[3], 2009: [10 * x for x in vectors[3]], 2010: [1e-200] * 8, 2011: [1e200] * 8}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").withColumn("node", F.lit("clash")).withColumn("v", F.lit(0))
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df.repartition(3), block=block, max_cells=cells, dense=dense).collect()}
    assert got == brute(vectors)


def test_vectors_of_several_lengths(spark):
    """Every length is compared within itself, those of many vectors through cells of their own."""
    rng = np.random.default_rng(5)
    vectors = {}
    for d, n in ((4, 60), (7, 90), (2, 9), (1, 3)):
        centres = rng.normal(size=(6, d))
        for _ in range(n):
            vectors[len(vectors)] = (centres[rng.integers(6)] + 0.1 * rng.normal(size=d)).tolist()
    vectors |= {900: [1.0, 0.0, 0.0], 901: [1.0, 0.0, 0.001]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df, block=32).collect()}
    assert got == brute(vectors) and got[901] == (1, 900, False)


def test_products_grow_slower_than_pairs():
    """Vectors around ever more centres: what is compared grows by less than the power 1.5 of their number."""
    rng = np.random.default_rng(6)
    work = {}
    for n in (4_000, 16_000):
        x = rng.normal(size=(n // 40, 16))[rng.integers(0, n // 40, n)] + 0.05 * rng.normal(size=(n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centroids = embeddings.spherical_kmeans(x, n // 64, most=100)
        cells = embeddings.Cells(centroids, np.zeros((0, 16)), 0.95)
        home, dot = cells.home(x)
        members, radius = np.bincount(home, minlength=len(cells)), np.full(len(cells), -10.0)
        np.maximum.at(radius, home, np.arccos(np.clip(dot, -1, 1)))
        work[n] = (members * members).sum() / 2 + sum((cells.visits(x[i : i + 500], home[i : i + 500], radius) * members).sum() for i in range(0, n, 500))
    assert work[16_000] / work[4_000] < 4**1.5, work


def test_vectors_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(none).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_vectors(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    same = spark.createDataFrame([(5, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_vectors(same).collect())) == [(4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False)]
