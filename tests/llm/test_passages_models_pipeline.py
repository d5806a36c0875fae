"""Repeated passages, the two models, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillmark.llm import packing, passages, quality, simhash, toxicity
from rillmark.llm.common import table
from tests.conftest import SMALL

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def vocabulary(rng, n=3_000):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def planted():
    """Documents of random words; some share passages: exact, with substitutions, with words left out or put in."""
    rng = random.Random(6)
    words = vocabulary(rng)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    docs = {i: text(rng.randrange(60, 400)) for i in range(60)}
    exact, fuzzy, gappy = text(55), text(120), text(150)
    for i in (3, 10, 40):
        docs[i][20:20] = exact
    for i in (5, 20):
        docs[i][30:30] = [rng.choice(words) if i == 20 and k % 25 == 24 else w for k, w in enumerate(fuzzy)]
    docs[7][10:10] = gappy
    docs[50][40:40] = gappy[:60] + text(4) + gappy[60:100] + gappy[103:]
    docs[55] = list(docs[2])
    return docs, {3: {10, 40}, 5: {20}, 7: {50}, 2: {55}}


def test_planted_passages(spark):
    docs, want = planted()
    df = spark.createDataFrame([(i, " ".join(w).capitalize()) for i, w in docs.items()], "doc_id long, text string")
    got = passages.repeated_passages(df.repartition(4)).collect()
    assert {(r["rid"], r["id"]) for r in got} == {(a, b) for a, bs in want.items() for b in bs}
    for r in got:
        assert r["rid"] < r["id"] and r["identity"] >= 0.8
        mine = [w.lower() for w in docs[r["id"]]][r["start"] : r["end"]]
        theirs = [w.lower() for w in docs[r["rid"]]][r["rstart"] : r["rend"]]
        assert len(set(mine) & set(theirs)) >= 0.75 * len(set(mine))
    spans = {r["id"]: (r["start"], r["end"]) for r in got}
    assert spans[10] == (20, 75) and spans[20] == (30, 150) and spans[55] == (0, len(docs[2]))
    assert spans[50][0] <= 41 and spans[50][1] >= 40 + 150 - 2


def test_many_copies_meet_the_first(spark):
    rng = random.Random(2)
    passage = " ".join(vocabulary(rng, 70))
    rows = [(i, f"{' '.join(vocabulary(rng, 30))} {passage} tail{i}") for i in range(300)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["id"] for r in got} == set(range(1, 300)) and all(r["end"] - r["start"] == 70 for r in got)


def test_passages_odd_rows(spark):
    base = " ".join(vocabulary(random.Random(9), 90))
    rows = [(1, None), (2, ""), (3, "one two"), (4, base), (6, base), (6, base), (None, base), (7, "and " * 400), (8, "and " * 300 + base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("seed", F.lit(1)).withColumn("pos", F.lit(1))
    got = passages.repeated_passages(df).collect()
    assert {r["id"] for r in got} == {6, 8} and {r["rid"] for r in got} <= {4, 6, 7}
    assert passages.repeated_passages(df.limit(0)).count() == 0
    spans = spark.createDataFrame([(r["id"], r["start"], r["end"]) for r in got], "id long, start int, end int")
    left = {r["doc_id"]: r["text"] for r in passages.without_repeats(df, spans).where("doc_id is not null").collect()}
    assert left[4] == base and left[7] == "and " * 400 and left[6].strip() == "" and left[1] is None and left[2] == ""
    assert set(passages.without_repeats(df, spans).columns) == set(df.columns)
    assert passages.without_repeats(df, spans).count() == df.count()


def local_alignment(a, b):
    """The best local alignment of two word lists by brute force (match 1, else -1): where it ends, and its pairs."""
    best, at = np.zeros((len(a) + 1, len(b) + 1), int), None
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = max(0, best[i, j] + (1 if x == y else -1), best[i, j + 1] - 1, best[i + 1, j] - 1)
    at = np.unravel_index(best.argmax(), best.shape)
    equal, (i, j) = 0, at
    while i and j and best[i, j]:
        if best[i, j] == best[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            equal, i, j = equal + (a[i - 1] == b[j - 1]), i - 1, j - 1
        elif best[i, j] == best[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return i, int(at[0]), j, int(at[1]), equal


KINDS = ["tenth words", "twelfths", "sevenths", "every tenth", "every ninth", "gap of 2", "gap of 5", "joint of 30", "joint of 44"]


def test_recall_of_fuzzy_passages(spark):
    """Passages with words changed, put in or left out, and of two parts that stand first in two other documents; what
    counts is what a brute-force aligner finds in each pair of documents."""
    rng = random.Random(5)
    words, weights = vocabulary(rng, 4_000), [1 / (i + 3) for i in range(4_000)]
    text = lambda n: rng.choices(words, weights, k=n)
    docs, cases = [], []
    for kind in KINDS:
        for _ in range(20):
            a = text(60)
            if kind.startswith("joint"):
                half = int(kind[-2:])
                a = text(2 * half)
                docs += [text(30) + a[:half] + text(30), text(30) + a[half:] + text(30)]
                b = a
            elif kind.startswith("gap"):
                at, n = rng.randrange(15, 45), int(kind[-1])
                b = a[:at] + (text(n) + a[at:] if rng.random() < 0.5 else a[at + n :])
            elif kind.startswith("every"):
                n = {"tenth": 10, "ninth": 9}[kind.split()[1]]
                b = [f"new{rng.randrange(10**6)}" if k % n == n - 1 else w for k, w in enumerate(a)]
            else:
                share = {"tenth words": 0.1, "twelfths": 1 / 12, "sevenths": 1 / 7}[kind]
                b = [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in a]
            cases.append((kind, len(docs)))
            docs += [text(40) + a + text(30), text(50) + b + text(30)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    found = {}
    for r in passages.repeated_passages(df).collect():
        found.setdefault(r["id"], set()).update(range(r["start"], r["end"]))
    hit, all_ = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for kind, i in cases:
        a0, a1, b0, b1, equal = local_alignment(docs[i], docs[i + 1])
        if min(a1 - a0, b1 - b0) >= 45 and equal >= 0.8 * max(a1 - a0, b1 - b0):
            all_[kind] += 1
            hit[kind] += len(found.get(i + 1, set()) & set(range(b0, b1))) >= 0.8 * (b1 - b0)
    print("recall of passages:", {k: f"{hit[k]}/{all_[k]}" for k in KINDS})
    assert all(all_[k] >= 10 and hit[k] >= 0.9 * all_[k] for k in KINDS)


def test_passages_do_not_depend_on_partitions(spark):
    docs = table(spark, MIDDLE, "documents")
    want = sorted(map(tuple, passages.repeated_passages(docs.coalesce(1)).collect()), key=str)
    assert len(want) > 50
    for other in (docs.repartition(7), docs.repartition(40), docs.orderBy(F.desc("doc_id"))):
        assert sorted(map(tuple, passages.repeated_passages(other).collect()), key=str) == want


def test_passages_of_rows_with_one_id(spark):
    """Two texts under one id are documents each; a text that stands twice under an id is one."""
    rng = random.Random(8)
    words = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(80)
    mine, other = f"{text(20)} {passage} {text(20)}", text(150)
    rows = [(1, f"{passage} {text(30)}"), (2, mine), (2, other), (2, mine), (5, other), (9, text(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(df)
    assert {(r["id"], r["rid"]) for r in got.collect()} in ({(2, 1), (5, 2)}, {(2, 1), (2, 5)})
    left = [(r["doc_id"], r["text"]) for r in passages.without_repeats(df, got).collect()]
    assert sum(passage in t for _, t in left) == 1 and sum(t == other for _, t in left) == 1 and len(left) == len(rows)
    assert sum(i == 2 and t == mine.replace(passage + " ", "") for i, t in left) == 2


def test_long_gaps_part_passages():
    rng = np.random.default_rng(4)
    assert passages.parted([(0, 0, 400), (700, 400, 400), (1_101, 801, 300)], [[0, 1, 2]]) == [[0], [1, 2]]
    a = rng.integers(0, 2**32, 240, dtype=np.uint32)
    b = np.delete(a, np.arange(3, 240, 7))
    assert passages._common(a, b) == len(b)


def test_chain_is_the_best_chain():
    rng = random.Random(1)
    for _ in range(60):
        runs = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 8)) for _ in range(rng.randrange(1, 9))]
        lines = passages.chain(runs)
        assert sorted(i for line in lines for i in line) == list(range(len(runs)))

        def worth(line, runs=runs):
            total = 0.0
            for k, i in enumerate(line):
                total += runs[i][2]
                if k:
                    j = line[k - 1]
                    gaps = [runs[i][s] - runs[j][s] - runs[j][2] for s in (0, 1)]
                    if min(gaps) < 0:
                        return None
                    total -= passages.GAP_COST * sum(gaps)
            return total

        best = max(w for m in range(1, 2 ** len(runs)) for w in [worth(sorted((i for i in range(len(runs)) if m >> i & 1), key=lambda i: runs[i]))] if w is not None)
        assert abs(max(worth(line) for line in lines) - best) < 1e-9


def test_first_holders_other_copies_travel(spark):
    """A passage stands in an earlier slice, twice in the first holder of a later one, and in two more texts there."""
    rng = random.Random(15)
    words = vocabulary(rng)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage = text(70)
    docs = {1: text(40) + passage + text(40), 5: text(60) + passage + text(90) + passage + text(60)}
    docs |= {i: text(30) + passage + text(30) for i in (6, 7)} | {i: text(50) for i in (2, 3, 4, 8)}
    rows = spark.sparkContext.parallelize([(i, " ".join(docs[i])) for i in sorted(docs)], 2)  # documents 1-4 and 5-8
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = [(r["start"], r["end"]) for r in got if r["id"] == 5 and r["rid"] == 1]
    for at in (60, 220):
        assert any(start <= at and end >= at + 70 for start, end in spans)
    assert {r["id"] for r in got} == {5, 6, 7}


def test_stretches_of_a_chain_are_tried():
    """Two passages, one with four words put in, on one chain across unrelated words: both are reported."""
    rng = np.random.default_rng(3)
    word = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    for gap in (30, 40, 50, 60):
        first, second = word(60), word(60)
        a = np.concatenate([word(50), first, word(gap), second, word(50)])
        b = np.concatenate([word(50), first[:30], word(4), first[30:], word(gap), second, word(50)])
        runs = np.array([[50, 50, 30], [80, 84, 30], [110 + gap, 114 + gap, 60]])
        got = [x[:4] for x in passages.align(runs.reshape(-1), a, 0, b, 0)]
        assert got == [(50, 110, 50, 114), (110 + gap, 170 + gap, 114 + gap, 174 + gap)]


def test_quality_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in quality.op7(spark, MIDDLE).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, MIDDLE, "labels").collect()}
    held = [i for i in labels if got[i]["held_out"]]
    assert 0.15 * len(labels) < len(held) < 0.35 * len(labels)
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_toxicity_on_held_out_rows(spark):
    """On the larger table, as few toxic rows are held out: held-out rows alone count."""
    got = {r["doc_id"]: r for r in toxicity.op10(spark, LARGE).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, LARGE, "labels").collect()}
    held = [i for i in labels if got[i]["held_out"]]
    clean, toxic = ([i for i in held if labels[i] == y] for y in (0, 1))
    assert len(toxic) >= 20
    assert np.mean([got[i]["predicted"] for i in clean]) < 0.02
    assert np.mean([got[i]["predicted"] for i in toxic]) > 0.8


def test_models_take_one_text_of_an_id(spark):
    """An id that very many rows share gives one row to fit on."""
    rows = [(i % 40 if i < 400 else 7, f"{'good words' if i % 2 else 'bad'} number {i}") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    quality.fit = lambda x, y: seen.append(len(x)) or fit(x, y)
    try:
        quality.train(docs, labels)
    finally:
        quality.fit = fit
    assert seen[0] <= 40


@pytest.mark.parametrize("model", [quality, toxicity])
def test_models_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "some words here"), (3, "some words here"), (4, "x" * 200_000), (None, "no id"), (5, "\U0001f600 \u00e9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("y", F.lit(1)).withColumn("p", F.lit(1))
    name = "quality" if model is quality else "toxic"
    for labels in ([], [(1, 1), (None, 0), (3, None)], [(1, 1), (2, 0), (3, 1), (3, 0)]):
        out = model.classify(docs, spark.createDataFrame(labels, f"doc_id long, {name} int")).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["id"] == 3}) == 1
    assert model.classify(docs.limit(0), spark.createDataFrame([], f"doc_id long, {name} int")).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, rounds=20)
    assert (0, 1) in m.pairs and np.mean((m.score(x) > 0.5) == y) > 0.9


def test_similar_documents(spark):
    rng = random.Random(12)
    words = vocabulary(rng)
    rows, want = [], {}
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(150, 500))]
        for k in range(4):
            text = list(base)
            for _ in range(k and len(text) // 70):  # about one word in 70: a similarity of 0.87 or so
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((4 * g + k, " ".join(text)))
            want[4 * g + k] = 4 * g
    many = [rng.choice(words) for _ in range(300)]
    for k in range(150):
        text = list(many)
        text[rng.randrange(300)] = rng.choice(words)
        rows.append((1000 + k, " ".join(text)))
        want[1000 + k] = 1000
    rows += [(2000, None), (2001, ""), (2002, "short text"), (2003, "short text"), (2003, "short text")]
    want |= {2000: 2000, 2001: 2000, 2002: 2002, 2003: 2002}
    df = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("fp", F.lit(1))
    got = simhash.similar_documents(df.repartition(4)).collect()
    assert len(got) == len(rows)
    wrong = [r for r in got if r["component"] != want[r["id"]]]
    assert len(wrong) <= 4 and all(r["component"] // 4 == r["id"] // 4 for r in wrong if r["id"] < 1000)
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_crowded_buckets_are_cut_without_losing_links(spark):
    """Large groups of near copies, among them chains whose ends are not alike: the same groups whatever the blocks."""
    rng = random.Random(33)
    words = vocabulary(rng)
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(260):
        text = list(base)
        text[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    for i in range(120):  # away from the base, step by step
        for at in rng.sample(range(120), rng.choice([1, 2, 2, 3])):
            base[at] = rng.choice(words)
        rows.append((500 + i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(tuple, simhash.similar_documents(df).collect()))
    for block in (12, 60):
        assert sorted(map(tuple, simhash.similar_documents(df, block=block).collect())) == want
    assert 2 <= len({r[2] for r in want}) < 60


def test_similar_documents_of_one_id(spark):
    """Ids that several texts have link nothing, and the stage drops rows, not ids; of equal rows one stays."""
    rng = random.Random(12)
    words = vocabulary(rng)
    a, b, c = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, c), (None, a), (None, a), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("text_hash", F.lit(1)).withColumn("Key", F.lit(2))
    got = {(r["id"], r["component"], r["first"]) for r in simhash.similar_documents(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False)}
    out = corpus_pipeline.one_of_each_group(spark, df, SMALL)
    left = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert out.columns == df.columns and left == sorted([(1, a), (2, b), (3, c), (None, a), (None, a), (5, None)], key=str)
    marks = {(r["id"], r["component"]) for r in simhash.near_duplicates(df).collect()}
    assert {(1, 1), (2, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5)} == marks


def test_stages(spark):
    docs = table(spark, SMALL, "documents").withColumn("id", F.lit("clash")).withColumn("quality_score", F.lit("clash")).withColumn("toxicity_score", F.lit(2))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash", "passages", "packing"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SMALL)
        if name != "packing":
            assert after.columns == docs.columns and after.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            rows = after.collect()
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before.collect()}
            if name != "passages":
                assert all(r["text"] == texts[r["doc_id"]] for r in rows)
        if name == "quality":
            scores = {r["doc_id"]: r["predicted"] for r in quality.op7(spark, SMALL).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, p in scores.items() if p}
        if name == "simhash":
            kept = {r["id"] for r in simhash.similar_documents(before).collect() if r["first"]}
            assert {r["doc_id"] for r in rows} == kept
        if name == "passages":
            assert len(rows) == len(kept) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "packing":
            rows = after.collect()
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()} and all(r["offset"] + r["length"] <= packing.CAPACITY for r in rows)
        before = after
