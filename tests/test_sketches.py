"""Invariants of every summary: bounds, identities and laws of merging, independence of partitioning, validation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillmark import BloomFilter, CountMin, HyperLogLog, MergeError, Moments, Reservoir, SpaceSaving, TDigest
from rillmark.functions.bounds import contains, relative_width, width, z_score
from rillmark.operators.cardinality import builtin_distinct, error_for_precision, memory_for_precision, precision_for_error


def items(spark, n, prefix="item_", start=0):
    return spark.range(start, start + n).select(F.concat(F.lit(prefix), F.col("id")).alias("item"))


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "value double")


def one(df):
    return df.first()


# --- distinct counts


def test_hll_counts_and_bounds(spark):
    got = one(HyperLogLog.build(items(spark, 10_000), "item", 12).estimate())
    assert 9_000 < got["estimate"] < 11_000 and got["n_inserts"] == 10_000
    got = one(HyperLogLog.build(items(spark, 100_000), "item", 14).estimate())
    assert got["bounds"]["lower"] < 100_000 < got["bounds"]["upper"] and got["bounds"]["confidence"] == 0.95


@pytest.mark.parametrize("kind", ["portable", "fast"])
def test_hll_duplicates_and_small_counts(spark, kind):
    same = spark.range(10_000).select(F.lit("x").alias("item"))
    assert 0.5 <= one(HyperLogLog.build(same, "item", 12, hash=kind).estimate())["estimate"] <= 2
    assert 80 < one(HyperLogLog.build(items(spark, 100), "item", 12, hash=kind).estimate())["estimate"] < 120


def test_hll_empty_null_and_identity(spark):
    none = HyperLogLog.build(items(spark, 0), "item", 10)
    assert one(none.estimate())["estimate"] == 0.0 and none.is_empty()
    nulls = spark.createDataFrame([(None,), ("a",)], "item string")
    assert one(HyperLogLog.build(nulls, "item", 10).estimate())["n_inserts"] == 1
    some = HyperLogLog.build(items(spark, 500), "item", 10)
    assert one(some.merge(none).estimate())["estimate"] == one(some.estimate())["estimate"] == one(none.merge(some).estimate())["estimate"]
    assert some.clear().is_empty()


def test_hll_merge_is_one_pass_whatever_the_partitions(spark):
    a, b = items(spark, 3_000, "a_"), items(spark, 3_000, "a_", 1_500)
    merged = HyperLogLog.build(a.repartition(1), "item", 11).merge(HyperLogLog.build(b.repartition(8), "item", 11))
    whole = HyperLogLog.build(a.union(b).repartition(5), "item", 11)
    assert sorted(merged.table.collect()) == sorted(whole.table.collect())


def test_hll_rank_of_empty_rest(spark):
    for p in (4, 10, 14, 18):
        h = (2**p - 1) << (64 - p)
        df = spark.createDataFrame([(h - 2**64,)], "h long")
        row = one(HyperLogLog.build(df, "h", p, hash="precomputed").table)
        assert row["idx"] == 2**p - 1 and row["rho"] == 64 - p + 1


def test_hll_validation_and_helpers(spark):
    df = items(spark, 1)
    for p in (3, 19):
        with pytest.raises(ValueError):
            HyperLogLog.build(df, "item", p)
    with pytest.raises(ValueError):
        HyperLogLog.build(df, "item", 12, hash="other")
    with pytest.raises(MergeError):
        HyperLogLog.build(df, "item", 12).merge(HyperLogLog.build(df, "item", 14))
    assert precision_for_error(0.01) == 14 and precision_for_error(1.0) == 4 and precision_for_error(1e-6) == 18
    assert memory_for_precision(12) == 4096 and math.isclose(error_for_precision(14), 0.008125)
    assert HyperLogLog.with_error(df, "item", 0.02).precision == 12
    with pytest.raises(ValueError):
        builtin_distinct(df, "item", error=0.0001)


def test_hll_roll_up(spark):
    df = spark.range(2_000).select((F.col("id") % 7).alias("k"), (F.col("id") % 900).alias("item"))
    fine = HyperLogLog.build(df, "item", 12, by="k")
    assert one(fine.roll_up().estimate())["estimate"] == one(HyperLogLog.build(df, "item", 12).estimate())["estimate"]
    with pytest.raises(ValueError):
        fine.roll_up("other")


# --- frequencies


def test_cms_dimensions_and_validation(spark):
    assert CountMin.dimensions(0.001, 0.01) == (2719, 5) and CountMin.dimensions(0.01, 0.001) == (272, 7)
    df = items(spark, 1)
    for e, d in ((0, 0.1), (1, 0.1), (0.1, 0), (0.1, 1)):
        with pytest.raises(ValueError):
            CountMin.dimensions(e, d)
    for w, d in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            CountMin.build(df, "item", w, d)
    a, b = CountMin.build(df, "item", 10, 2), CountMin.build(df, "item", 11, 2)
    for f in (a.merge, a.inner_product):
        with pytest.raises(MergeError):
            f(b)


def test_cms_never_too_low_and_merges(spark):
    df = spark.range(20_000).select((F.col("id") % 500).alias("item"))
    whole = CountMin.build(df, "item", 300, 4)
    halves = [CountMin.build(df.where(c).repartition(n), "item", 300, 4) for c, n in (("item < 200", 1), ("item >= 200", 7))]
    assert sorted(halves[0].merge(halves[1]).table.collect()) == sorted(whole.table.collect())
    assert one(whole.estimate(df.distinct(), "item").agg(F.min("estimate")))[0] >= 40
    none = CountMin.build(df.limit(0), "item", 300, 4)
    assert sorted(whole.merge(none).table.collect()) == sorted(whole.table.collect())
    assert one(none.estimate(df.limit(1), "item"))["estimate"] == 0
    assert one(none.totals()).asDict() == {"total_count": 0, "n_updates": 0}


def test_cms_weights_saturate(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([("a", top), ("a", 5), ("b", 3)], "item string, w long")
    s = CountMin.build(df, "item", 100, 3, weight="w")
    got = {r["item"]: r["estimate"] for r in s.estimate(df.select("item").distinct(), "item").collect()}
    assert got == {"a": top, "b": 3}
    assert one(s.merge(s).estimate(df.select("item").where("item = 'a'").distinct(), "item"))["estimate"] == top


def test_cms_inner_product(spark):
    a = CountMin.build(spark.createDataFrame([("a", 10), ("b", 5)], "item string, w long"), "item", 1000, 5, weight="w")
    b = CountMin.build(spark.createDataFrame([("a", 3), ("b", 2)], "item string, w long"), "item", 1000, 5, weight="w")
    c = CountMin.build(spark.createDataFrame([("zzz", 3)], "item string, w long"), "item", 1000, 5, weight="w")
    assert one(a.inner_product(b))[0] == 40 and one(a.inner_product(c))[0] == 0


def test_cms_conservative_is_the_sequential_fold(spark):
    rng = random.Random(5)
    rows = [(i, f"k{rng.randrange(60)}", rng.randrange(1, 4)) for i in range(600)]
    df = spark.createDataFrame(rows, "seq long, item string, w long")
    width, depth = 16, 3
    got = {(r["row"], r["col"]): r["cnt"] for r in CountMin.conservative(df.repartition(5), "item", "seq", width, depth, weight="w").table.collect()}
    from hashlib import md5

    cells = {}
    exact = {}
    for _, item, w in rows:
        exact[item] = exact.get(item, 0) + w
        at = [(r, int(md5(f"{r}:{item}".encode()).hexdigest()[:15], 16) % width) for r in range(depth)]
        new = min(cells.get(x, 0) for x in at) + w
        for x in at:
            cells[x] = max(cells.get(x, 0), new)
    assert got == cells
    plain = {(r["row"], r["col"]): r["cnt"] for r in CountMin.build(df, "item", width, depth, weight="w").table.collect()}
    assert all(got[x] <= plain[x] for x in got)


# --- heavy hitters


def simulate(stream, capacity):
    items_, counts, errors = [], [], []
    for x in stream:
        if x in items_:
            counts[items_.index(x)] += 1
        elif len(items_) < capacity:
            items_.append(x), counts.append(1), errors.append(0)
        else:
            i = counts.index(min(counts))
            items_[i], errors[i] = x, counts[i]
            counts[i] += 1
    return items_, counts, errors


def test_space_saving_is_the_sequential_algorithm(spark):
    rng = random.Random(3)
    stream = [int(rng.paretovariate(0.7)) % 80 for _ in range(2_000)]
    df = spark.createDataFrame(list(enumerate(stream)), "seq long, item long")
    sketch = SpaceSaving.build(df.repartition(6), "item", "seq", 12)
    got = [(r["item"], r["cnt"], r["err"]) for r in sketch.table.orderBy("slot").collect()]
    assert got == list(zip(*simulate(stream, 12), strict=True))
    exact = {x: stream.count(x) for x in set(stream)}
    for r in sketch.estimate(df.select("item").distinct(), "item").collect():
        if exact[r["item"]] > len(stream) / 12:
            assert r["tracked"]
        if r["tracked"]:
            assert r["guaranteed_count"] <= exact[r["item"]] <= r["estimate"]
        else:
            assert (r["estimate"], r["error"], r["guaranteed_count"]) == (0, 0, 0)
    top = [r["cnt"] for r in sketch.top_k(5).orderBy("rank").collect()]
    assert top == sorted((c for _, c, _ in got), reverse=True)[:5]
    cut = math.floor(0.05 * len(stream))
    assert {r["item"] for r in sketch.heavy_hitters(0.05).collect()} == {i for i, c, _ in got if c >= cut}


def test_space_saving_limits(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("aabbbc")], "seq long, item string")
    s = SpaceSaving.build(df, "item", "seq", 10)
    assert {(r["item"], r["cnt"], r["err"]) for r in s.table.collect()} == {("a", 2, 0), ("b", 3, 0), ("c", 1, 0)}
    with pytest.raises(MergeError):
        s.merge(s)
    with pytest.raises(MergeError):
        s.roll_up()
    with pytest.raises(ValueError):
        SpaceSaving.build(df, "item", "seq", 0)
    assert SpaceSaving.build(df.limit(0), "item", "seq", 3).is_empty()
    by = SpaceSaving.build(df.withColumn("k", F.col("seq") % 2), "item", "seq", 1, by="k")
    assert one(by.totals().agg(F.sum("total_count")))[0] == 6


# --- quantiles


def test_digest_of_few_values_is_exact(spark):
    d = TDigest.build(values(spark, [3, 1, 2, 5, 4]), "value")
    got = {r["q"]: r["value"] for r in d.quantiles([0, 0.25, 0.5, 0.9, 1]).collect()}
    assert got == {0.0: 1.0, 0.25: 1.75, 0.5: 3.0, 0.9: 5.0, 1.0: 5.0}
    assert one(d.median())["median"] == 3.0


@pytest.mark.parametrize("mode", ["sorted", "partial"])
def test_digest_accuracy(spark, mode):
    df = spark.range(1, 10_001).select(F.col("id").cast("double").alias("value")).repartition(6)
    d = TDigest.build(df, "value", 200.0, mode=mode).cache()
    qs = [i / 100 for i in range(101)]
    got = [r["value"] for r in d.quantiles(qs).orderBy("q").collect()]
    assert got == sorted(got) and got[0] == 1 and got[-1] == 10_000
    assert all(abs(v - q * 10_000) <= 50 + 1 for q, v in zip(qs, got, strict=True))
    back = {r["v"]: r["rank"] for r in d.ranks(got[1:-1]).collect()}
    assert all(abs(back[v] - q) < 0.005 for q, v in zip(qs[1:-1], got[1:-1], strict=True))
    assert one(d.num_centroids())["num_centroids"] <= 400


def test_digest_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    got = one(TDigest.build(values(spark, [1, nan, 2, nan, 3]), "value").extremes())
    assert (got["min"], got["max"], got["n_values"]) == (1, 3, 3)
    assert one(TDigest.build(values(spark, [1, inf, 2]), "value").extremes())["max"] == inf
    same = TDigest.build(values(spark, [42] * 1000), "value")
    assert {r["value"] for r in same.quantiles([0, 0.3, 1]).collect()} == {42.0}
    assert {r["v"]: r["rank"] for r in same.ranks([41, 42, 43]).collect()} == {41.0: 0.0, 42.0: 1.0, 43.0: 1.0}
    two = TDigest.build(values(spark, [0] * 500 + [100] * 500), "value")
    ranks = {r["v"]: r["rank"] for r in two.ranks([0, 50, 100]).collect()}
    assert ranks[0.0] == 0 and ranks[100.0] == 1 and 0.3 < ranks[50.0] < 0.7
    none = TDigest.build(values(spark, []), "value")
    assert one(none.median())["median"] is None and one(none.ranks([1.0]))["rank"] == 0.0 and one(none.extremes())["min"] is None


def test_digest_merge(spark):
    a, b = (TDigest.build(spark.range(i, i + 500).select(F.col("id").cast("double").alias("value")), "value") for i in (1, 501))
    m = a.merge(b)
    got = one(m.extremes())
    assert (got["min"], got["max"], got["n_values"]) == (1, 1000, 1000) and abs(one(m.median())["median"] - 500.5) < 5
    none = TDigest.build(values(spark, []), "value")
    assert abs(one(a.merge(none).median())["median"] - one(a.median())["median"]) < 1
    with pytest.raises(MergeError):
        a.merge(TDigest.build(values(spark, [1]), "value", 50.0))
    for c in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            TDigest.build(values(spark, [1]), "value", c)
    with pytest.raises(ValueError):
        TDigest.build(values(spark, [1]), "value", mode="other")


# --- membership


def test_bloom(spark):
    bits, hashes = BloomFilter.parameters_for(1000, 0.01)
    assert (bits, hashes) == (9600, 7)
    mine = items(spark, 1000)
    s = BloomFilter.build(mine.repartition(5), "item", bits, hashes, hash="fast")
    assert one(s.contains(mine, "item").agg(F.bool_and("contains")))[0]
    others = items(spark, 10_000, "other_")
    assert s.semi_join(others, "item").count() < 300 and s.anti_join(mine, "item").count() == 0
    half = BloomFilter.build(items(spark, 500), "item", bits, hashes)
    stats = one(half.stats())
    assert 400 < stats["estimated_count"] < 600 and stats["n_inserts"] == 500 and stats["bits_set"] > 0
    both = half.merge(BloomFilter.build(items(spark, 500, start=500), "item", bits, hashes))
    assert sorted(both.table.collect()) == sorted(BloomFilter.build(mine, "item", bits, hashes).table.collect())
    none = BloomFilter.build(items(spark, 0), "item", bits, hashes)
    assert not one(none.contains(items(spark, 1), "item"))["contains"]
    full = BloomFilter.build(items(spark, 2000), "item", 64, 4)
    assert one(full.stats())["estimated_count"] == math.inf
    for args in ((0, 0.1), (10, 0), (10, 1)):
        with pytest.raises(ValueError):
            BloomFilter.parameters_for(*args)
    for args in ((0, 1), (64, 0)):
        with pytest.raises(ValueError):
            BloomFilter.build(mine, "item", *args)
    with pytest.raises(MergeError):
        half.merge(none.__class__.build(mine, "item", 64, 7))


# --- samples


def test_reservoir(spark):
    df = spark.range(2_000).withColumnRenamed("id", "x")
    a = Reservoir.build(df.where("x < 1000").repartition(1), "x", 100)
    b = Reservoir.build(df.where("x >= 1000").repartition(8), "x", 100)
    whole = Reservoir.build(df, "x", 100)
    merged = a.merge(b)
    assert sorted(merged.sample().collect()) == sorted(whole.sample().collect()) and whole.sample().count() == 100
    assert one(merged.probability()).asDict() == {"items_seen": 2000, "probability": 0.05}
    low = merged.sample().where("x < 1000").count()
    assert 30 <= low <= 70
    few = Reservoir.build(df.limit(30), "x", 100)
    assert few.sample().count() == 30 and one(few.probability())["probability"] == 1.0
    none = Reservoir.build(df.limit(0), "x", 100)
    assert one(none.probability())["probability"] == 0.0
    assert sorted(few.merge(none).sample().collect()) == sorted(few.sample().collect())
    with pytest.raises(ValueError):
        Reservoir.build(df, "x", 0)
    with pytest.raises(MergeError):
        a.merge(Reservoir.build(df, "x", 50))
    other = Reservoir.build(df, "x", 100, seed=9).sample().collect()
    assert sorted(other) != sorted(whole.sample().collect())


def test_reservoir_roll_up(spark):
    df = spark.range(900).select(F.col("id").alias("x"), (F.col("id") % 3).alias("k"))
    fine = Reservoir.build(df, "x", 40, by="k")
    got = {r["x"] for r in fine.roll_up().sample().collect()}
    assert got == {r["x"] for r in Reservoir.build(df, "x", 40).sample().collect()}


# --- statistics


def test_moments_known_values(spark):
    got = one(Moments.build(values(spark, [2, 4, 4, 4, 5, 5, 7, 9]), "value").stats())
    assert (got["n"], got["mean"], got["variance"], got["stddev"], got["min"], got["max"], got["range"], got["sum"]) == (8, 5, 4, 2, 2, 9, 7, 40)
    assert math.isclose(got["sample_variance"], 32 / 7)
    none = one(Moments.build(values(spark, []), "value").stats())
    assert (none["n"], none["mean"], none["variance"], none["sum"], none["min"]) == (0, 0, 0, 0, None)
    single = one(Moments.build(values(spark, [3]), "value").stats())
    assert single["sample_variance"] == 0 and single["range"] == 0
    nan = one(Moments.build(values(spark, [1, float("nan"), 3]), "value").stats())
    assert (nan["n"], nan["mean"]) == (2, 2)
    inf = one(Moments.build(values(spark, [1, float("inf"), 2]), "value").stats())
    assert inf["n"] == 3 and inf["max"] == math.inf
    big = one(Moments.build(spark.range(1000).select((F.col("id") + F.lit(10**12)).cast("double").alias("value")), "value").stats())
    assert abs(big["mean"] - (1e12 + 499.5)) < 1 and abs(big["variance"] - 83333.25) < 1


def test_moments_merge_laws(spark):
    parts = [Moments.build(values(spark, x), "value") for x in ([1, 2, 3], [4, 5, 6], [7, 8, 9], [])]
    a, b, c, none = parts
    whole = one(Moments.build(values(spark, range(1, 10)), "value").stats())
    for m in (a.merge(b).merge(c), a.merge(b.merge(c)), c.merge(a, b), a.merge(none, b, c)):
        got = one(m.stats())
        assert all(abs(got[k] - whole[k]) < 1e-10 for k in ("n", "mean", "variance", "min", "max", "sum"))
    assert one(none.merge(none).stats())["n"] == 0


# --- bounds


def test_error_bounds(spark):
    b = F.struct(F.lit(90.0).alias("lower"), F.lit(100.0).alias("estimate"), F.lit(110.0).alias("upper"), F.lit(0.95).alias("confidence"))
    row = one(spark.range(1).select(b.alias("b")).select(width(F.col("b")), F.round(relative_width(F.col("b")), 9), *[contains(F.col("b"), F.lit(x)) for x in (89.0, 90.0, 110.0, 111.0)]))
    assert tuple(row) == (20.0, 0.2, False, True, True, False)
    assert [z_score(c) for c in (0.99, 0.95, 0.9, 0.8, 0.5)] == [2.576, 1.96, 1.645, 1.282, 1.0]


# --- keys that are null, and names that sketches use themselves


def build_all(df, by):
    return {
        "hll": HyperLogLog.build(df, "x", 10, by=by),
        "cms": CountMin.build(df, "x", 64, 3, by=by),
        "conservative": CountMin.conservative(df, "x", "seq", 64, 3, by=by),
        "space-saving": SpaceSaving.build(df, "x", "seq", 5, by=by),
        "sorted": TDigest.build(df, "value", by=by),
        "partial": TDigest.build(df, "value", by=by, mode="partial"),
        "bloom": BloomFilter.for_items(df, "x", 50, 0.01, by=by),
        "reservoir": Reservoir.build(df, "seq", 4, by=by),
        "moments": Moments.build(df, "value", by=by),
    }


@pytest.mark.parametrize("name", ["g", "c", "b", "k", "row", "mean", "v"])
def test_null_keys_are_keys(spark, name):
    rows = [(i, (None, "a", "b")[i % 3], i % 7, float(i)) for i in range(210)]
    df = spark.createDataFrame(rows, f"seq long, `{name}` string, x long, value double").repartition(5)
    own = {"hll": HyperLogLog, "cms": CountMin, "conservative": CountMin, "space-saving": SpaceSaving, "sorted": TDigest, "partial": TDigest, "bloom": BloomFilter, "reservoir": Reservoir, "moments": Moments}
    if any(name in c.COLUMNS for c in own.values()):  # refused by those that have such a column
        for kind, build in {"hll": lambda: HyperLogLog.build(df, "x", 10, by=name), "cms": lambda: CountMin.build(df, "x", 64, 3, by=name), "space-saving": lambda: SpaceSaving.build(df, "x", "seq", 5, by=name), "sorted": lambda: TDigest.build(df, "value", by=name), "bloom": lambda: BloomFilter.build(df, "x", 64, 2, by=name), "reservoir": lambda: Reservoir.build(df, "seq", 4, by=name), "moments": lambda: Moments.build(df, "value", by=name)}.items():
            if name in own[kind].COLUMNS:
                with pytest.raises(ValueError, match="rename"):
                    build()
            else:
                assert len({r[name] for r in build().table.select(name).distinct().collect()}) == 3
        return
    got = build_all(df, name)
    probes = df.select(name, "x").distinct()
    exact = {(r[name], r["x"]): r["count"] for r in df.groupBy(name, "x").count().collect()}
    assert {r[name]: round(r["estimate"]) for r in got["hll"].estimate().collect()} == {None: 7, "a": 7, "b": 7}
    for kind in ("cms", "conservative"):
        assert all(r["estimate"] >= exact[r[name], r["x"]] for r in got[kind].estimate(probes, "x").collect())
    merged = got["cms"].merge(got["cms"])
    assert all(r["estimate"] >= 2 * exact[r[name], r["x"]] for r in merged.estimate(probes, "x").collect())
    assert got["cms"].inner_product(got["cms"]).count() == 3
    assert all(r["estimate"] >= exact[r[name], r["x"]] for r in got["space-saving"].estimate(probes, "x").collect() if r["tracked"])
    assert got["space-saving"].estimate(probes, "x").where("tracked").count() == 15
    for kind in ("sorted", "partial"):
        for digest in (got[kind], got[kind].merge(got[kind])):
            assert {r[name]: r["median"] for r in digest.median().collect()} == pytest.approx({None: 103.5, "a": 104.5, "b": 105.5}, abs=1)
    assert got["bloom"].contains(probes, "x").where("contains").count() == len(exact) == got["bloom"].semi_join(probes, "x").count()
    assert got["reservoir"].merge(got["reservoir"]).table.count() == got["reservoir"].table.count() == 12
    assert {r[name]: (r["size"], r["full"]) for r in got["reservoir"].sizes().collect()} == dict.fromkeys((None, "a", "b"), (4, True))
    assert {r[name]: r["n"] for r in got["moments"].merge(got["moments"]).stats().collect()} == dict.fromkeys((None, "a", "b"), 140)


def test_answers_do_not_overwrite_columns_of_probes(spark):
    df = spark.range(10).select(F.col("id").alias("x"), F.col("id").alias("seq"))
    for sketch, name in ((CountMin.build(df, "x", 8, 2), "estimate"), (SpaceSaving.build(df, "x", "seq", 3), "tracked")):
        with pytest.raises(ValueError, match=name):
            sketch.estimate(df.withColumn(name, F.lit(1)), "x")
    with pytest.raises(ValueError, match="contains"):
        BloomFilter.build(df, "x", 64, 2).contains(df.withColumn("Contains", F.lit(1)), "x")


def test_probes_meet_one_row_or_a_join(spark, monkeypatch):
    """Small sketches without keys are broadcast, and their probes are not shuffled; larger ones are joined: same answers."""
    df = spark.range(3_000).select((F.col("id") % 800).alias("x"))
    probes = spark.range(0, 1_600).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("x")).repartition(3)
    cms, bloom = CountMin.build(df, "x", 200, 3), BloomFilter.for_items(df, "x", 800, 0.05)
    plan = cms.estimate(probes, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [x" not in plan
    small = [sorted(map(tuple, out.collect()), key=str) for out in (cms.estimate(probes, "x"), bloom.contains(probes, "x"))]
    for module in ("frequency", "membership"):
        monkeypatch.setattr(f"rillmark.operators.{module}.BROADCAST_BYTES", 0)
    assert small == [sorted(map(tuple, out.collect()), key=str) for out in (cms.estimate(probes, "x"), bloom.contains(probes, "x"))]


def test_keys_stay_whole_after_a_join_on_them(spark):
    """Adaptive execution may split a join's partitions; a key is one stream and one digest all the same."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(60_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("seq"), (F.col("id") % 97).alias("x")).repartition(12)
        joined = df.join(df.groupBy("g").agg(F.max("x").alias("most")), "g")
        assert [r["num_tracked"] for r in SpaceSaving.build(joined, "x", "seq", 10, by="g").totals().collect()] == [10, 10]
        assert sorted(r["total"] for r in SpaceSaving.build(joined, "x", "seq", 10, by="g").table.select("g", "total").distinct().collect()) == [30_000, 30_000]
        for mode in ("sorted", "partial"):
            digest = TDigest.build(joined, "x", by="g", mode=mode)
            assert digest.table.groupBy("g", "pos").count().where("count > 1").isEmpty()
            assert digest.table.agg(F.sum("weight")).first()[0] == 60_000
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_sorted_digest_is_the_greedy_digest(spark):
    """Centroids end where a single pass over all values in order ends them; hot values, both signs, any partitions."""
    import numpy as np

    from rillmark.operators.quantiles import compress

    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.normal(size=4_000), np.full(3_000, 0.5), np.zeros(800), rng.lognormal(3, 2, 3_000), -rng.lognormal(1, 1, 900)])
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(xs)], "value double").repartition(7)
    got = TDigest.build(df, "value", 50.0).table.orderBy("pos").collect()
    mean, weight = compress(np.sort(xs), np.ones(len(xs), np.int64), 50.0)
    assert [r["weight"] for r in got] == weight.tolist() and np.allclose([r["mean"] for r in got], mean, rtol=1e-12, atol=1e-12)
    assert {(r["total"], r["low"], r["high"]) for r in got} == {(len(xs), xs.min(), xs.max())}


def test_families(spark):
    import rillmark as r

    df = spark.range(50).select(F.col("id").alias("x"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    got = build_all(df, None)
    assert isinstance(got["hll"], r.CardinalitySketch) and isinstance(got["sorted"], r.QuantileSketch)
    assert isinstance(got["cms"], r.FrequencySketch) and isinstance(got["space-saving"], r.FrequencySketch) and isinstance(got["space-saving"], r.HeavyHitters)
    assert isinstance(got["bloom"], r.MembershipSketch) and isinstance(got["reservoir"], r.SamplingSketch) and not isinstance(got["moments"], r.FrequencySketch)
    assert got["space-saving"].exceeding(df.select("x"), "x", 1).count() == 5


def test_sql_functions_and_views(spark):
    from rillmark import sqlapi

    df = items(spark, 3_000)
    assert set(sqlapi.register_functions(spark)) == set(sqlapi.FUNCTIONS)
    df.createOrReplaceTempView("sql_items")
    sketch = HyperLogLog.build(df, "item", 11)
    rows = spark.sql("SELECT idx, max(rho) AS rho, count(*) AS n FROM (SELECT sketch_register(h, 11) AS idx, sketch_rank(h, 11) AS rho FROM (SELECT sketch_hash(item) AS h FROM sql_items)) GROUP BY idx")
    assert sorted(rows.collect()) == sorted(sketch.table.collect())
    assert sqlapi.register_views(sketch, "users") == ["users", "users_estimate"]
    assert one(spark.sql("SELECT estimate FROM users_estimate"))["estimate"] == one(sketch.estimate())["estimate"]
    cells = spark.sql("SELECT DISTINCT sketch_cell(item, 1, 50) AS col FROM sql_items")
    assert {r["col"] for r in cells.collect()} == {r["col"] for r in CountMin.build(df, "item", 50, 2).table.where("row = 1").collect()}
    assert one(spark.sql("SELECT sketch_z_score(0.95) AS z, sketch_precision_for_error(0.01) AS p, sketch_hash(NULL) AS h, sketch_hash_fast(NULL) AS f")).asDict() == {"z": 1.96, "p": 14, "h": None, "f": None}
    assert "digest_median" in sqlapi.register_views(TDigest.build(values(spark, [1, 2, 3]), "value"), "digest")
