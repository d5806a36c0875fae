"""Stored sketches, streams, and the catalogue."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rillmark import BloomFilter, CountMin, DecodeError, HyperLogLog, Moments, Reservoir, SpaceSaving, TDigest, load, save
from rillmark.streaming import windows


def test_round_trips(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 90).alias("item"), F.col("id").alias("seq"), F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    sketches = [
        HyperLogLog.build(df, "item", 10, by="k"),
        CountMin.build(df, "item", 50, 3),
        SpaceSaving.build(df, "item", "seq", 7),
        TDigest.build(df, "v", 50.0, by="k"),
        BloomFilter.build(df, "item", 640, 3),
        Reservoir.build(df, "seq", 20),
        Moments.build(df, "v", by="k"),
    ]
    for i, s in enumerate(sketches):
        save(s, f"{tmp_path}/{i}")
        back = load(spark, f"{tmp_path}/{i}")
        assert type(back) is type(s) and back.parameters() == s.parameters() and back.keys == s.keys
        assert sorted(back.table.collect()) == sorted(s.table.collect())
        if not isinstance(s, SpaceSaving):
            assert back.merge(s).table.count() > 0


def test_damaged_sketches(spark, tmp_path):
    df = spark.range(10)
    good = HyperLogLog.build(df, "id", 10)
    save(HyperLogLog(good.table.withColumn("rho", F.lit(99)), (), 10, "portable"), f"{tmp_path}/a")
    with pytest.raises(DecodeError):
        load(spark, f"{tmp_path}/a")
    save(HyperLogLog(good.table, (), 10, "portable"), f"{tmp_path}/b")
    spark.createDataFrame([('{"kind": "other"}',)], "record string").write.mode("overwrite").parquet(f"{tmp_path}/b/parameters")
    with pytest.raises(DecodeError):
        load(spark, f"{tmp_path}/b")


def _drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture()
def stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 7, "a" if m % 3 else "b", float(m)) for m in range(60)]
    df = spark.createDataFrame(rows, "ts string, item long, k string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/in")
    return windows.event_time(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "10 minutes"), df


def test_streamed_registers_are_the_batch_ones(spark, stream):
    live, batch = stream
    got = _drain(windows.hyperloglog(live, "item", "ts", "30 minutes", 6, by="k"), "t_hll", "complete")
    want = HyperLogLog.build(batch.withColumn("w", F.window(F.col("ts").cast("timestamp"), "30 minutes")["start"]), "item", 6, by=["w", "k"]).table
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert _drain(windows.bloom(live, "item", "ts", "30 minutes", 640, 3), "t_bloom", "complete").count() > 0
    assert _drain(windows.count_min(live, "item", "ts", "20 minutes", 32, 2, slide="10 minutes"), "t_cms", "append").count() > 0
    assert _drain(windows.moments(live, "v", "ts", "30 minutes", by="k", session_gap="2 minutes"), "t_moments", "append").count() > 0
    with pytest.raises(ValueError):
        windows.moments(live, "v", "ts", "30 minutes", session_gap="5 minutes")


def test_streamed_heavy_hitters(spark, stream):
    live, batch = stream
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = _drain(windows.space_saving(live, "item", "k", 10), "t_ss", "update")
        want = batch.groupBy("k", "item").count().collect()
        assert {(r["key"], int(r["item"])): (r["cnt"], r["err"]) for r in got.collect()} == {(r["k"], r["item"]): (r["count"], 0) for r in want}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_catalogue():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {"hll_by_event_type", "cms_estimate_all", "td_quantiles", "ss_top_k"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


def test_catalogue_without_sql(spark):
    """The ordered folds, over the whole small table, against a plain loop."""
    from rillmark.plans.catalog import QUERIES
    from tests.test_sketches import simulate

    d = "/root/testdata/sf0.001"
    stream = [r["user_id"] for r in spark.read.parquet(f"{d}/events.parquet").orderBy("ts", "event_id").collect()]
    items, counts, errors = simulate(stream, 20)
    want = sorted(range(len(items)), key=lambda i: (-counts[i], i))[:10]
    got = QUERIES["ss_top_k"](spark, d).orderBy("rank").collect()
    assert [(r["item"], r["cnt"], r["err"]) for r in got] == [(items[i], counts[i], errors[i]) for i in want]
    hits = QUERIES["ss_heavy_hitters"](spark, d).collect()
    assert {r["item"] for r in hits} == {x for x, c in zip(items, counts, strict=True) if c >= int(0.05 * len(stream))}
    exact = {x: stream.count(x) for x in set(stream)}
    for r in QUERIES["ss_error_guaranteed"](spark, d).collect():
        assert r["guaranteed_count"] <= exact[r["user_id"]]
    cells, n = {}, {}
    for x in stream:
        at = [(r, int(hashlib.md5(f"{r}:{x}".encode()).hexdigest()[:15], 16) % 64) for r in range(4)]
        new = min(cells.get(a, 0) for a in at) + 1
        for a in at:
            cells[a], n[a] = max(cells.get(a, 0), new), n.get(a, 0) + 1
    assert {(r["row"], r["col"]): (r["cnt"], r["n"]) for r in QUERIES["cms_conservative"](spark, d).collect()} == {a: (cells[a], n[a]) for a in cells}
