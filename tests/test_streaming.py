"""Streams that have ended give what a batch over the same rows gives."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallymark.operators.scoring import with_scores
from tallymark.sources import tables
from tallymark.streaming.clusters import STORE, diversity_stream
from tallymark.streaming.replay import shadow_replay
from tallymark.streaming.sessions import call_sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    yield
    spark.conf.set(name, before)


def files(df, path, n):
    """The rows as n files, which a stream takes one after another, by their times."""
    seen = set()
    for i in range(n):
        df.filter(F.col("ordinal") % n == i).coalesce(1).write.mode("append").parquet(str(path))
        for f in set(path.glob("*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + i * 100,) * 2)
            seen.add(f)
    return path


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def finished(df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name)


def dated(spark):
    return tables.calls_events(spark, SF).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ordinal") * 60))


def test_diversity_equals_batch(spark, tmp_path, rocks):
    calls = dated(spark).withColumn("output_excerpt", F.when(F.col("ordinal") % 50 == 0, "").when(F.col("ordinal") % 3 == 0, F.concat(F.lit("Out "), (F.col("ordinal") % 211).cast("string"))).otherwise(F.col("output_excerpt")))
    s = stream(spark, files(calls, tmp_path / "in", 3), calls.schema)
    rows = finished(diversity_stream(s), "diversity", tmp_path)
    got = {r["call_id"]: r["v"] for r in rows.groupBy("call_id").agg(F.max_by("low_output_diversity", "revision").alias("v")).collect()}
    want = {r["call_id"]: r["v"] for r in with_scores(calls).select("call_id", F.col("signals.low_output_diversity").alias("v")).collect()}
    assert got == want and set(want.values()) == {0.0, 0.6, 1.0}
    assert rows.groupBy("call_id").count().agg(F.max("count")).first()[0] > 1  # some rows were put right


def test_idle_clusters_are_forgotten(spark, tmp_path, rocks):
    at = [(0, "a"), (60, "a"), (100_000, "b"), (200_000, "b"), (300_000, "a")]
    calls = spark.createDataFrame([(str(i), "m", o, 1, t, i) for i, (t, o) in enumerate(at)], "call_id string, model string, output_excerpt string, weight bigint, t bigint, ordinal bigint").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    s = stream(spark, files(calls, tmp_path / "in", 5), calls.schema)
    rows = finished(diversity_stream(s, time="ts", late="1 minute", keep=3600), "idle", tmp_path)
    got = {r["call_id"]: r["v"] for r in rows.groupBy("call_id").agg(F.max_by("low_output_diversity", "revision").alias("v")).collect()}
    assert got == {"0": 0.6, "1": 0.6, "2": 0.0, "3": 0.0, "4": 0.0}
    with pytest.raises(ValueError):
        diversity_stream(calls, keep=1)


def test_shadow_replay(spark, tmp_path):
    calls = dated(spark).select("call_id", "model", "output_excerpt", "ts", "ordinal")
    i = F.col("ordinal")
    wait = F.when(i % 10 == 0, 3600).when(i % 10 == 1, -5).otherwise(i % 500)
    answers = calls.filter("ordinal % 7 != 0").select("call_id", F.when(i % 2 == 0, F.upper("output_excerpt")).otherwise("other").alias("answer"), (F.col("ts") + F.make_dt_interval(secs=wait)).alias("ts"), "ordinal")
    batch = shadow_replay(calls, answers)
    want = sorted(map(tuple, batch.collect()))
    assert len(want) == calls.count() and {r[-1] for r in want} == {True, False, None} if None in {r[-1] for r in want} else True
    late = "2000 days"  # files are not in order of time here
    s = [stream(spark, files(df, tmp_path / n, 2), df.schema) for n, df in (("calls", calls), ("answers", answers))]
    rows = finished(shadow_replay(*s, late=late), "replay", tmp_path)
    met = [r for r in want if r[4] is not None]
    assert sorted(map(tuple, rows.filter("answer is not null").collect())) == met and len(met) > 100


def test_replay_gives_up_after_the_limit(spark, tmp_path):
    rows = [("a", 0, "yes"), ("b", 60, "no"), ("z", 90_000, "end"), ("y", 190_000, "end")]
    calls = spark.createDataFrame([(c, "m", o, t, i) for i, (c, t, o) in enumerate(rows)], "call_id string, model string, output_excerpt string, t bigint, ordinal bigint").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    answers = spark.createDataFrame([("a", "Yes ", 30, 0), ("b", "no", 5_000, 1), ("z", "x", 90_001, 2), ("q", "x", 190_000, 3)], "call_id string, answer string, t bigint, ordinal bigint").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    s = [stream(spark, files(df, tmp_path / n, 4), df.schema) for n, df in (("calls", calls), ("answers", answers))]
    got = {r["call_id"]: (r["answer"], r["agrees"], r["delay_ms"]) for r in finished(shadow_replay(*s), "limit", tmp_path).collect()}
    assert got["a"] == ("Yes ", True, 30_000) and got["z"] == ("x", False, 1_000)
    assert got["b"] == (None, None, None)  # its answer came too late


def test_sessions_of_a_stream(spark, tmp_path):
    calls = dated(spark).withColumn("user", F.col("ordinal") % 5).withColumn("ts", F.when(F.col("ordinal") > 100, F.col("ts") + F.make_dt_interval(days=F.lit(400))).otherwise(F.col("ts")))
    twice = calls.union(calls)
    batch = call_sessions(twice, "user", gap="30 minutes", once=["call_id", "ts"])
    s = stream(spark, files(twice, tmp_path / "in", 2), calls.schema)
    rows = finished(call_sessions(s, "user", gap="30 minutes", late="900 days", once=["call_id"]), "sessions", tmp_path, "complete")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 10
