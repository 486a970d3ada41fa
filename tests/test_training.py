"""Training runs, the registry, caches, jobs, the tool server and streams in several batches."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura import tools
from tessitura.operators import catalog, training
from tessitura.streaming import signals


def test_runs_and_registry(spark, sf, tmp_path):
    from tessitura.plans.learned import train

    empty = spark.createDataFrame([], training.HISTORY)
    report, rows = train(spark, sf, empty, "light", now="2024-02-01")
    r = report.first()
    assert 0 <= r["ndcg"] <= 1 and 0 < r["coverage"] <= 1 and r["promoted"] and len(r["frame_hash"]) == 16
    assert r["peak_memory_mb"] > 0 and "history" in r["config"] and r["commit_id"] and 0 < r["loss"] < training.M.UNFITTED and r["blender_accuracy"] is None
    assert [x["key"] for x in rows.orderBy("id").collect()] == ["staging", "prod"]
    again, more = train(spark, sf, rows, "deep")
    a = again.first()
    assert a["ndcg"] == pytest.approx(r["ndcg"], abs=1e-6) and not a["promoted"] and [x["key"] for x in more.collect()] == ["staging"]  # no better than itself
    assert 0.4 <= a["blender_accuracy"] <= 1
    assert train(spark, sf, rows, "smoke")[1].count() == 0
    with pytest.raises(ValueError):
        train(spark, sf, rows, "other")


def test_lock_and_missing_files(spark, tmp_path):
    import os
    import time

    lock = f"file://{tmp_path}/train.lock"
    assert training.acquire_lock(spark, lock) and not training.acquire_lock(spark, lock)
    os.utime(tmp_path / "train.lock", (time.time() - 5 * 3600,) * 2)
    assert training.acquire_lock(spark, lock)
    training.release_lock(spark, lock)
    assert training.acquire_lock(spark, lock)
    a = spark.createDataFrame([("r", "als", lock), ("r", "svd", f"file://{tmp_path}/gone"), ("s", "svd", "x")], "run_id string, model_name string, model_path string")
    assert training.missing_files(spark, a, "r") == [f"file://{tmp_path}/gone"]


def test_roll_back_flips(spark):
    h = spark.createDataFrame([(1, "prod", "a", "v", 0.1, 0.1, None), (2, "prod", "b", "v", 0.2, 0.1, None)], training.HISTORY)
    for want in ("a", "b", "a"):
        h = h.unionByName(training.roll_back(h))
        assert catalog.registry(h).first()["run_id"] == want


def test_cache_expires(spark, tmp_path):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 201)], "user_id long, song_id string, rank int")
    training.cache_top(ranked, str(tmp_path / "c"), "2024-01-01 00:00:00")
    assert training.read_cache(spark, str(tmp_path / "c"), "2024-01-02 01:00:00").count() == 1
    assert training.read_cache(spark, str(tmp_path / "c"), "2024-01-02 03:00:00").count() == 0


def test_jobs_are_logged():
    log = []

    @training.job(log)
    def good():
        return 1

    @training.job(log, "named")
    def bad():
        raise KeyError("x")

    assert good() == 1
    with pytest.raises(KeyError):
        bad()
    assert [(r["job"], r["ok"]) for r in log] == [("good", 1), ("named", 0)] and "KeyError" in log[1]["note"]
    assert training.lock_is_stale(4) and not training.lock_is_stale(3.9) and training.due_weekly(7.1) and not training.due_weekly(7)


def test_synthetic_population(spark):
    d = training.synthetic_interactions(spark, 300, 1000, 40).cache()
    n = d.count()
    assert d.exceptAll(training.synthetic_interactions(spark, 300, 1000, 40).repartition(3)).count() == 0 and d.select("user_id", "song_id").distinct().count() == n
    top = d.groupBy("song_id").count().orderBy(F.desc("count")).limit(50).agg(F.sum("count")).first()[0]
    assert top > 0.15 * n  # the head of Zipf's law
    by_genre = d.withColumn("g", F.col("song_id").cast("int") % 20).groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("c"), F.avg("reward").alias("r"))
    three = by_genre.withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("c")))).groupBy((F.col("p") <= 3).alias("best")).agg(F.sum("c").alias("c"), F.avg("r").alias("r")).collect()
    best, rest = sorted(three, key=lambda r: not r["best"])
    assert 0.6 < best["c"] / n < 0.9 and best["r"] > rest["r"] + 0.3
    songs = training.synthetic_catalog(spark, 4000)
    m = songs.agg(F.avg(F.log("view_count")).alias("mean"), F.stddev(F.log("view_count")).alias("spread"), F.min("view_count").alias("least"), F.max(F.col("like_count") / F.col("view_count")).alias("share")).first()
    assert abs(m["mean"] - 12) < 0.2 and abs(m["spread"] - 2) < 0.2 and m["least"] >= 1000 and m["share"] <= 0.15


def test_tool_server(spark):
    call = lambda name: spark.createDataFrame([(name,)], "q string")
    assert tools.answer({"id": 1, "method": "initialize"}, call)["result"]["protocolVersion"] == tools.VERSION
    assert len(tools.answer({"id": 2, "method": "tools/list"}, call)["result"]["tools"]) == 7
    assert "emotion_now" in tools.answer({"id": 3, "method": "tools/call", "params": {"name": "emotion_now"}}, call)["result"]["content"][0]["text"]
    rows = lambda name: spark.createDataFrame([(u, r) for u in (1, 2) for r in range(1, 6)], "user_id long, rank int")
    some = tools.answer({"id": 7, "method": "tools/call", "params": {"name": "recommend", "arguments": {"user_id": 2, "top_k": 3}}}, rows)["result"]["content"][0]["text"]
    assert some.count('"user_id": 2') == 3 and '"user_id": 1' not in some
    assert tools.answer({"id": 4, "method": "tools/call", "params": {"name": "no"}}, call)["error"]["code"] == -32602
    assert tools.answer({"id": 5, "method": "other"}, call)["error"]["code"] == -32601
    assert tools.answer({"method": "notifications/initialized"}, call) is None and tools.answer({"id": 6, "method": "ping"}, call)["result"] == {}


def test_tools_take_arguments(spark, sf):
    """One user's list is that user's part of everybody's; seeds and songs are those asked for."""
    from tessitura.operators import affect
    from tessitura.plans import learned
    from tessitura.sources.star import Star

    direct = tools.with_arguments(spark, sf)
    ask = lambda name, **a: json.loads(tools.answer({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}, None, direct=direct)["result"]["content"][0]["text"])
    user = learned._unseen(spark, sf).first()["user_id"]
    everyone = {r["song_id"]: r["rank"] for r in learned.recommend(spark, sf, top_k=3)[0].where(f"user_id = {user}").collect()}
    assert {r["song_id"]: r["rank"] for r in ask("recommend", user_id=user, top_k=3)} == everyone and len(everyone) == 3
    f = Star(spark, sf).audio_features()
    near = lambda **o: [r["song_id"] for r in affect.feel_like(f, n=4, **o).collect()]
    assert [r["song_id"] for r in ask("feel_like", song_id="7", limit=4)] == near(song_id="7")
    assert [r["song_id"] for r in ask("feel_like", bpm=90, valence=0.9, limit=4)] == near(seed=affect.feel_seed(bpm=90, valence=0.9))
    assert [r["song_id"] for r in ask("dossier", song_id="8")] == ["8"] and ask("dossier", song_id="none") == []
    assert tools.answer({"id": 1, "method": "tools/call", "params": {"name": "recommend", "arguments": {"user_id": "x"}}}, None, direct=direct)["error"]["code"] == -32602


def test_stream_in_batches_equals_batch(spark, sf, tmp_path):
    """Events over several files and micro-batches give the posteriors of one batch."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(3):
        e.where(f"event_id % 3 = {i}").coalesce(1).toPandas().to_parquet(tmp_path / f"events-{i}.parquet", coerce_timestamps="us")
    stream = signals.running_posteriors(signals.read_events(spark, str(tmp_path)))
    got = signals.drain(stream, "posteriors_by_batch", str(tmp_path / "checkpoint"))
    want = signals.running_posteriors(e.withColumn("song_id", F.get_json_object("props", "$.k")))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_sessions_close(spark, sf, tmp_path):
    s = signals.sessions(signals.read_events(spark, sf))
    assert signals.drain(s, "sessions_all", str(tmp_path / "c"), "complete").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_frozen_vocabulary(spark):
    titles = spark.createDataFrame([("a", "Red red widget"), ("b", "")], "song_id string, title string")
    vocabulary = spark.createDataFrame([("red", 2.0)], "term string, idf double")
    assert signals.refreshed_terms(titles, vocabulary).agg(F.sum("weight")).first()[0] == pytest.approx(4 / 3)
