"""What is shuffled or scored more than once: plans and counts, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import ensemble as E
from tessitura.operators import models as M
from tessitura.operators import retrieval as R
from tessitura.sources.scratch import materialize


def _light(spark, n_users=400):
    """An ensemble of three models over ten songs, without fitting."""
    vector = lambda key, n: F.transform(F.sequence(F.lit(1), F.lit(E.RANK)), lambda i: F.sin(i * F.col(key).cast("double") + n).cast("float"))
    names = ["als", "two_tower", "sequence"]
    users = materialize(spark.range(n_users).withColumnRenamed("id", "user_id").select("user_id", *[vector("user_id", i).alias(f"u_{n}") for i, n in enumerate(names)]), "users")
    items = materialize(spark.range(10).select(F.col("id").cast("string").alias("song_id")).select("song_id", *[vector("song_id", i).alias(f"s_{n}") for i, n in enumerate(names)]), "items")
    frame = spark.range(n_users * 3).select((F.col("id") % n_users).alias("user_id"), (F.col("id") % 10).cast("string").alias("song_id"), F.lit(1.0).alias("plan_reward"), F.timestamp_seconds(F.col("id")).alias("timestamp"))
    edges = "src string, dst string, weight bigint", "src string, dst string, sim double"
    floors = spark.createDataFrame([("3", 1), ("77", 2)], "song_id string, pos int")
    tables = {"users": users, "items": items, "next": spark.createDataFrame([(1, "3", 0.1)], "user_id long, song_id string, p double"), "frame": materialize(frame, "frame"), "fresh": floors, "popular": floors, "co": spark.createDataFrame([("1", "3", 2)], edges[0]), "knn": spark.createDataFrame([("1", "3", 0.5)], edges[1])}
    return E.Ensemble.restored(tables, {"light": True}, spark.createDataFrame([("3",)], "song_id string"))


def _exchanges(plan, found):
    if plan.nodeName() == "Exchange":
        found.append({plan.output().apply(i).name() for i in range(plan.output().size())})
    inner = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else None
    children = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    for child in children:
        _exchanges(child, found)
    return found


def test_candidates_are_shuffled_without_vectors(spark):
    own = _light(spark)
    pairs = own.users.select("user_id").join(spark.createDataFrame([("3",), ("77",)], "song_id string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # songs are under it, users over it
    try:
        scored = own.score(pairs)
        shuffled = _exchanges(scored._jdf.queryExecution().executedPlan(), [])
        assert shuffled and not [names for names in shuffled if "song_id" in names and any(n.startswith("u_") for n in names)]
        got = {(r["user_id"], r["song_id"]): r for r in scored.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    users, items = ({r[0]: r for r in t.collect()} for t in (own.users, own.items))
    assert len(got) == 800
    for (user, song), r in got.items():
        assert abs(r["s_als"] - (float(np.dot(users[user]["u_als"], items[song]["s_als"])) if song in items else 0.0)) < 1e-5
        assert song in items or -0.25 <= r["s_two_tower"] <= 0.25
    assert abs(got[1, "3"]["s_sequence"] - got[1, "77"]["s_sequence"]) > 1e-3


def test_judged_pairs_are_scored_once(spark):
    own, calls = _light(spark), []
    score = own.score
    own.score = lambda candidates: calls.append(1) or score(candidates)
    own.songs = spark.createDataFrame([(str(i), 6) for i in range(10)], "song_id string, genre_code int")
    valid = own.frame.where("user_id < 20")
    weights = own.blender(valid)
    own.mood_blender(valid, weights).count()
    assert len(calls) == 1


def test_svd_score_makes_no_slices():
    assert "slice" not in str(M.svd_score(0.5, "x", "y", 8))


def test_keys_of_unlike_labels_are_found_without_a_join(spark):
    from tessitura.llm import simhash

    nodes = spark.createDataFrame([(i, 5, i % 2, i % 3) for i in range(6)], "node long, hi long, lo long, label long")
    assert "Join" not in simhash.unlinked(nodes)._jdf.queryExecution().optimizedPlan().toString()


def test_edges_reach_a_user_as_lists(spark, sf):
    """No edge is a row of a shuffle or meets the user's songs in a join."""
    from tessitura.plans import retrieval as P

    plan = P.flagship_topk_sparse(spark, sf)._jdf.queryExecution().executedPlan()
    assert "LeftAnti" not in plan.toString()
    shuffled = _exchanges(plan, [])
    assert {"user_id", "dsts", "ws"} in shuffled and not [names for names in shuffled if names & {"sim", "dst", "w", "sum"}]


@pytest.mark.parametrize("name", ["cast(id % 37 as bigint)", "cast(id % 37 - 5 as bigint)", "cast(id % 37 as string)", "(id % 37) * 300000000"])
def test_top_new_by_all_edges(spark, name):
    """Whatever the ids, and with users of several lists: as by the rows of item_knn and expand."""
    from pyspark.sql import Window

    frame = materialize(spark.range(900).selectExpr("(id * id + id div 7) % 41 as user_id", f"{name} as song_id", "timestamp_seconds(id) as timestamp", "1.0D as plan_reward").groupBy("user_id", "song_id").agg(F.max("timestamp").alias("timestamp"), F.max("plan_reward").alias("plan_reward")), "frame")
    knn = materialize(R.item_knn(frame, 9, long=4), "knn")
    up = frame.select("user_id", "song_id")
    degree = {r["song_id"]: r["count"] for r in up.groupBy("song_id").count().collect()}
    both = up.join(up.withColumnRenamed("song_id", "other"), "user_id").where("song_id <> other").groupBy("song_id", "other").count().collect()
    near = {}
    for r in both:
        near.setdefault(r["song_id"], []).append((-round(r["count"] / (degree[r["song_id"]] * degree[r["other"]]) ** 0.5, 9), r["other"]))
    assert {(r["src"], r["r"], r["dst"], r["sim"]) for r in knn.collect()} == {(s, i + 1, d, -w) for s, found in near.items() for i, (w, d) in enumerate(sorted(found)[:9])}
    left = R.expand(frame, knn, "sim", recent=3, fan=None).join(up, ["user_id", "song_id"], "left_anti")
    want = left.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("w"), "song_id"))).where("rank <= 6").select("user_id", "song_id", "w", "rank")
    got = R.top_new(frame, 6, k=9, recent=3, long=4)
    assert got.count() > 0 and sorted(got.collect()) == sorted(want.collect())


def test_pairs_do_not_meet_themselves(spark, monkeypatch):
    """The retriever's scores of the pairs are met by the next songs alone; a pair without a user or song has no row."""
    own, plans = _light(spark), []
    own.retriever.score = lambda candidates: candidates.withColumn("score", F.col("user_id") / 1000)
    pairs = spark.createDataFrame([(1, "3"), (1, "3"), (1, "77"), (2, "3"), (None, "3"), (1, None)], "user_id long, song_id string")
    store = E.materialize
    monkeypatch.setattr(E, "materialize", lambda df, label: (plans.append(df._jdf.queryExecution().analyzed().toString()) if label == "met" else None) or store(df, label))
    got = sorted((r["user_id"], r["song_id"], r["s_retriever"]) for r in own.score(pairs).collect())
    assert got == [(1, "3", 0.001), (1, "77", 0.001), (2, "3", 0.002)]
    assert len(plans) == 1 and plans[0].count("Join ") == 1
