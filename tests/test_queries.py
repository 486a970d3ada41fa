"""Every registered query of the reference operators runs, and equals its SQL where there is one."""

import pytest
from pyspark.sql import functions as F

from tessitura.plans import registry
from tests.conftest import rows

QUERIES, ORACLES = registry()


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"recommend_all"}))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_recommendations_keep_the_rules(spark, sf):
    from tessitura.sources.star import Star

    got = QUERIES["recommend_all"](spark, sf).join(Star(spark, sf).songs().select("song_id", "genre_code"), "song_id").toPandas()
    assert got.groupby("user_id")["rank"].apply(lambda r: sorted(r) == list(range(1, len(r) + 1))).all()
    assert got.groupby(["user_id", "genre_code"]).size().max() <= 3
    assert got["score"].between(0, 1).all() and got["why"].str.startswith("{").all()


def test_a_serve_by_brute_force(spark, sf):
    """From the scores of all models on, one user's list is worked out in plain Python: blend, bonus, re-ranking of every row, rules."""
    import math

    from tessitura.functions import scalars as S
    from tessitura.operators import ensemble as E
    from tessitura.operators import serving as V
    from tessitura.plans import learned
    from tessitura.plans.serving import _prefs
    from tessitura.sources.star import Star

    s = Star(spark, sf)
    scored = learned.features_of(spark, sf)
    counts = {n: scored.select(f"s_{n}").distinct().limit(3).count() for n in E.FEATURES if n != "repeat_pen"}
    assert min(counts.values()) == 3, counts  # no model scores a constant
    prefs = {r["user_id"]: r for r in _prefs(s).collect()}
    user = next(u for u in sorted(prefs) if prefs[u]["blacklist"] and prefs[u]["anchor_song_id"] and scored.where(f"user_id = {u}").limit(1).count())
    rows = [r.asDict() for r in scored.join(s.audio_features().select("song_id", "bpm", "key_strength", F.col("danceability").alias("dance")), "song_id", "left").where(f"user_id = {user}").withColumn("title_bonus", S.title_bonus(F.col("title"), F.col("duration"))).collect()]
    weights = {r["user_id"]: list(r["weights"]) for r in learned._ensemble(spark, sf)[1].collect()}
    w = weights.get(user, weights[-1])
    clip = lambda x, a=0.0, b=1.0: max(a, min(b, x))
    for r in rows:
        z = sum(a * r[f"s_{n}"] for a, n in zip(w, E.FEATURES))
        bonus = r["title_bonus"]
        if r["bpm"] or r["key_strength"]:
            fit = math.exp(-0.5 * ((r["bpm"] - 120) / 35) ** 2) if r["bpm"] else 0.5
            bonus = round(clip((fit - 0.5) * 0.12 + ((r["key_strength"] or 0.5) - 0.5) * 0.08 + ((r["dance"] or 0.5) - 0.5) * 0.06, -0.05, 0.12), 4)
        r["score"] = clip(clip(clip(1 / (1 + math.exp(-z))) + bonus) + (0.05 if r["fresh"] else 0.0))
    vectors = {str(r["vec_id"]): r["embedding"] for r in s.raw("embeddings").collect()}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    level = prefs[user]["adventurous"] or 0.3
    lam = max(0.4, 0.7 - 0.04 * min(round(round(level * 10) / 10 * 5), 5))
    left, taken, near = sorted(rows, key=lambda r: (-r["score"], r["song_id"])), [], {}
    while left and len(taken) < 30:
        best = max(left, key=lambda r: lam * r["score"] - (1 - lam) * near.get(r["song_id"], 0.0))
        left.remove(best)
        taken.append(best)
        v = vectors.get(best["song_id"])
        for r in left:
            o = vectors.get(r["song_id"])
            if v is not None and o is not None:
                cos = sum(a * b for a, b in zip(v, o)) / (norm(v) * norm(o) + 1e-8)
                near[r["song_id"]] = max(near.get(r["song_id"], -2.0), cos)
    genres, out = {}, []
    for r in taken:
        if r["song_id"] not in prefs[user]["blacklist"] and genres.get(r["genre_code"], 0) < 3 and len(out) < 10:
            genres[r["genre_code"]] = genres.get(r["genre_code"], 0) + 1
            out.append(r["song_id"])
    anchor = prefs[user]["anchor_song_id"]
    if anchor not in out and any(t["song_id"] == anchor for t in taken):
        out[-1] = anchor
    served = QUERIES["recommend_all"](spark, sf)
    got = [r["song_id"] for r in served.where(f"user_id = {user}").orderBy("rank").collect()]
    assert got == out
    assert all(len(x) == len(V.PARTS) for x in [V.PARTS])


def test_a_serve_of_some_users(spark, sf):
    from tessitura.plans import learned

    top, cache = learned.recommend(spark, sf, users=[3, 4], top_k=5, slots=0, mood="gym")
    assert {r["user_id"] for r in top.collect()} == {3, 4} and top.groupBy("user_id").count().where("count > 5").count() == 0
    assert cache.where("rank > 200").count() == 0
    again, _ = learned.recommend(spark, sf, users=[3], cached=cache.where("user_id = 3"))
    assert again.count() == 10


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
