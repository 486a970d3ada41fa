"""Exact top-k of all products against all products, and what is left out."""

import numpy as np
import pytest

from tessitura.operators.topk import top_products, top_without


def tables(spark, users, songs):
    return (
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "user_id long, vector array<double>").repartition(3),
        spark.createDataFrame([(f"s{i:04d}", v.tolist()) for i, v in enumerate(songs)], "song_id string, vector array<double>").repartition(3),
    )


def brute(users, songs, k):
    out = set()
    for u, x in enumerate(users):
        scored = sorted((-round(float(x @ v), 9), f"s{i:04d}") for i, v in enumerate(songs))[:k]
        out |= {(u, r + 1, s, -p) for r, (p, s) in enumerate(scored)}
    return out


def rows(found):
    return {(r["user_id"], r["rank"], r["song_id"], round(r["score"], 9)) for r in found.rows.collect()}


def made(seed, n=400, size=6, spread=1.0):
    r = np.random.default_rng(seed)
    songs = r.normal(0, 1, (n, size)) * np.exp(r.normal(0, spread, (n, 1)))
    return r.normal(0, 1, (60, size)), songs


@pytest.mark.parametrize("seed,a_pass", [(1, 50), (2, 400), (3, 7), (4, 10_000)])
def test_as_all_products(spark, seed, a_pass):
    users, songs = made(seed)
    users[3], users[4] = 0, users[5]  # a user of length zero, and two alike
    songs[10:14] = songs[10]  # ties
    found = top_products(*tables(spark, users, songs), 5, songs_a_pass=a_pass)
    assert rows(found) == {(u, r, s, p + 0.0) for u, r, s, p in brute(users, songs, 5)}
    assert 0 < found.computed <= found.all == 60 * 400


def test_whole_numbers_with_ties_everywhere(spark):
    r = np.random.default_rng(0)
    users, songs = r.integers(-2, 3, (40, 3)).astype(float), r.integers(-2, 3, (300, 3)).astype(float)
    assert rows(top_products(*tables(spark, users, songs), 4, songs_a_pass=32)) == {(u, k, s, p + 0.0) for u, k, s, p in brute(users, songs, 4)}


def test_blocks_are_left_out(spark, monkeypatch):
    """Of songs of very unlike lengths most are never multiplied."""
    from tessitura.operators import topk

    monkeypatch.setattr(topk, "BLOCK", 20)
    users, songs = made(9, n=2000, spread=2.0)
    found = top_products(*tables(spark, users, songs), 3, songs_a_pass=100)
    assert rows(found) == brute(users, songs, 3) and found.computed < 0.2 * found.all


def test_odd_tables(spark):
    users, songs = made(5, n=3)
    u, s = tables(spark, users, songs)
    assert rows(top_products(u, s, 10)) == brute(users, songs, 10)  # fewer songs than asked for
    assert top_products(u, s.limit(0), 4).rows.count() == 0 == top_products(u.limit(0), s, 4).rows.count()
    odd = s.unionByName(spark.createDataFrame([(None, [1.0] * 6), ("x", None)], "song_id string, vector array<double>"))
    assert rows(top_products(u, odd, 2)) == brute(users, songs, 2)


def test_without_a_users_own(spark):
    users, songs = made(7, n=80)
    songs[20:40] = 0  # ties
    own = {(u, f"s{i:04d}") for u in range(60) for i in range(u % 9, 80, 11)}
    got = top_without(*tables(spark, users, songs), spark.createDataFrame(sorted(own), "user_id long, song_id string"), 30, 8, places=3)
    want = set()
    for u, x in enumerate(users):
        scored = sorted((-round(float(x @ v), 3) + 0.0, f"s{i:04d}") for i, v in enumerate(songs) if (u, f"s{i:04d}") not in own)[:30]
        want |= {(u, r + 1, s, -p + 0.0) for r, (p, s) in enumerate(scored)}
    assert {(r["user_id"], r["rank"], r["song_id"], r["score"]) for r in got.collect()} == want


def test_exact_factors_rank_all_songs(spark, sf, tmp_path):
    """The query by brute force over more songs than the candidate sources give a user."""
    from pyspark.sql import functions as F

    from tessitura.operators import models as M
    from tessitura.operators import retrieval as R
    from tessitura.plans.frames import frame_of
    from tessitura.plans.learned import als_exact_topk
    from tessitura.sources.scratch import materialize

    part = spark.read.parquet(f"{sf}/part.parquet").crossJoin(spark.range(8).withColumnRenamed("id", "__i"))
    copies = part.withColumn("p_partkey", F.expr("cast(p_partkey + 200 * __i as bigint)")).withColumn("p_retailprice", F.col("p_partkey") * 1.0)
    copies.drop("__i").write.parquet(d := str(tmp_path / "part.parquet"))
    # users without a song in common, and songs that are neither much viewed nor in the newest feed
    own = F.format_string('{"k": %d}', F.get_json_object("props", "$.k").cast("int") + 100 * F.col("user_id"))
    spark.read.parquet(f"{sf}/events.parquet").where("user_id < 4").withColumn("props", own).write.parquet(str(tmp_path / "events.parquet"))
    frame = materialize(frame_of(spark, str(tmp_path)), "frame")
    users, items = ({r[0]: np.array(r["vector"]) for r in t.collect()} for t in M.exact_als(frame, materialize, rank=8, iterations=2))
    heard = {(r["user_id"], r["song_id"]) for r in R.last(frame, 60).collect()}
    songs = [str(r["p_partkey"]) for r in spark.read.parquet(d).select("p_partkey").collect()]
    assert users and len(songs) == 1600
    want = set()
    for u, x in users.items():
        scored = sorted((-round(float(x @ items[s]), 6) + 0.0 if s in items else 0.0, s) for s in songs if (u, s) not in heard)[:10]
        want |= {(u, r + 1, s, -p + 0.0) for r, (p, s) in enumerate(scored)}
    assert {tuple(r) for r in als_exact_topk(spark, str(tmp_path)).collect()} == want
