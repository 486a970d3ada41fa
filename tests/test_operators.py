"""Worked values, edge cases and properties of the reference operators."""

import json
import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.operators import affect, catalog, content, interactions, models, retrieval, serving
from tessitura.sources import schemas

NOW = "2024-02-01 00:00:00"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("pct", "reward", "conf", "alias"), [(0.80, 3, 7, 7), (0.79, 1, 3, 11), (0.30, 1, 3, 11), (0.29, -2, 1, 1), (None, -2, 1, 1)])
def test_rewards(spark, pct, reward, conf, alias):
    r = S.completion_reward(F.lit(pct).cast("double"))
    assert one(spark, r) == reward
    assert one(spark, S.confidence(r)) == conf
    assert one(spark, S.confidence(r, legacy_alias=True)) == alias


def test_decay(spark):
    assert one(spark, S.half_life(F.lit(7.0), F.lit(30.0), 30.0)) == 3.5
    assert one(spark, S.half_life(F.lit(7.0), F.lit(-1.0), 30.0)) == 7.0
    assert one(spark, S.recency(F.lit(None).cast("timestamp"), NOW)) == pytest.approx(0.3)
    assert one(spark, S.freshness(F.lit("not a day"), NOW)) == 0.5


@pytest.mark.parametrize(("level", "slots"), [(1, 0), (3, 2), (5, 2), (7, 4), (10, 5)])
def test_slots_round_half_even(spark, level, slots):
    assert one(spark, S.exploration_slots(F.lit(float(level)))) == slots


@pytest.mark.parametrize(("bpm", "fit"), [(120.0, 1.0), (155.0, 0.6065), (0.0, 0.5), (None, 0.5)])
def test_tempo(spark, bpm, fit):
    assert one(spark, S.tempo_fit(F.lit(bpm).cast("double"))) == pytest.approx(fit, abs=1e-4)


@pytest.mark.parametrize(("title", "code"), [("lofi hip hop beats", 1), ("Popular songs", 20), ("K-Pop mix", 13), ("R&B night", 5), ("", 20), ("popé rap", 2), (None, 20)])
def test_genre(spark, title, code):
    assert one(spark, S.genre(F.lit(title).cast("string"), F.lit(""))) == code


@pytest.mark.parametrize(("title", "code"), [("हिंदी", 1), ("사랑", 4), ("夜", 8), ("Canción", 3), ("plain", 0)])
def test_language(spark, title, code):
    assert one(spark, S.language(F.lit(title))) == code


def test_titles(spark):
    ok = lambda a, b: one(spark, S.title_ok(F.lit(a), F.lit(b)))
    assert ok("Night Drive (Official Video)", "night drive lyrics") and not ok("Afsana Dil", "4am")
    assert ok("the official", "anything")
    assert one(spark, S.words(F.lit("Éléphant, 夜 can't!"))) == ["éléphant", "夜", "cant"]


def test_fifths(spark):
    d = lambda a, b, e=True: one(spark, S.fifth_distance(F.lit(a), F.lit(b), e))
    assert (d("C", "G"), d("C", "F#"), d("C", "H"), d("D#", "Bb"), d("D#", "Bb", False)) == (1, 6, 6, 1, 6)
    assert dict(S.interval_table())[7] > dict(S.interval_table())[6]


def frame_of(spark, rows):
    return spark.createDataFrame([(u, s, float(p), (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=t)).to_pydatetime()) for u, s, p, t in rows], "user_id long, song_id string, plan_reward double, timestamp timestamp")


def test_frame_precedence(spark):
    li = spark.createDataFrame([(1, 1, "a", 0.9), (2, 1, "a", 0.1), (3, 1, "b", None)], "id long, user_id long, song_id string, completion_pct double").withColumn("started_at", F.lit("2024-01-02").cast("timestamp"))
    fb = spark.createDataFrame([(1, 1, "b", 1), (2, 1, "b", -1)], "id long, user_id long, song_id string, signal int").withColumn("created_at", F.lit("2024-01-02").cast("timestamp"))
    got = {r["song_id"]: (r["plan_reward"], r["source"]) for r in interactions.frame(li, fb, NOW).collect()}
    assert got == {"a": (3.0, "listen"), "b": (-5.0, "feedback")}
    assert interactions.frame(li.limit(0), fb.limit(0), NOW).count() == 0


def test_cutoff_is_exact(spark):
    f = frame_of(spark, [(1, f"s{i}", 1, i) for i in range(20)])
    assert interactions.cutoff(f) == pd.Timestamp("2024-01-01 00:17:00")
    assert interactions.cutoff(f.limit(0)) is None


def test_split_guards(spark):
    only = interactions.split(frame_of(spark, [(1, "a", 1, 0), (1, "b", 1, 1)]))
    assert {r["part"] for r in only.collect()} == {"train", "valid"}
    assert interactions.split(frame_of(spark, [(1, "a", 1, 0)]).limit(0)).count() == 0


def test_hits(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3)], "user_id long, song_id string, rank int")
    valid = frame_of(spark, [(1, s, 1, 0) for s in "abcd"])
    h = interactions.hits(ranked, valid, 3).first()
    assert h["recall"] == 0.5 and h["ndcg"] == pytest.approx(0.9197, abs=1e-4) and h["hitrate"] == 1.0


def test_knn_cosine(spark):
    f = frame_of(spark, [(u, "a", 1, u) for u in (1, 2, 3)] + [(u, "b", 1, 10 + u) for u in (2, 3, 4, 5)])
    assert retrieval.item_knn(f).where("src = 'a'").first()["sim"] == pytest.approx(2 / math.sqrt(12), abs=1e-6)


def test_posterior(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "a", -1.0), (1, "a", 0.0)], "user_id long, song_id string, reward double")
    r = content.posteriors(d).first()
    assert (r["alpha"], r["beta"], r["n_pulls"]) == (3.0, 2.0, 4)
    arms = content.posteriors(d)
    assert content.thompson(arms, "s").first()["theta"] == content.thompson(arms.repartition(3), "s").first()["theta"]


def test_upsert(spark):
    old = spark.createDataFrame([("a", "old", 5, 1)], "song_id string, title string, view_count long, times_fetched int")
    new = spark.createDataFrame([("a", "new", 3, 1, 0), ("a", "newer", 9, 1, 1), ("b", "b", 1, 1, 0)], "song_id string, title string, view_count long, times_fetched int, seq int")
    got = {r["song_id"]: tuple(r)[1:] for r in catalog.upsert(old, new, ["song_id"], {"title": "old", "view_count": "max", "times_fetched": "count"}).collect()}
    assert got == {"a": ("old", 9, 3), "b": ("b", 1, 1)}


def test_metadata_source(spark, tmp_path):
    good = {"id": "x", "title": "Fire remix (official)", "uploader": "u", "duration": 200, "view_count": 50_000, "like_count": 900, "upload_date": "20240131", "description": "edm"}
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(good), "{broken", json.dumps(good | {"id": "y", "view_count": 10}), json.dumps(good | {"id": "z", "duration": 700})]))
    songs = catalog.parse(catalog.read_metadata(spark, str(tmp_path)), NOW).collect()
    assert [(s["song_id"], s["genre_code"], s["has_official"], s["has_remix"]) for s in songs] == [("x", 4, 1, 1)]
    assert songs[0]["raw_score"] > 0


def test_deep_queries(spark):
    q = catalog.deep_queries(spark, ["A"], ["chill", "chill"], ["top 50"], ["A"])
    assert q.orderBy("pos").first()["query"] == "A discography full songs" and q.count() == 2 + 1 + 1 + 3


def metadata(spark, rows):
    base = {"title": "Fire remix", "uploader": "u", "duration": 200.0, "view_count": 50_000, "like_count": 900, "upload_date": "20240131", "description": "edm", "channel": None, "channel_id": None, "thumbnail": None}
    return spark.createDataFrame([base | r for r in rows], catalog.METADATA + ", pos int")


def test_deep_feed_and_refresh(spark):
    info = metadata(spark, [{"id": "a", "pos": 0}, {"id": "b", "pos": 1, "view_count": 900_000}, {"id": "a", "pos": 2, "view_count": 80_000}, {"id": "low", "pos": 3, "view_count": 5}, {"id": "old", "pos": 4}])
    known = spark.createDataFrame([("old", "was", 10, 1, "sad", "2024-01-01")], "song_id string, title string, view_count long, times_fetched int, mood_tags string, last_seen string").withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    got = catalog.deep_feed(info, known, NOW).orderBy("rank_in_snapshot").collect()
    assert [(r["song_id"], r["view_count"], r["rank_in_snapshot"]) for r in got] == [("b", 900_000, 1), ("a", 50_000, 2)]
    old = spark.createDataFrame([("2024-01-20", "x", 1, 1.0), ("2024-01-30", "y", 1, 1.0)], "d string, song_id string, rank_in_snapshot int, raw_score double").select(F.col("d").cast("date").alias("snapshot_id"), "song_id", "rank_in_snapshot", "raw_score")
    songs, feeds = catalog.refresh(info, known, old, NOW)
    merged = {r["song_id"]: (r["title"], r["view_count"], r["times_fetched"], r["mood_tags"]) for r in songs.collect()}
    assert merged == {"old": ("was", 50_000, 2, "sad"), "a": ("Fire remix", 50_000, 1, ""), "b": ("Fire remix", 900_000, 1, "")}
    assert {(str(r["snapshot_id"]), r["song_id"]) for r in feeds.collect()} == {("2024-01-30", "y"), ("2024-02-01", "a"), ("2024-02-01", "b"), ("2024-02-01", "old")}


def test_first_come_is_the_rows_own_place(spark):
    """Whatever the order of rows and the number of partitions."""
    given = [{"id": "a", "pos": 0}, {"id": "a", "pos": 2, "view_count": 80_000}, {"id": "b", "pos": 1, "view_count": 70_000}, {"id": "b", "pos": 4}, {"id": "a", "pos": 3, "view_count": 90_000}]
    known = spark.createDataFrame([], "song_id string")
    for rows in (given, given[::-1], given[2:] + given[:2]):
        for n in (1, 64):
            got = catalog.deep_feed(metadata(spark, rows).repartition(n), known, NOW).collect()
            assert {(r["song_id"], r["view_count"]) for r in got} == {("a", 50_000), ("b", 70_000)}


def test_preference_commands(spark):
    prefs = spark.createDataFrame([(1, ["a"], None, 0.3), (2, [], "z", 0.5)], "user_id long, blacklist array<string>, anchor_song_id string, adventurous double")
    cmds = spark.createDataFrame([(1, 2, "never", "c"), (1, 1, "never", "b"), (1, 3, "never", "a"), (1, 4, "adventurous", "99"), (3, 1, "anchor", "x"), (3, 2, "anchor", "y")], "user_id long, seq int, command string, argument string")
    got = {r["user_id"]: (r["blacklist"], r["anchor_song_id"], r["adventurous"]) for r in catalog.apply_commands(prefs, cmds).collect()}
    assert got == {1: (["a", "b", "c"], None, 1.0), 2: ([], "z", 0.5), 3: ([], "y", 0.3)}
    assert catalog.apply_commands(prefs, cmds, keep=2).where("user_id = 1").first()["blacklist"] == ["b", "c"]


def test_bloom(spark):
    def slots(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return [(h * p + p * p) % 2_000_003 for p in (2, 3, 5, 7, 11, 13, 17)]

    keys = ["", "a", "日本", "x" * 300, "dQw4w9WgXcQ"]
    d = spark.createDataFrame([(k,) for k in keys], "song_id string")
    assert {r["song_id"]: r["s"] for r in d.select("song_id", catalog.bloom_slots(F.col("song_id")).alias("s")).collect()} == {k: slots(k) for k in keys}
    bits = catalog.bloom_filter(d.limit(3))
    assert {r["song_id"] for r in catalog.bloom_unseen(d, bits).collect()} == set(keys[3:])


def test_brief_and_announcements(spark, sf):
    from tessitura.sources.star import Star

    f = Star(spark, sf).audio_features()
    mood = spark.createDataFrame([("quiet warm", 0.25, 0.5, 3)], "label string, arousal double, valence double, n int")
    taste = spark.createDataFrame([("C", 120.04, 0.5)], "home_key string, bpm_mean double, valence_mean double")
    text = affect.brief(f, mood, taste, 2).first()["brief"].split("\n")
    assert text[:3] == ["Mood now: quiet warm (arousal 0.25, valence 0.5, n=3)", "Taste home: C about 120.0 BPM, valence  0.5", f"Heard: {f.count()}"] and len(text) == 5
    assert affect.brief(f, mood.limit(0), taste.limit(0), 2).first()["brief"].startswith("Mood now: unheard")
    said = affect.announcements(f, Star(spark, sf).songs(), 3).collect()
    assert len(said) == 3 and all(": " in r["text"] for r in said)


def test_feedback_is_taken_in(spark):
    schema = "id long, user_id long, song_id string, rec_session_id string, signal int, created_at timestamp"
    history = spark.createDataFrame([(i, 1, "a", None, -1, None) for i in range(3)] + [(9, 2, "b", None, 1, None)], schema)
    batch = spark.createDataFrame([(10, 1, "a", "s", -1, None), (11, 1, "c", "s", 1, None), (12, 1, "c", "s", -1, None), (13, 3, "a", "s", 1, None)], schema)
    rows, status, arms = serving.record_feedback(history, batch, "v2")
    assert rows.count() == 4 and {r["model_version"] for r in rows.collect()} == {"v2"}
    assert [(r["id"], r["dislike_count"], r["auto_disabled"]) for r in status.orderBy("id").collect()] == [(10, 4, False), (11, 4, False), (12, 5, True), (13, 0, False)]
    assert {(r["user_id"], r["song_id"]): (r["alpha"], r["beta"]) for r in arms.collect()} == {(1, "a"): (1.0, 5.0), (1, "c"): (2.0, 2.0), (3, "a"): (2.0, 1.0)}


def test_conform(spark):
    got = schemas.conform(spark.createDataFrame([("a", 1)], "song_id string, extra int"), "songs")
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in schemas.schema("songs")] and got.first()["genre_code"] == 20


def test_rollback(spark):
    h = spark.createDataFrame([(1, "prod", "r1"), (2, "prod", "r2"), (3, "prod", "r2"), (4, "staging", "r9")], "id long, key string, run_id string")
    assert catalog.rollback(h, "prod").first()["run_id"] == "r1"
    assert catalog.rollback(h, "none").count() == 0


def test_anchor(spark):
    ranked = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "a", 0.9, 1)], "user_id long, song_id string, score double, rank int")
    pool = spark.createDataFrame([(1, "z", 0.1), (2, "z", 0.1)], "user_id long, song_id string, score double")
    prefs = spark.createDataFrame([(1, "z"), (2, "z"), (3, "z")], "user_id long, anchor_song_id string")
    got = sorted(map(tuple, serving.anchor(ranked, pool, prefs).select("user_id", "rank", "song_id").collect()))
    assert got == [(1, 1, "a"), (1, 2, "z"), (2, 1, "a"), (2, 2, "z")]


def test_mmr_spreads(spark):
    ranked = spark.createDataFrame([(1, s, x, 0) for s, x in (("a", 1.0), ("b", 0.99), ("c", 0.9))], "user_id long, song_id string, score double, genre_code int")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0])], "song_id string, vector array<double>")
    got = [r["song_id"] for r in serving.mmr(ranked, vectors, 3).orderBy("rank").collect()]
    assert got == ["a", "c", "b"]


@pytest.mark.parametrize("with_vectors", [True, False])
def test_mmr_by_brute_force(spark, with_vectors):
    """Every row of a user takes part, also those far down the list."""
    import random

    rng = random.Random(5)
    rows = [(u, f"s{i}", round(rng.random(), 3), i % 4) for u in (1, 2) for i in range(90)]
    vectors = {f"s{i}": [rng.gauss(0, 1) for _ in range(5)] for i in range(90) if i % 7}
    v = spark.createDataFrame(list(vectors.items()), "song_id string, vector array<double>") if with_vectors else None
    got = {(r["user_id"], r["rank"]): r["song_id"] for r in serving.mmr(spark.createDataFrame(rows, "user_id long, song_id string, score double, genre_code int"), v, 12, 0.5).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for u in (1, 2):
        left, taken = sorted([r[1:] for r in rows if r[0] == u], key=lambda r: (-r[1], r[0])), []
        for rank in range(1, 13):
            def value(r):
                if with_vectors:
                    sims = [cos(vectors[r[0]], vectors[t[0]]) for t in taken if r[0] in vectors and t[0] in vectors]
                    return 0.5 * r[1] - 0.5 * (max(sims) if sims else 0.0)
                return 0.5 * r[1] - 0.5 * min(0.3 * sum(t[2] == r[2] for t in taken), 0.9)
            best = max(left, key=value)
            left.remove(best)
            taken.append(best)
            assert got[(u, rank)] == best[0]


def test_why(spark):
    d = spark.createDataFrame([(1, 0.5, 0.9, 0.1, 0.2, 0.7, 0.1)], "rank int, final_score double, s_svd double, s_ncf double, s_content double, s_bandit double, s_recency double")
    assert json.loads(d.select(serving.why().alias("w")).first()["w"])["drivers"] == ["collaborative fit", "exploration pick"]


def test_chunks():
    assert list(serving.chunks(iter(["a" * 5, "b" * 3, "c"]), 6)) == ["aaaaa", "bbb\nc"]
    assert list(serving.chunks(iter(["x" * 9]), 4)) == ["xxxx", "xxxx", "x"]


def test_emotion_of_nobody(spark):
    empty = spark.createDataFrame([], "id long, ts timestamp, user_id long, song_id string, arousal double, valence double")
    assert affect.emotion(empty, ["user_id"]).count() == 0


def test_exact_als_lowers_loss(spark, tmp_path):
    f = frame_of(spark, [(u, f"s{(u + i) % 7}", 1, u * 10 + i) for u in range(12) for i in range(3)]).withColumn("confidence", F.lit(3.0))
    from tessitura.sources.scratch import materialize

    loss = [models.als_loss(f, *models.exact_als(f, materialize, rank=4, iterations=n)).first()["loss"] for n in (1, 3)]
    assert loss[1] <= loss[0] + 1e-9
    assert models.als_loss(f.limit(5), *models.exact_als(f, materialize, rank=4, iterations=1)).first()["loss"] == models.UNFITTED


def test_exact_als_by_brute_force(spark):
    """One iteration equals the normal equations solved id by id."""
    import numpy as np
    from tessitura.sources.scratch import materialize

    rows = [(u, f"s{(u * 3 + i) % 7}", 1, u * 10 + i) for u in range(9) for i in range(4)]
    f = frame_of(spark, rows).withColumn("confidence", 1 + F.col("user_id") / 2)
    users, items = models.exact_als(f, materialize, rank=3, iterations=1)
    y = {s: models.hashed_vector(s, 3) * 0.1 for s in {r[1] for r in rows}}

    def solve(own, other, k):
        gram, out = sum(np.outer(v, v) for v in other.values()) + 0.08 * np.eye(3), {}
        for key in {r[k] for r in rows}:
            a, b = gram.copy(), np.zeros(3)
            for r in rows:
                if r[k] == key:
                    v, c = other[r[1 - k]], 1 + r[0] / 2
                    a, b = a + (c - 1) * np.outer(v, v), b + c * v
            out[key] = np.linalg.solve(a, b)
        return out

    x = solve(None, y, 0)
    z = solve(None, x, 1)
    for df, key, want in ((users, "user_id", x), (items, "song_id", z)):
        got = {r[key]: r["vector"] for r in df.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(list(want[k]), abs=1e-9) for k in want)


def test_numbers_are_gapless(spark):
    """Three million ids in many partitions: every number once, in order."""
    d = spark.range(3_000_000).select(F.xxhash64("id").alias("user_id")).repartition(20)
    got = models.index(d, "user_id")
    r = got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("d"), F.min("i").alias("a"), F.max("i").alias("b")).first()
    assert (r["n"], r["d"], r["a"], r["b"]) == (3_000_000, 3_000_000, 0, 2_999_999)
    assert [x["user_id"] for x in got.where("i < 5").orderBy("i").collect()] == [x["user_id"] for x in d.orderBy("user_id").limit(5).collect()]


def test_negatives_are_from_the_whole_catalog(spark):
    songs = spark.range(5000).select(F.col("id").cast("string").alias("song_id"), (F.col("id") * 1000).alias("view_count"))
    f = frame_of(spark, [(u, str(i * 7), 1, i) for u in range(6) for i in range(150)])
    n = interactions.negatives(f, songs).cache()
    assert n.count() == 6 * 150 * 4 and n.select("user_id", "pos", "neg").distinct().count() == 6 * 150 * 4
    assert n.join(f.select("user_id", F.col("song_id").alias("neg")), ["user_id", "neg"]).count() == 0
    assert n.select("neg").distinct().count() > 2000
    mean = {r["kind"]: r["m"] for r in n.groupBy("kind").agg(F.avg(F.log10(F.greatest(F.col("neg").cast("double") * 1000, F.lit(10.0)))).alias("m")).collect()}
    assert mean["popular"] > mean["uniform"]


def test_weights_by_mood(spark):
    """By plain loops; a mood of few pairs stays near its user, one of many that disagrees leaves it."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(u, m, *(rng.normal(0, 1, 2) + (np.array([3.0, 0]) if m != "party" else np.array([0, 3.0]))).tolist(), 0.0, 0.0) for u, m, n in ((1, "party", 300), (1, "sad", 2), (2, "sad", 40), (3, "party", 1)) for _ in range(n)]
    pairs = spark.createDataFrame(rows, "user_id long, mood string, p_a double, p_b double, q_a double, q_b double").repartition(5)
    given = {-1: [0.2, 0.1], 1: [1.0, -0.5], 2: [0.9, 0.0]}
    weights = spark.createDataFrame([(u, w) for u, w in given.items()], "user_id long, weights array<double>")
    got = {(r["user_id"], r["mood"]): r for r in models.mood_blender(pairs, weights, ["a", "b"]).collect()}
    assert {(u, m) for u, m in got if u != -1} <= {(1, "party"), (1, "sad"), (2, "sad"), (3, "party")} and (1, "party") in got and (-1, "party") in got
    held = {(r["user_id"], tuple(r["d"])): r["h"] for r in pairs.unionByName(pairs.withColumn("user_id", F.lit(-1).cast("long"))).select("user_id", F.array("p_a", "p_b").alias("d"), (F.pmod(F.xxhash64("user_id", F.array(F.col("p_a") - 0.0, F.col("p_b") - 0.0)), F.lit(4)) == 0).alias("h")).collect()}
    for (u, m), r in got.items():
        own = [(x[2], x[3]) for x in rows if (u == -1 or x[0] == u) and x[1] == m]
        w = given.get(u, given[-1])
        g, h = [0.0, 0.0], [[2.0, 0.0], [0.0, 2.0]]
        for d in own:
            if not held[u, d]:
                p = 1 / (1 + math.exp(-(d[0] * w[0] + d[1] * w[1])))
                for i in range(2):
                    g[i] += (1 - p) * d[i]
                    for j in range(2):
                        h[i][j] += p * (1 - p) * d[i] * d[j]
        det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
        want = [w[0] + (h[1][1] * g[0] - h[0][1] * g[1]) / det, w[1] + (h[0][0] * g[1] - h[1][0] * g[0]) / det]
        assert r["weights"] == pytest.approx(want, rel=1e-6) and r["n_pairs"] == sum(not held[u, d] for d in own) and r["held_out"] == len(own) - r["n_pairs"]
        right = [d[0] * want[0] + d[1] * want[1] > 0 for d in own if held[u, d]]
        assert r["accuracy"] == (pytest.approx(sum(right) / len(right)) if right else None)
    party = got[1, "party"]
    assert party["accuracy"] > party["user_accuracy"] + 0.2 and party["weights"][1] > 0.5
    if (1, "sad") in got:
        assert np.abs(np.array(got[1, "sad"]["weights"]) - given[1]).max() < 0.3
    assert models.mood_blender(pairs.limit(0), weights, ["a", "b"]).count() == 0


@pytest.mark.parametrize("rounds,tries", [(6, 4), (1, 1), (0, 1)])
def test_negatives_are_complete(spark, rounds, tries):
    """Pairs get all they ask for, or all that their users leave of the catalog, however few draws succeed."""
    songs = spark.range(60).select(F.col("id").cast("string").alias("song_id"), (F.col("id") % 3 * 10**6).alias("view_count"))
    likes = {1: 60, 2: 59, 3: 57, 4: 56, 5: 55, 6: 30, 7: 2}
    f = frame_of(spark, [(u, str(i), 1, i) for u, n in likes.items() for i in range(n)])
    got = {}
    for r in interactions.negatives(f, songs, rounds=rounds, tries=tries).collect():
        got.setdefault((r["user_id"], r["pos"]), []).append((r["kind"], r["neg"]))
    for u, n in likes.items():
        for i in range(n):
            own = got.get((u, str(i)), [])
            assert len({neg for _, neg in own}) == len(own) == min(4, 60 - n) and all(int(neg) >= n for _, neg in own)
            assert sum(k == "uniform" for k, _ in own) <= 2 and sum(k == "popular" for k, _ in own) <= 2
    assert interactions.negatives(f.limit(0), songs).count() == 0 == interactions.negatives(f, songs.limit(0)).count()


def test_knn_of_long_histories(spark):
    f = frame_of(spark, [(u, f"s{(u * 5 + i) % 60}", 1, i) for u in range(5) for i in range(40)])
    rows = lambda df: sorted(map(tuple, df.select("src", "dst", "sim").collect()))
    assert rows(retrieval.item_knn(f, long=7)) == rows(retrieval.item_knn(f))


def test_evaluate(spark):
    test = frame_of(spark, [(1, "a", 3, 0), (1, "b", -2, 1), (1, "c", 1, 2), (2, "a", -2, 0)])
    scored = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (1, "c", 1.0), (2, "a", 0.0)], "user_id long, song_id string, score double")
    r = interactions.evaluate(scored, test, 2).first()
    assert r["rmse"] == pytest.approx(math.sqrt((1 + 25 + 0 + 4) / 4)) and (r["precision"], r["recall"], r["users"], r["interactions"]) == (0.5, 0.5, 1, 4)
    assert r["ndcg"] == pytest.approx(1 / math.log2(3))


def taste(spark, users=40, songs=24):
    """Users like songs of their own half and dislike those of the other."""
    import random

    rng = random.Random(8)
    rows = [(u, n, i) for u in range(users) for i, n in enumerate(rng.sample(range(songs), 12))]
    return frame_of(spark, [(u, f"s{n}", 3 if n % 2 == u % 2 else -2, i) for u, n, i in rows]).withColumn("confidence", F.lit(3.0))


def halves(spark, users=40, songs=24):
    return spark.range(users).select(F.col("id").alias("user_id")).crossJoin(spark.range(songs).select(F.col("id").alias("n"))).select("user_id", F.concat(F.lit("s"), F.col("n").cast("string")).alias("song_id"), (F.col("n") % 2 == F.col("user_id") % 2).alias("good"))


def gap(scored, truth):
    m = {r["good"]: r["m"] for r in truth.join(scored, ["user_id", "song_id"]).groupBy("good").agg(F.avg("score").alias("m")).collect()}
    return m[True] - m[False]


def test_learners_tell_tastes_apart(spark):
    """Scores of pairs that were never seen are higher in a user's own half than in the other, as they aren't before training."""
    f, truth = taste(spark), halves(spark)
    new = truth.join(f.select("user_id", "song_id"), ["user_id", "song_id"], "left_anti").select("user_id", "song_id")
    model = models.svd(f, rank=4, epochs=40)
    assert gap(models.svd_predict(model, new, 4), truth) > 0.5 and abs(gap(models.svd_predict(models.svd(f, rank=4, epochs=0), new, 4), truth)) < 0.3
    meta = content.metadata_vector(f.select("song_id").distinct().select("song_id", F.col("song_id").alias("title"), F.lit(10).alias("view_count"), F.lit(1).alias("like_count"), F.lit(200).alias("duration"), F.lit(0).alias("language_code"), F.lit(1).alias("genre_code"), F.lit(0.5).alias("energy_score")))
    scores = []
    for epochs in (0, 60):
        users, songs, weights = models.neural(f, meta, epochs=epochs)
        j = new.join(users.withColumnRenamed("vector", "x"), "user_id", "left").join(songs.withColumnRenamed("vector", "y"), "song_id", "left").join(meta, "song_id", "left")
        scores.append(gap(j.select("user_id", "song_id", models.neural_score(weights)("x", "y", "features").alias("score")), truth))
    assert scores[1] > 0.3 > abs(scores[0])


def test_cold_starts(spark):
    f = taste(spark)
    new = spark.createDataFrame([(0, "new"), (999, "s0"), (999, "new")], "user_id long, song_id string")
    mean, users, songs = models.svd(f, rank=4, epochs=2)
    got = {(r["user_id"], r["song_id"]): r["score"] for r in models.svd_predict((mean, users, songs), new, 4).collect()}
    bias = songs.where("song_id = 's0'").first()["vector"][0]
    assert got == {(0, "new"): pytest.approx(mean), (999, "s0"): pytest.approx(mean + bias), (999, "new"): pytest.approx(mean)}
    t = interactions.pairwise(f, f.select("song_id").distinct().withColumn("view_count", F.lit(10)))
    users, songs = models.pairwise_factors(t, size=8, epochs=2, unit=True)
    assert users.select(models.dot("vector", "vector", 8).alias("x")).where("abs(x - 1) > 1e-6").count() == 0
    scores = {(r["user_id"], r["song_id"]): r["score"] for r in models.score_pairs(new, users, models.with_hashed(songs, new, 8)).collect()}
    assert scores[(999, "s0")] == scores[(999, "new")] == 0 and 0 < abs(scores[(0, "new")]) <= 0.5


def test_attention_learns_what_follows(spark):
    """In every history b follows a and d follows c: after a, the state is nearer to b than to d."""
    rows = [(u, s, 1, i) for u in range(60) for i, s in enumerate(("c", "d", "x", "a", "b") if u % 2 else ("a", "b", "x", "c", "d"))]
    f = frame_of(spark, rows).unionByName(frame_of(spark, [(1000, "x", 1, 0), (1000, "a", 1, 1), (1001, "x", 1, 0), (1001, "c", 1, 1)]))
    model = models.attention(f, size=8, epochs=60)
    c = spark.createDataFrame([(u, s) for u in (1000, 1001) for s in "bd"], "user_id long, song_id string")
    state = models.session_vectors(f, model)
    j = c.join(state.withColumnRenamed("vector", "x"), "user_id").join(model[0].withColumnRenamed("vector", "y"), "song_id")
    got = {(r["user_id"], r["song_id"]): r["z"] for r in j.select("user_id", "song_id", models.dot("x", "y", 8).alias("z")).collect()}
    assert got[(1000, "b")] > got[(1000, "d")] and got[(1001, "d")] > got[(1001, "b")]


def test_attention_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(2, 4, 3)), [rng.normal(size=(3, 3)) for _ in range(3)]
    state = models.attention_state(x, *w)[0]
    for n in range(2):
        z = [sum((x[n, -1] @ w[0]) * (x[n, i] @ w[1])) / math.sqrt(3) for i in range(4)]
        a = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        assert state[n] == pytest.approx(sum(a[i] * (x[n, i] @ w[2]) for i in range(4)))


def test_blender_by_user(spark):
    """Users that like by one feature or the other get weights of their own; thin ones have none."""
    rows = [(u, *((1.0, 0.0, -1.0, 0.0) if u % 2 else (0.0, 1.0, 0.0, -1.0))) for u in range(4) for _ in range(8)] + [(9, 1.0, 0.0, 0.0, 0.0)] * 2
    pairs = spark.createDataFrame(rows, "user_id long, p_a double, p_b double, q_a double, q_b double")
    got = {r["user_id"]: r for r in models.blender(pairs, {"a": 0.1, "b": 0.1}).collect()}
    assert set(got) == {-1, 0, 1, 2, 3} and got[-1]["n_pairs"] == 34
    assert got[1]["weights"][0] > got[1]["weights"][1] and got[0]["weights"][1] > got[0]["weights"][0] and got[1]["accuracy"] == 1.0
    assert models.pairwise_accuracy(pairs, {"a": 1.0, "b": -1.0}).first()["accuracy"] == pytest.approx(18 / 34)


def test_models_are_saved(spark, tmp_path):
    f = taste(spark)
    _, users, songs = models.svd(f, rank=4, epochs=1)
    models.save({"users": users, "songs": songs}, str(tmp_path / "svd"))
    back = models.load(spark, str(tmp_path / "svd"), ["users", "songs"])
    assert back["users"].exceptAll(users).count() == 0 and back["songs"].count() == songs.count()


def test_neighbours_by_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(models, "SEEDS", 3)
    v = {f"s{i}": models.hashed_vector(f"x{i % 11}", 4) for i in range(40)}
    d = spark.createDataFrame([(k, x.tolist()) for k, x in v.items()], "song_id string, vector array<double>").repartition(5)
    got = {}
    for r in models.neighbours(d, d.where("cast(substring(song_id, 2) as int) < 8").select("song_id"), 4).collect():
        got.setdefault(r["seed"], {})[r["rank"]] = r["song_id"]
    for seed in got:
        want = sorted((s for s in v if s != seed), key=lambda s: (-round(float(v[seed] @ v[s]), 9), s))[:4]
        assert [got[seed][i] for i in range(1, 5)] == want
    assert len(got) == 8


def test_online_factors_by_brute_force(spark):
    users = spark.createDataFrame([(1, [0.1, 0.2, 0.3])], "user_id long, vector array<double>")
    songs = spark.createDataFrame([("a", [0.0, 0.5, -0.5])], "song_id string, vector array<double>")
    events = spark.createDataFrame([(1, "a", 1.0), (1, "a", -1.0), (2, "a", 1.0), (1, "new", 1.0)], "user_id long, song_id string, reward double")
    from tessitura.streaming.signals import online_factors

    p, q = {1: [0.1, 0.2, 0.3], 2: [0.0] * 3}, {"a": [0.0, 0.5, -0.5], "new": [0.0] * 3}
    np_, nq = {k: list(v) for k, v in p.items()}, {k: list(v) for k, v in q.items()}
    for u, s, r in [(1, "a", 1.0), (1, "a", -1.0), (2, "a", 1.0), (1, "new", 1.0)]:
        e = r - (0.2 + p[u][0] + q[s][0] + sum(p[u][i] * q[s][i] for i in (1, 2)))
        for new, own, other in ((np_[u], p[u], q[s]), (nq[s], q[s], p[u])):
            new[0] += 0.02 * (e - 0.02 * own[0])
            for i in (1, 2):
                new[i] += 0.02 * (e * other[i] - 0.02 * own[i])
    got = online_factors(events, users, songs, 0.2)
    assert {r["user_id"]: r["vector"] for r in got[0].collect()} == {k: pytest.approx(v) for k, v in np_.items()}
    assert {r["song_id"]: r["vector"] for r in got[1].collect()} == {k: pytest.approx(v) for k, v in nq.items()}


def test_pairwise_factors_order_pairs(spark):
    t = spark.createDataFrame([(u, f"p{u % 2}", f"q{u % 3}") for u in range(6)] * 5, "user_id long, pos string, neg string")
    users, songs = models.pairwise_factors(t, size=8, epochs=5)
    both = t.distinct().join(users, "user_id")
    s = lambda c: models.score_pairs(both.select("user_id", F.col(c).alias("song_id")).distinct(), users, songs).agg(F.avg("score")).first()[0]
    assert s("pos") > s("neg")


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab ", max_size=8)), max_size=5), st.integers(1, 9))
def test_chunks_never_exceed(lines, size):
    texts = [x[0] for x in lines]
    out = list(serving.chunks(iter(texts), size))
    assert all(len(c) <= size for c in out)
    assert "".join(out).replace("\n", "") == "".join(texts)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60))
def test_gradus_grows_with_factors(a, b):
    g = S.gradus(a, b)
    assert g >= 1 and S.gradus(2 * a, 2 * b) >= g


def test_bloom_hash_of_any_key(spark):
    """Empty, missing, long and non-ASCII keys, without decimals: their products cost ten times as much."""

    def slots(key):
        h = 14695981039346656037
        for b in (key or "").encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return [(h * p + p * p) % 1009 for p in (2, 3, 5)]

    keys = ["", None, "a", "12345", "é" * 40, "x" * 1000, "日本", "\x00\x7f\x80"]
    d = spark.createDataFrame(list(enumerate(keys)), "i int, song_id string").select("i", catalog.bloom_slots(F.col("song_id"), 1009, 3).alias("s"))
    assert {r["i"]: r["s"] for r in d.collect()} == dict(enumerate(map(slots, keys)))
    assert "decimal" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_ordered_fingerprint_of_blocks(spark, monkeypatch):
    """Blocks of a few lines give the digests of the whole texts, for several values, with missing and non-ASCII ones."""
    import hashlib

    monkeypatch.setattr(interactions, "LINES", 7)
    given = [(i % 5, None if i == 3 else f"sö{i % 4}", float(i % 5), f"2024-01-{1 + i * 7 % 28:02d} 00:00:00") for i in range(100)]
    frame = spark.createDataFrame(given, "user_id long, song_id string, v double, at string").withColumn("timestamp", F.to_timestamp("at")).repartition(3)
    order = sorted(given, key=lambda r: (r[3], r[0], r[1] or ""))
    expected = [hashlib.sha256("".join("|".join(x for x in (str(r[0]), r[1], value(r)) if x is not None) for r in order).encode()).hexdigest()[:16] for value in (lambda r: f"{r[2]:.2f}", lambda r: str(int(r[2])))]
    assert interactions.ordered_fingerprint(frame, F.format_string("%.2f", "v"), F.col("v").cast("long")) == expected


def test_ordered_fingerprint_is_sent_compressed(spark):
    """Repetitive texts reach the driver in a fraction of their length."""
    frame = spark.range(200_000).selectExpr("id % 50 as user_id", "concat('a rather long song name ', id % 9) as song_id", "timestamp_seconds(id) as timestamp")
    status = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: sum(s.resultSize() for s in _stages(spark, status))
    before = sent()
    interactions.ordered_fingerprint(frame, F.lit("1.00"))
    assert sent() - before < 1_500_000


def _stages(spark, status):
    jvm = spark._jvm
    found = status.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def test_profiles_and_cosines_by_brute_force(spark, monkeypatch):
    """Means of songs' vectors by weight, whatever the number of tasks; a song without a vector, a user without a profile."""
    from tessitura.operators import content

    monkeypatch.setattr(content, "LISTENS", 3)
    vecs = {"a": {"x": 0.6, "y": 0.8}, "b": {"y": 1.0}}
    listens = [(1, 1, "a", 0.5), (2, 1, "b", 1.0), (3, 1, "none", 0.9), (4, 2, "b", None), (5, 3, "none", 1.0), (6, 1, "a", 0.05)]
    v = spark.createDataFrame([(s, t, w) for s, e in vecs.items() for t, w in e.items()], "song_id string, term string, weight double")
    heard = spark.createDataFrame(listens, "id long, user_id long, song_id string, completion_pct double").withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    expected = {}
    for u in (1, 2):
        x = {}
        for _, _, s, c in (r for r in listens if r[1] == u and r[2] in vecs):
            for term, w in vecs[s].items():
                x[term] = x.get(term, 0.0) + max(c or 0.3, 0.1) * w
        length = sum(w * w for w in x.values()) ** 0.5
        expected |= {(u, term): w / length for term, w in x.items()}
    profile = content.profiles(heard, v)
    got = {(r["user_id"], r["term"]): r["weight"] for r in profile.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-8 for k in got)
    assert str(profile._jdf.queryExecution().optimizedPlan()).count("Window [") == 1  # listens are sorted once, and not for each sum
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (1, "none"), (2, "b")], "user_id long, song_id string")
    scores = {(r["user_id"], r["song_id"]): r["s_content"] for r in content.content_score(pairs, profile, v).collect()}
    cos = lambda u, s: sum(w * expected.get((u, t), 0.0) for t, w in vecs[s].items()) * 2 - 1
    assert scores[3, "a"] == scores[1, "none"] == 0.0 and all(abs(scores[u, s] - cos(u, s)) < 1e-8 for u, s in ((1, "a"), (2, "a"), (2, "b")))


def test_best_titles_of_equal_songs_are_met_once(spark, sf, tmp_path):
    """Copies of all songs add keys, not candidate pairs: what is shuffled stays nearly the same."""
    import os

    from tessitura.plans import registry

    part = spark.read.parquet(f"{sf}/part.parquet")
    n = part.count()
    sent = lambda: sum(s.shuffleWriteRecords() for s in _stages(spark, spark.sparkContext._jsc.sc().statusStore()))
    counts, found = [], []
    for copies in (1, 4):
        folder = str(tmp_path / str(copies))
        os.makedirs(folder)
        part.crossJoin(spark.range(copies)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 20 * n).drop("id").write.parquet(f"{folder}/part.parquet")
        before = sent()
        found.append(registry()[0]["best_titles"](spark, folder).toPandas())
        counts.append(sent() - before)
    assert len(found[1]) == 4 * len(found[0]) and counts[1] < 2 * counts[0] + 4 * n


def test_negatives_draw_few_at_first(spark):
    """Pairs that two draws each content don't cost eight: rows that are shuffled, without broadcasts, by pair."""
    songs = spark.range(3000).selectExpr("cast(id as string) as song_id", "1000000L as view_count")
    frame = spark.range(400).selectExpr("id % 80 as user_id", "cast(id as string) as song_id", "3.0D as plan_reward")
    sent = lambda: sum(s.shuffleWriteRecords() for s in _stages(spark, spark.sparkContext._jsc.sc().statusStore()))
    before, old = sent(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert interactions.negatives(frame, songs).count() == 1600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sent() - before < 24 * 400 + 4 * 3000


def test_pool_is_merged_in_a_users_row(spark):
    """No row of the pool is shuffled: what is, is a row a user or of a ranked source; the pool is that of plain Python."""
    n, frame = 60, [(u, f"s{i}", 3.0, i) for u in range(60) for i in range(u % 4 + 1)]
    f = spark.createDataFrame(frame, "user_id long, song_id string, plan_reward double, at int").selectExpr("user_id", "song_id", "plan_reward", "timestamp_seconds(at) as timestamp")
    ranked = [(u, f"s{i}", float(i % 3)) for u in range(n) for i in range(3, 7)]
    floors = [[(f"s{i}", i) for i in range(100)], [(f"s{200 - i}", i) for i in range(150)]]
    args = [spark.createDataFrame(ranked, "user_id long, song_id string, w double")], [spark.createDataFrame(x, "song_id string, pos int") for x in floors]
    sent = lambda: sum(s.shuffleWriteRecords() for s in _stages(spark, spark.sparkContext._jsc.sc().statusStore()))
    before = sent()
    got = {(r["user_id"], r["place"]): (r["song_id"], r["source"]) for r in retrieval.pool(f, *args, per_source=120, limit=150).collect()}
    assert sent() - before < 2000 < len(got)
    expected = {}
    for u in range(n):
        seen, place = {s for v, s, *_ in frame if v == u}, 0
        sources = [[s for _, s, _ in sorted((-w, s, v) for v, s, w in ranked if v == u)], *[[s for s, p in x if p <= 120] for x in floors]]
        for i, songs in enumerate(sources):
            for s in songs:
                if s not in seen and place < 150:
                    seen.add(s)
                    place += 1
                    expected[u, place] = (s, i)
    assert got == expected


def test_item_knn_shuffles_lists_and_not_pairs(spark):
    """Rows that are shuffled grow with the histories, not with their squares; lists of a long history are cut."""
    frame = spark.range(20).crossJoin(spark.range(120).withColumnRenamed("id", "s")).selectExpr("id as user_id", "(s * 7 + id * 13) % 400 as song_id", "3.0D as plan_reward", "timestamp_seconds(s) as timestamp")
    sent = lambda: sum(s.shuffleWriteRecords() for s in _stages(spark, spark.sparkContext._jsc.sc().statusStore()))
    before = sent()
    got = {(r["src"], r["dst"]): r["sim"] for r in retrieval.item_knn(frame, k=400, long=50).collect()}
    assert sent() - before < 20 * 120 * 119 / 2 and frame.schema["song_id"].dataType.simpleString() == "bigint"
    users = {}
    for u, s in frame.select("user_id", "song_id").distinct().collect():
        users.setdefault(s, set()).add(u)
    expected = {(a, b): round(len(x & y) / (len(x) * len(y)) ** 0.5, 9) for a, x in users.items() for b, y in users.items() if a != b and x & y}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 2e-9 for k in got)
