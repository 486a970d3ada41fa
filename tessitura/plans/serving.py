"""Serving queries: exclusions, blends, bonuses, rules, explanations, queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.operators import catalog as C
from tessitura.operators import content as T
from tessitura.operators import retrieval as R
from tessitura.operators import serving as V
from tessitura.sources.star import Star, with_views

NIGHT = "2024-01-30 00:00:00"  # within the events, so that "played in the last day" has rows


def _candidates(s: Star):
    """Each user's liked songs: a small pool to rank."""
    return s.feedback().where("signal > 0").select("user_id", "song_id").distinct()


def _scores(s: Star):
    """Stand-in model scores in [-1, 1], from ids, for some of the candidates of each model."""
    c = _candidates(s).withColumn("k", F.col("song_id").cast("long") * 31 + F.col("user_id") * 17)
    of = lambda m: c.where((F.col("k") % (m + 3)) > 0).select("user_id", "song_id", ((F.col("k") * (m + 2) % 101) / 50.0 - 1).alias("score"))
    names = ["als", "feature_mf", "svd", "ncf", "two_tower", "content", "retriever", "sequence"]
    out = {n: of(i) for i, n in enumerate(names)}
    arms = T.posteriors(s.feedback().select("user_id", "song_id", F.col("signal").cast("double").alias("reward")))
    return out | {"bandit": arms.select("user_id", "song_id", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("score"))}


def _table(s: Star):
    t = V.score_table(_candidates(s), _scores(s)).join(s.songs(), "song_id")
    rec = S.clip(S.recency(F.col("last_seen"), "2024-02-01 00:00:00"), 0.0, 1.0)
    return t.withColumn("rec", rec).withColumn("s_mean_bandit", F.col("s_bandit"))


def _blended(s: Star):
    t = _table(s).withColumn("s_bandit", F.col("s_bandit") * 2 - 1).withColumn("s_recency", F.col("rec") * 2 - 1).withColumn("s_freshness", F.col("rec") * 2 - 1).withColumn("s_repeat_pen", F.lit(0.0))
    return t.withColumn("blend", S.blend())


def _ranked(s: Star):
    b = _blended(s).select("user_id", "song_id", "genre_code", F.round("blend", 6).alias("score"))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "song_id")))


def _prefs(s: Star):
    """Every fifth user blocks songs; every third has an anchor."""
    u = s.raw("events").select("user_id").distinct()
    block = F.when(F.col("user_id") % 5 == 0, F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: ((i * 2 + F.col("user_id")) % 100).cast("string"))).otherwise(F.array().cast("array<string>"))
    return u.select("user_id", F.array_distinct(block).alias("blacklist"), F.when(F.col("user_id") % 3 == 0, (F.col("user_id") % 100).cast("string")).alias("anchor_song_id"), (F.col("user_id") % 11 / 10.0).alias("adventurous"))


def liked_by_others(spark, d):
    return V.liked_by_others(Star(spark, d).feedback(), 3).select("song_id", F.unix_micros("liked_at").alias("liked_us"))


def recent_play_antijoin(spark, d):
    s = Star(spark, d)
    return V.without(_candidates(s), V.recently_played(s.listens(), NIGHT))


def blacklist(spark, d):
    s = Star(spark, d)
    return V.without(_candidates(s), V.blacklisted(_prefs(s)))


def blacklist_append(spark, d):
    """A song added to each user's list: in order, once, the last 200 kept."""
    p = _prefs(Star(spark, d)).withColumn("l", F.array_distinct(F.concat("blacklist", F.array(F.lit("7")))))
    return p.select("user_id", F.array_join(F.slice("l", F.greatest(F.size("l") - 199, F.lit(1)), 200), ",").alias("blocked"))


def liked_neighbours_in(spark, d):
    """An id list as a semi join, however long."""
    s = Star(spark, d)
    return s.songs().join(_candidates(s).select("song_id"), "song_id", "left_semi").select("song_id", "title")


def legacy_candidates(spark, d):
    s = Star(spark, d)
    songs = s.songs()
    return V.legacy_candidates(C.latest_snapshot(s.feed_songs()), R.popular(songs, 1000), V.liked_by_others(s.feedback(), 3), s.listens(), songs, 3, NIGHT)


def score_join(spark, d):
    t = _table(Star(spark, d))
    return t.select("user_id", "song_id", *[F.round(f"s_{n}", 6).alias(n) for n in ("als", "content", "sequence", "bandit")])


def blend_score(spark, d):
    return _blended(Star(spark, d)).select("user_id", "song_id", F.round("blend", 6).alias("blend"))


def fixed_blend(spark, d):
    t = _table(Star(spark, d))
    for n in ("als", "feature_mf", "svd", "ncf", "two_tower", "content", "retriever", "sequence"):
        t = t.withColumn(f"s_{n}", S.norm(F.col(f"s_{n}")))
    return t.withColumn("s_recency", F.col("rec")).select("user_id", "song_id", F.round(S.weighted(S.FIXED_BLEND), 6).alias("score"))


def final_score(spark, d):
    s = Star(spark, d)
    a = s.audio_features().select("song_id", "bpm", "key_strength", "danceability")
    j = _blended(s).join(a, "song_id", "left")
    measured = (F.coalesce("bpm", F.lit(0.0)) != 0) | (F.coalesce("key_strength", F.lit(0.0)) != 0)
    bonus = F.when(measured, S.measured_bonus(F.col("bpm"), F.col("key_strength"), F.col("danceability"))).otherwise(S.title_bonus(F.col("title"), F.col("duration")))
    return j.select("user_id", "song_id", F.round(V.final_score(F.col("blend"), bonus, F.lit(False)), 6).alias("final_score"), measured.alias("measured"))


def measured_bonus(spark, d):
    return Star(spark, d).audio_features().select("song_id", S.measured_bonus(F.col("bpm"), F.col("key_strength"), F.col("danceability")).alias("bonus"))


def title_bonus(spark, d):
    return Star(spark, d).songs().select("song_id", S.title_bonus(F.concat("title", F.lit(" dance ballad harmony")), F.col("duration")).alias("bonus"))


def genre_cap(spark, d):
    s = Star(spark, d)
    return R.cap_per_genre(_ranked(s).drop("genre_code"), s.songs()).select("user_id", "song_id", "rank")


def anchor_slot(spark, d):
    s = Star(spark, d)
    r = _ranked(s)
    return V.anchor(r, r, _prefs(s)).select("user_id", "song_id", "rank")


def hard_rules(spark, d):
    s = Star(spark, d)
    return V.hard_rules(_ranked(s).drop("genre_code"), s.songs(), _prefs(s)).select("user_id", "song_id", "rank")


def top_200_cache(spark, d):
    return _ranked(Star(spark, d)).where("rank <= 200").select("user_id", "song_id", "score", "rank")


def heard_injection(spark, d):
    s = Star(spark, d)
    heard = s.ledger().groupBy("song_id").agg(F.max("ts").alias("heard_at")).where(F.col("heard_at") >= F.expr(f"timestamp'{NIGHT}' - interval 7 day"))
    return V.inject_heard(_candidates(s), heard, V.recently_played(s.listens(), NIGHT), s.songs())


def priority_queue(spark, d):
    s = Star(spark, d)
    owner = s.feedback().where("user_id = 3 and signal > 0").groupBy("song_id").agg(F.max("id").alias("id"))
    owner = owner.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("id")))).select("song_id", "pos")
    songs = s.songs()
    return V.priority_queue([owner, R.fresh(C.latest_snapshot(s.feed_songs()), 500), R.popular(songs, 1000)], songs, s.audio_features(), 150).select("song_id", "source", "pos")


def _why_table(s: Star):
    t = _table(s).withColumn("s_recency", F.col("rec"))
    for n in ("svd", "ncf", "content"):
        t = t.withColumn(f"s_{n}", S.norm(F.col(f"s_{n}")))
    return t.join(_ranked(s).select("user_id", "song_id", "rank", F.col("score").alias("final_score")), ["user_id", "song_id"])


def why_json(spark, d):
    w = _why_table(Star(spark, d)).withColumn("w", F.from_json(V.why(), "rank int, final_score double, breakdown struct<svd: double, ncf: double, content: double, bandit: double, recency: double>, drivers array<string>"))
    return w.select("user_id", "song_id", "w.rank", F.col("w.breakdown.bandit").alias("bandit"), F.array_join("w.drivers", "|").alias("drivers"))


def why_words(spark, d):
    return _why_table(Star(spark, d)).select("user_id", "song_id", V.why_in_words(F.col("title")).alias("why"))


def exploration_slots(spark, d):
    return _prefs(Star(spark, d)).select("user_id", S.exploration_slots(F.round(S.falsy(F.col("adventurous"), 0.3) * 10)).alias("slots"))


def mmr_lambda(spark, d):
    p = _prefs(Star(spark, d)).select("user_id", S.exploration_slots(F.round("adventurous") * 10).alias("slots"))
    return p.select("user_id", F.round(V.mmr_lambda(F.col("slots")), 6).alias("lam"))


def mood_boosts(spark, d):
    """A mood's genres mark candidates; the recency boost of the mood is added."""
    moods = spark.createDataFrame([("morning", [6, 3, 9], 0.05), ("gym", [4, 2, 16], 0.1), ("4am", [0, 6, 18], 0.0), ("chill", [0, 6, 9], 0.0), ("sad", [6, 18, 5], 0.0), ("party", [3, 4, 12], 0.0), ("focus", [0, 10, 9], 0.0)], "mood string, genres array<int>, boost double")
    s = Star(spark, d).songs().select("song_id", "genre_code")
    return s.join(F.broadcast(moods.select("mood", "boost", F.explode("genres").alias("genre_code"))), "genre_code").select("song_id", "mood", "boost")


def _by_token(titles, name):
    return titles.select("*", F.explode(F.array_distinct(S.title_tokens(F.col(name)))).alias("token"))


def title_match(spark, d):
    """Titles of songs whose id is divisible by 20 against all that share a word with them."""
    s = Star(spark, d).songs()
    wanted = s.where("cast(song_id as int) % 20 = 0").select("title").distinct()
    other = s.select(F.col("title").alias("other")).distinct()
    pairs = _by_token(wanted, "title").join(_by_token(other, "other"), "token").select("title", "other").distinct()
    return pairs.select("title", "other", S.title_ok(F.concat("title", F.lit(" (Official Video)")), F.concat(F.lit("the "), "other")).alias("ok"))


def best_titles(spark, d):
    """The three best candidates for each song whose id is divisible by 20: songs that share a word of the title."""
    s = Star(spark, d).songs()
    wanted = s.where("cast(song_id as int) % 20 = 0").select(F.col("song_id").alias("key"), F.col("title").alias("wanted_title"), F.col("channel").alias("wanted_artist"))
    got = s.where("cast(song_id as int) % 20 <> 0").select("title", F.col("channel").alias("artist")).distinct()
    # songs of one title and artist have the same candidates, which are met and ranked once for all of them
    both = ["wanted_title", "wanted_artist"]
    pairs = _by_token(wanted.select(*both).distinct(), "wanted_title").join(_by_token(got, "title"), "token").select(*both, "title", "artist").distinct()
    best = V.best_titles(pairs, both).where("place <= 3").select(F.col("wanted_title").alias("__t"), F.col("wanted_artist").alias("__a"), "place", "ok", "artist_ok", "overlap")
    return wanted.join(best, F.col("wanted_title").eqNullSafe(F.col("__t")) & F.col("wanted_artist").eqNullSafe(F.col("__a"))).select("key", "place", "ok", "artist_ok", "overlap")


def sessions_written(spark, d):
    """A recommendation session a user, with its items; the status of sent ones is set."""
    r = _ranked(Star(spark, d)).where("rank <= 10")
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.max("score").alias("best")).withColumn("status", F.when(F.col("items") >= 5, "sent").otherwise("pending"))


QUERIES = {
    f.__name__: f
    for f in (
        liked_by_others, recent_play_antijoin, blacklist, blacklist_append, liked_neighbours_in, legacy_candidates, score_join, blend_score, fixed_blend, final_score, measured_bonus, title_bonus, genre_cap, anchor_slot,
        hard_rules, top_200_cache, heard_injection, priority_queue, why_json, why_words, exploration_slots, mmr_lambda, mood_boosts, title_match, best_titles, sessions_written,
    )
}

_CAND = "cand AS (SELECT DISTINCT user_id, song_id FROM feedback WHERE signal > 0)"
_PLAYED = f"played AS (SELECT DISTINCT user_id, song_id FROM listens WHERE started_at BETWEEN TIMESTAMP '{NIGHT}' - INTERVAL 24 HOUR AND TIMESTAMP '{NIGHT}')"
_PREFS = "prefs AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN list_transform(range(0, 41), lambda i: ((i * 2 + user_id) % 100)::VARCHAR) ELSE [] END AS blacklist, CASE WHEN user_id % 3 = 0 THEN (user_id % 100)::VARCHAR END AS anchor, user_id % 11 / 10.0::DOUBLE AS adventurous FROM (SELECT DISTINCT user_id FROM events))"
_BLOCK = "block AS (SELECT user_id, unnest(blacklist) AS song_id FROM prefs)"
_MODELS = ["als", "feature_mf", "svd", "ncf", "two_tower", "content", "retriever", "sequence"]
_TABLE = f"""{_CAND}, arms AS (SELECT user_id, song_id, 1 + sum(greatest(signal, 0))::DOUBLE AS a, 1 + sum(greatest(-signal, 0))::DOUBLE AS b FROM feedback GROUP BY 1, 2),
keyed AS (SELECT *, song_id::BIGINT * 31 + user_id * 17 AS k FROM cand),
tab AS (SELECT k.user_id, s.*, a / (a + b) AS bandit, pow(0.5, (epoch(TIMESTAMP '2024-02-01') - epoch(last_seen)) / 3600 / 168) AS rec, {', '.join(f'CASE WHEN k % {i + 3} > 0 THEN (k * {i + 2} % 101) / 50.0::DOUBLE - 1 ELSE 0 END AS {n}' for i, n in enumerate(_MODELS))} FROM keyed k JOIN songs s USING (song_id) JOIN arms USING (user_id, song_id))"""
_Z = " + ".join(f"{S.BLEND[n]}::DOUBLE * {n}" for n in _MODELS) + " + 0.08::DOUBLE * (bandit * 2 - 1) + 0.05::DOUBLE * (rec * 2 - 1) + 0.02::DOUBLE * (rec * 2 - 1)"
_BLEND = f"{_TABLE}, blended AS (SELECT *, 2 / (1 + exp(-({_Z}))) - 1 AS blend FROM tab)"
_RANK = f"{_BLEND}, ranked AS (SELECT user_id, song_id, genre_code, round(blend, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(blend, 6) DESC, song_id) AS rank FROM blended)"
_ANCHOR = """topk AS (SELECT user_id, song_id, rank FROM {t} WHERE rank <= 10),
extra AS (SELECT p.user_id, p.anchor AS song_id, CASE WHEN n >= 2 THEN n ELSE n + 1 END AS rank FROM prefs p JOIN ranked r ON r.user_id = p.user_id AND r.song_id = p.anchor JOIN (SELECT user_id, max(rank) AS n FROM topk GROUP BY 1) z ON z.user_id = p.user_id ANTI JOIN topk t ON t.user_id = p.user_id AND t.song_id = p.anchor)
SELECT * FROM topk ANTI JOIN extra USING (user_id, rank) UNION ALL SELECT * FROM extra"""
_FIT = "CASE WHEN coalesce(bpm, 0) = 0 THEN 0.5 ELSE exp(-0.5::DOUBLE * pow((bpm - 120) / 35, 2)) END"
_MEASURED = f"round(greatest(-0.05::DOUBLE, least(0.12::DOUBLE, ({_FIT} - 0.5) * 0.12::DOUBLE + (coalesce(nullif(key_strength, 0), 0.5) - 0.5) * 0.08::DOUBLE + (coalesce(nullif(danceability, 0), 0.5) - 0.5) * 0.06::DOUBLE)), 4)"
_SHAPE = "0.3::DOUBLE * exp(-0.5::DOUBLE * pow((duration / 60.0::DOUBLE - 3.5) / 2, 2))"
_TOKENS = "list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in S.TITLE_STOP_WORDS) + "], w))"
_WHY = f"""{_RANK}, w AS (SELECT t.*, r.rank, r.score AS final, greatest(0, least(1, (svd + 1) / 2)) AS n_svd, greatest(0, least(1, (ncf + 1) / 2)) AS n_ncf, greatest(0, least(1, (content + 1) / 2)) AS n_content FROM tab t JOIN ranked r USING (user_id, song_id)),
dr AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} > {v} THEN '{n}' END" for (n, _, v), c in zip(V.DRIVERS, ('n_svd', 'n_ncf', 'n_content', 'bandit', 'rec')))}], lambda x: x IS NOT NULL) AS drivers FROM w)"""
_V3 = ("listens", "feedback", "songs")

ORACLES = {
    "liked_by_others": with_views("feedback", then="SELECT song_id, epoch_us(max(created_at)) AS liked_us FROM feedback WHERE user_id <> 3 AND signal > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200"),
    "recent_play_antijoin": with_views(*_V3, then=f"{_CAND}, {_PLAYED}\nSELECT * FROM cand ANTI JOIN played USING (user_id, song_id)"),
    "blacklist": with_views("feedback", then=f"{_CAND}, {_PREFS}, {_BLOCK}\nSELECT * FROM cand ANTI JOIN block USING (user_id, song_id)"),
    "blacklist_append": f"WITH {_PREFS}, x AS (SELECT user_id, CASE WHEN list_contains(blacklist, '7') THEN blacklist ELSE list_append(blacklist, '7') END AS l FROM prefs) SELECT user_id, array_to_string(l[-200:], ',') AS blocked FROM x",
    "liked_neighbours_in": with_views("feedback", "songs", then=f"{_CAND}\nSELECT song_id, title FROM songs WHERE song_id IN (SELECT song_id FROM cand)"),
    "legacy_candidates": with_views(*_V3, "feed", then=f"""{_PLAYED}, parts AS (
  SELECT song_id, 0 AS source, rank_in_snapshot AS pos FROM feed WHERE snapshot_id = (SELECT max(snapshot_id) FROM feed)
  UNION ALL SELECT song_id, 1, row_number() OVER (ORDER BY view_count DESC, song_id) AS pos FROM songs QUALIFY pos <= 1000
  UNION ALL SELECT song_id, 2, row_number() OVER (ORDER BY max(created_at) DESC, song_id) AS pos FROM feedback WHERE user_id <> 3 AND signal > 0 GROUP BY song_id QUALIFY pos <= 200),
once AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY source, pos) AS o FROM parts QUALIFY o = 1)
SELECT song_id, source, pos FROM once WHERE song_id IN (SELECT song_id FROM songs) AND song_id NOT IN (SELECT song_id FROM played WHERE user_id = 3) ORDER BY source, pos, song_id LIMIT 2000"""),
    "score_join": with_views("feedback", "songs", then=f"{_TABLE}\nSELECT user_id, song_id, round(als, 6) AS als, round(content, 6) AS content, round(sequence, 6) AS sequence, round(bandit, 6) AS bandit FROM tab"),
    "blend_score": with_views("feedback", "songs", then=f"{_BLEND}\nSELECT user_id, song_id, round(blend, 6) AS blend FROM blended"),
    "fixed_blend": with_views("feedback", "songs", then=f"{_TABLE}\nSELECT user_id, song_id, round({' + '.join(f'{S.FIXED_BLEND[n]}::DOUBLE * greatest(0, least(1, ({n} + 1) / 2))' for n in _MODELS)} + 0.08::DOUBLE * bandit + 0.05::DOUBLE * rec, 6) AS score FROM tab"),
    "final_score": with_views("feedback", "songs", "audio", then=f"""{_BLEND}, j AS (SELECT b.*, bpm, key_strength, danceability, coalesce(bpm, 0) <> 0 OR coalesce(key_strength, 0) <> 0 AS measured FROM blended b LEFT JOIN audio USING (song_id))
SELECT user_id, song_id, measured, round(greatest(0, least(1, greatest(0, least(1, (blend + 1) / 2)) + CASE WHEN measured THEN {_MEASURED} ELSE round(greatest(-0.05::DOUBLE, least(0.10::DOUBLE, (0.35::DOUBLE + {_SHAPE} - 0.5) * 0.12::DOUBLE)), 4) END)), 6) AS final_score FROM j"""),
    "measured_bonus": with_views("audio", then=f"SELECT song_id, {_MEASURED} AS bonus FROM audio"),
    "title_bonus": with_views("songs", then=f"""t AS (SELECT song_id, duration, len(regexp_extract_all(lower(title), '[a-z]+')) + 3 AS n FROM songs)
SELECT song_id, round(greatest(-0.05::DOUBLE, least(0.10::DOUBLE, (0.5 + 1.5 / n * 0.5 - 0.5) * 0.08::DOUBLE + (least(1, 0.7::DOUBLE * (0.5 + 0.25 * (1.0 - 0.5)) + {_SHAPE}) - 0.5) * 0.12::DOUBLE)), 4) AS bonus FROM t"""),
    "genre_cap": with_views("feedback", "songs", then=f"{_RANK}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id, genre_code ORDER BY rank) AS i FROM ranked QUALIFY i <= 3)\nSELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank FROM g"),
    "anchor_slot": with_views("feedback", "songs", then=f"{_RANK}, {_PREFS}, {_ANCHOR.format(t='ranked')}"),
    "hard_rules": with_views("feedback", "songs", then=f"""{_RANK}, {_PREFS}, {_BLOCK}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id, genre_code ORDER BY rank) AS i FROM (SELECT * FROM ranked ANTI JOIN block USING (user_id, song_id)) QUALIFY i <= 3),
capped AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank FROM g), {_ANCHOR.format(t='capped')}"""),
    "top_200_cache": with_views("feedback", "songs", then=f"{_RANK}\nSELECT user_id, song_id, score, rank FROM ranked WHERE rank <= 200"),
    "heard_injection": with_views(*_V3, "ledger", then=f"""{_CAND}, {_PLAYED}, heard AS (SELECT song_id, max(ts) AS at_ts FROM ledger GROUP BY 1 HAVING max(ts) >= TIMESTAMP '{NIGHT}' - INTERVAL 7 DAY AND song_id IN (SELECT song_id FROM songs) ORDER BY 2 DESC, 1 LIMIT 40),
fresh AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY at_ts DESC, song_id) AS r FROM (SELECT * FROM (SELECT DISTINCT user_id FROM cand), heard) ANTI JOIN cand USING (user_id, song_id) ANTI JOIN played USING (user_id, song_id))
SELECT user_id, song_id, false AS fresh FROM cand UNION ALL SELECT user_id, song_id, true FROM fresh WHERE r <= 20"""),
    "priority_queue": with_views(*_V3, "feed", "audio", then="""parts AS (
  SELECT song_id, 0 AS source, row_number() OVER (ORDER BY max(id) DESC) AS pos FROM feedback WHERE user_id = 3 AND signal > 0 GROUP BY song_id
  UNION ALL SELECT song_id, 1, rank_in_snapshot FROM feed WHERE snapshot_id = (SELECT max(snapshot_id) FROM feed) AND rank_in_snapshot <= 500
  UNION ALL SELECT song_id, 2, row_number() OVER (ORDER BY view_count DESC, song_id) AS pos FROM songs QUALIFY pos <= 1000),
once AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY source, pos) AS o FROM parts QUALIFY o = 1)
SELECT song_id, source, pos FROM once WHERE song_id NOT IN (SELECT song_id FROM audio) AND song_id IN (SELECT song_id FROM songs) ORDER BY source, pos, song_id LIMIT 150"""),
    "why_json": with_views("feedback", "songs", then=f"{_WHY}\nSELECT user_id, song_id, rank, round(bandit, 4) AS bandit, CASE WHEN len(drivers) = 0 THEN 'general popularity' ELSE array_to_string(drivers, '|') END AS drivers FROM dr"),
    "why_words": with_views("feedback", "songs", then=f"""{_WHY}, b AS (SELECT *, greatest(n_svd, n_ncf, n_content, bandit, rec) AS best FROM dr)
SELECT user_id, song_id, title || ': ' || CASE WHEN len(drivers) = 0 THEN 'it fits your general rotation' ELSE array_to_string(list_transform(drivers[1:2], lambda x: map {{ {', '.join(f"'{k}': '{v}'" for k, v in V.DRIVER_WORDS.items())} }}[x]), '; ') END
 || ' (strongest: ' || CASE best WHEN bandit THEN 'bandit' WHEN n_content THEN 'content' WHEN n_ncf THEN 'ncf' WHEN rec THEN 'recency' ELSE 'svd' END || ')' AS why FROM b"""),
    "exploration_slots": f"WITH {_PREFS} SELECT user_id, round_even(round(coalesce(nullif(adventurous, 0), 0.3::DOUBLE) * 10) / 10 * 5, 0)::INT AS slots FROM prefs",
    "mmr_lambda": f"WITH {_PREFS} SELECT user_id, round(greatest(0.4::DOUBLE, 0.7::DOUBLE - 0.04::DOUBLE * least(round_even(round(adventurous) * 10 / 10 * 5, 0), 5)), 6) AS lam FROM prefs",
    "mood_boosts": with_views("songs", then="""m AS (SELECT mood, unnest(genres) AS genre_code, boost FROM (VALUES ('morning', [6, 3, 9], 0.05::DOUBLE), ('gym', [4, 2, 16], 0.1), ('4am', [0, 6, 18], 0.0), ('chill', [0, 6, 9], 0.0), ('sad', [6, 18, 5], 0.0), ('party', [3, 4, 12], 0.0), ('focus', [0, 10, 9], 0.0)) t(mood, genres, boost))
SELECT song_id, mood, boost FROM songs JOIN m USING (genre_code)"""),
    "title_match": with_views("songs", then=f"""t AS (SELECT title, max(song_id::INT % 20 = 0) AS wanted, list_distinct({_TOKENS.format(t='title')}) AS w FROM songs GROUP BY title),
a AS (SELECT title, w, unnest(w) AS token FROM t WHERE wanted), b AS (SELECT title AS other, w AS g, unnest(w) AS token FROM t), p AS (SELECT DISTINCT title, other, w, g FROM a JOIN b USING (token))
SELECT title, other, len(w) = 0 OR len(list_intersect(w, g)) >= greatest(1, len(w) // 2) AS ok FROM p"""),
    "best_titles": with_views("songs", then=f"""w AS (SELECT song_id AS key, title AS wt, channel AS wa, list_distinct({_TOKENS.format(t='title')}) AS a FROM songs WHERE song_id::INT % 20 = 0), c AS (SELECT DISTINCT title, channel AS artist, list_distinct({_TOKENS.format(t='title')}) AS b FROM songs WHERE song_id::INT % 20 <> 0),
p AS (SELECT DISTINCT key, wt, wa, title, artist, a, b FROM (SELECT *, unnest(a) AS token FROM w) JOIN (SELECT *, unnest(b) AS token FROM c) USING (token)),
q AS (SELECT key, title, artist, len(list_intersect(a, b)) AS overlap, len(a) = 0 OR len(list_intersect(a, b)) >= greatest(1, len(a) // 2) AS ok, contains(lower(wa), lower(artist)) OR contains(lower(artist), lower(wa)) AS artist_ok FROM p)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY ok DESC, artist_ok DESC, overlap DESC, length(title), title) AS place, ok, artist_ok, overlap FROM q QUALIFY place <= 3"""),
    "sessions_written": with_views("feedback", "songs", then=f"{_RANK}\nSELECT user_id, count(*) AS items, max(score) AS best, CASE WHEN count(*) >= 5 THEN 'sent' ELSE 'pending' END AS status FROM ranked WHERE rank <= 10 GROUP BY 1"),
}
