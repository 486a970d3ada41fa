"""Catalog, feed, text-detection, upsert, retention, registry and job-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.operators import catalog as C
from tessitura.sources import schemas
from tessitura.sources.star import NOW, Star, with_views

_DOC_SONGS = "docs AS (SELECT doc_id::VARCHAR AS song_id, text AS title, '' AS description FROM documents)"


def _docs(spark, d):
    return Star(spark, d).raw("documents").select(F.col("doc_id").cast("string").alias("song_id"), F.col("text").alias("title"), F.lit("").alias("description"))


def _scored(spark, d):
    s = Star(spark, d).songs()
    return s.withColumn("raw_score", F.round(S.raw_score(F.col("view_count"), F.col("like_count"), S.freshness(F.col("upload_date"), NOW), F.col("energy_score")), 6))


def latest_snapshot(spark, d):
    return C.latest_snapshot(Star(spark, d).feed_songs()).select("song_id", "rank_in_snapshot", "raw_score")


def snapshot_exists(spark, d):
    return Star(spark, d).feed_songs().limit(1).agg((F.count(F.lit(1)) > 0).alias("present"))


def point_lookup(spark, d):
    return Star(spark, d).audio_features().where("song_id = '7'").select("song_id", "bpm", "musical_key", "mode")


def feedback_scan(spark, d):
    return Star(spark, d).feedback().select("user_id", "song_id", "signal")


def quality_filter(spark, d):
    return C.quality(Star(spark, d).songs(), min_views=950_000).select("song_id", "view_count", "duration")


def genre_detect(spark, d):
    return _docs(spark, d).select("song_id", S.genre(F.col("title"), F.col("description")).alias("genre_code"))


def mood_tags(spark, d):
    s = Star(spark, d).songs()
    text = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ["late night lofi", "gym workout party", "love, sad heartbreak", "plain"])), (F.length("title") % 4 + 1).cast("int")), "title")
    return s.select("song_id", S.mood_tags(text, F.col("description")).alias("mood_tags"))


def language_detect(spark, d):
    return _docs(spark, d).select("song_id", S.language(F.col("title")).alias("language_code"))


def energy_score(spark, d):
    return _docs(spark, d).select("song_id", F.round(S.energy(F.col("title")), 9).alias("energy"))


def tag_flags(spark, d):
    t = F.col("title")
    return Star(spark, d).songs().select("song_id", S.tag_flag(t, "red", "blue").alias("colour"), S.tag_flag(t, "widget").alias("widget"))


def raw_score(spark, d):
    return _scored(spark, d).select("song_id", "raw_score")


def feed_rank(spark, d):
    return C.feed(_scored(spark, d)).select("song_id", "raw_score", "rank_in_snapshot")


def dedup_first(spark, d):
    return C.first_by(Star(spark, d).listens(), ["user_id", "song_id"], ["id"]).select("id", "user_id", "song_id")


def dedup_antijoin(spark, d):
    s = Star(spark, d)
    return C.unseen(s.songs().select("song_id", "title"), s.listens())


def bloom_fp(spark, d):
    n = Star(spark, d).songs().agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.round(C.bloom_false_positives(F.col("n").cast("double")), 12).alias("fp"), F.round(C.bloom_false_positives(F.lit(1e6)), 6).alias("fp_million"))


def upserted(spark, d):
    """(catalog, each day's metadata of the songs heard that day)."""
    s = Star(spark, d)
    old = s.songs()
    seen = s.listens().groupBy("song_id", F.to_date("started_at").alias("day")).agg(F.max("started_at").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    new = seen.join(old.drop("last_seen", "times_fetched"), "song_id").withColumn("seq", F.datediff("day", F.lit("2024-01-01"))).withColumn("view_count", F.col("view_count") + F.col("n") * 100)
    new = new.withColumn("description", F.concat(F.lit("seen "), F.col("day").cast("string"))).withColumn("first_seen", F.col("last_seen")).withColumn("times_fetched", F.lit(1)).drop("day", "n")
    return old, new


def catalog_upsert(spark, d):
    """Each day's metadata of the songs heard that day, merged into the catalog."""
    old, new = upserted(spark, d)
    return C.upsert(old, new, ["song_id"], {c: r for c, r in C.SONG_RULES.items() if c != "mood_tags"}).select("song_id", "title", "view_count", "description", "first_seen", "last_seen", "times_fetched")


def artist_pairs(spark, d):
    s = Star(spark, d)
    return C.artist_pairs(s.feed_songs().join(s.songs().select("song_id", "channel"), "song_id"))


def dislike_counts(spark, d):
    f = Star(spark, d).feedback().groupBy("user_id").agg(F.count_if(F.col("signal") < 0).alias("dislikes"))
    return f.withColumn("disabled", F.col("dislikes") >= 5)


def last_write_wins(spark, d):
    f = Star(spark, d).feedback()
    return C.latest_by(f.select("user_id", "song_id", "signal", "id"), ["user_id"], "id")


def journal_upsert(spark, d):
    """Plays and likes add up by user and day; the first genre stays."""
    s = Star(spark, d)
    e = s.listens().select("user_id", "id", F.to_date("started_at").alias("day"), "song_id", F.lit(1).alias("plays"), F.lit(0).alias("likes"))
    e = e.unionByName(s.feedback().where("signal > 0").select("user_id", "id", F.to_date("created_at").alias("day"), "song_id", F.lit(0).alias("plays"), F.lit(1).alias("likes")))
    e = e.join(s.songs().select("song_id", "genre_code"), "song_id")
    return e.groupBy("user_id", F.col("day").cast("string").alias("day")).agg(F.sum("plays").alias("plays"), F.sum("likes").alias("likes"), F.min_by("genre_code", "id").alias("top_genre"))


def fetch_failures(spark, d):
    e = Star(spark, d).raw("events").where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("props", "event_id").alias("last_error"), (F.count(F.lit(1)) >= 5).alias("blocked"))


def listen_context(spark, d):
    return Star(spark, d).listens().select("id", F.hour("started_at").alias("hour"), F.weekday("started_at").alias("dow"))


def catalog_purge(spark, d):
    return C.purge(Star(spark, d).songs(), NOW).select("song_id", "times_fetched")


def purge_dry_run(spark, d):
    s = Star(spark, d).songs()
    return s.agg(F.count(F.lit(1)).alias("before")).join(C.purge(s, NOW).agg(F.count(F.lit(1)).alias("after")), F.lit(True))


def snapshot_retention(spark, d):
    return C.retain(Star(spark, d).feed_songs(), NOW).select(F.col("snapshot_id").cast("string").alias("snapshot_id"), "song_id")


def _history(spark, d):
    """Registry writes: events stand for runs, types for keys."""
    return Star(spark, d).raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("run_id"), F.round("value", 4).alias("ndcg10"))


def registry_latest(spark, d):
    return C.registry(_history(spark, d)).select("key", "run_id", "ndcg10", "id")


def registry_rollback(spark, d):
    return C.rollback(_history(spark, d), "purchase").select("id", "key", "run_id", "ndcg10")


def newest_rows(spark, d):
    return C.newest(_history(spark, d), "id", 20)


def job_log_latest(spark, d):
    e = Star(spark, d).raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("job"), (F.col("value") < 100).alias("ok"), F.round("value", 3).alias("secs"))
    return C.latest_by(e, ["job"], "id")


def status_counts(spark, d):
    s = Star(spark, d)
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("what"), "n")
    return one(s.songs(), "songs").unionByName(one(s.listens(), "listens")).unionByName(one(s.feedback(), "feedback")).unionByName(one(s.audio_features(), "heard"))


def distinct_counts(spark, d):
    return Star(spark, d).feedback().agg(F.count_distinct("user_id").alias("users"), F.count_distinct("song_id").alias("songs"))


def active_users(spark, d):
    s = Star(spark, d)
    return s.listens().select("user_id").union(s.feedback().select("user_id")).distinct()


def prefix_filter(spark, d):
    return Star(spark, d).songs().where(F.col("channel").startswith("Brand#1")).select("song_id", "channel")


def slug(spark, d):
    return Star(spark, d).raw("pages").select("page_id", S.slug(F.col("url")).alias("slug"))


def lyrics_title(spark, d):
    t = F.concat(F.lit("  "), "title", F.lit(" (Official Video) [HD] Lyrics | "), "channel")
    return Star(spark, d).songs().select("song_id", S.clean_lyrics_title(t).alias("clean"))


def conformed(spark, d):
    """An older songs table, without flags and tags, brought to today's schema."""
    old = Star(spark, d).songs().drop("first_seen", "last_seen", "energy_score")
    return schemas.conform(old, "songs").select("song_id", "has_remix", "energy_score", "genre_code", "mood_tags")


def latest_artifact(spark, d):
    """The newest checkpoint of each model."""
    a = Star(spark, d).raw("events").select(F.col("event_type").alias("model_name"), F.concat(F.lit("runs/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("at"))
    return C.latest_by(a, ["model_name"], "at").select("model_name", "path")


QUERIES = {
    f.__name__: f
    for f in (
        latest_snapshot, snapshot_exists, point_lookup, feedback_scan, quality_filter, genre_detect, mood_tags, language_detect, energy_score, tag_flags, raw_score, feed_rank, dedup_first, dedup_antijoin, bloom_fp,
        catalog_upsert, artist_pairs, dislike_counts, last_write_wins, journal_upsert, fetch_failures, listen_context, catalog_purge, purge_dry_run, snapshot_retention, registry_latest, registry_rollback, newest_rows,
        job_log_latest, status_counts, distinct_counts, active_users, prefix_filter, slug, lyrics_title, conformed, latest_artifact,
    )
}

_WORD = r"regexp_matches({t}, '(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)')"


def _word(t: str, w: str) -> str:
    return _WORD.format(t=t, w=w.replace("&", "&").replace("-", r"\-"))


_GENRE = "CASE " + " ".join(f"WHEN {_word('lower(title)', w)} THEN {S.GENRES[w]}" for w in sorted(S.GENRES, key=len, reverse=True)) + " ELSE 20 END"
_MOOD = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_word('t', m)} THEN '{m}' END" for m in S.MOODS) + "], lambda x: x IS NOT NULL)[1:8], ',')"
_ENERGY = " + ".join(f"contains(lower(title), '{w}')::INT" for w in S.ENERGY_WORDS)
_FIB = "[" + ", ".join(map(str, S.fibonacci(20))) + "]"
_RAW = f"round(log10(greatest(view_count, 1)) * like_count / greatest(like_count + sqrt(view_count) * 0.05::DOUBLE, 1) * pow(0.5, (epoch(TIMESTAMP '{NOW}') - epoch(strptime(upload_date, '%Y%m%d'))) / 3600 / 24) * (1 + energy_score), 6)"
_HIST = "hist AS (SELECT event_id AS id, event_type AS key, user_id::VARCHAR AS run_id, round(value, 4) AS ndcg10 FROM events)"

ORACLES = {
    "latest_snapshot": with_views("feed", then="SELECT song_id, rank_in_snapshot, raw_score FROM feed WHERE snapshot_id = (SELECT max(snapshot_id) FROM feed)"),
    "snapshot_exists": with_views("feed", then="SELECT count(*) > 0 AS present FROM feed"),
    "point_lookup": with_views("audio", then="SELECT song_id, bpm, musical_key, mode FROM audio WHERE song_id = '7'"),
    "feedback_scan": with_views("feedback", then="SELECT user_id, song_id, signal FROM feedback"),
    "quality_filter": with_views("songs", then="SELECT song_id, view_count, duration FROM songs WHERE song_id <> '' AND title <> '' AND view_count >= 950000 AND NOT duration > 600"),
    "genre_detect": f"WITH {_DOC_SONGS} SELECT song_id, {_GENRE} AS genre_code FROM docs",
    "mood_tags": with_views("songs", then=f"t AS (SELECT song_id, lower((['late night lofi', 'gym workout party', 'love, sad heartbreak', 'plain'])[length(title) % 4 + 1] || ' ' || title || ' ' || description) AS t FROM songs)\nSELECT song_id, {_MOOD} AS mood_tags FROM t"),
    "language_detect": rf"WITH {_DOC_SONGS} SELECT song_id, CASE WHEN regexp_matches(title, '[\x{{0900}}-\x{{097F}}]') THEN 1 WHEN regexp_matches(title, '[\x{{AC00}}-\x{{D7AF}}]') THEN 4 WHEN regexp_matches(title, '[\x{{4E00}}-\x{{9FFF}}]') THEN 8 WHEN regexp_matches(lower(title), '[ñáéíóúü]') THEN 3 ELSE 0 END AS language_code FROM docs",
    "energy_score": f"WITH {_DOC_SONGS} SELECT song_id, round(({_FIB})[least({_ENERGY}, 19) + 1] / 6765.0::DOUBLE, 9) AS energy FROM docs",
    "tag_flags": with_views("songs", then="SELECT song_id, (contains(lower(title), 'red') OR contains(lower(title), 'blue'))::INT AS colour, contains(lower(title), 'widget')::INT AS widget FROM songs"),
    "raw_score": with_views("songs", then=f"SELECT song_id, {_RAW} AS raw_score FROM songs"),
    "feed_rank": with_views("songs", then=f"SELECT song_id, {_RAW} AS raw_score, row_number() OVER (ORDER BY {_RAW} DESC, song_id) AS rank_in_snapshot FROM songs QUALIFY rank_in_snapshot <= 100"),
    "dedup_first": with_views("listens", then="SELECT id, user_id, song_id FROM listens QUALIFY row_number() OVER (PARTITION BY user_id, song_id ORDER BY id) = 1"),
    "dedup_antijoin": with_views("songs", "listens", then="SELECT song_id, title FROM songs WHERE song_id NOT IN (SELECT song_id FROM listens)"),
    "bloom_fp": "SELECT count(*) AS n, round(pow(1 - exp(-7.0::DOUBLE * count(*) / 2000003), 7), 12) AS fp, round(pow(1 - exp(-7e6 / 2000003), 7), 6) AS fp_million FROM part",
    "catalog_upsert": with_views("songs", "listens", then="""seen AS (SELECT song_id, started_at::DATE AS day, max(started_at) AS last_seen, count(*) AS n FROM listens GROUP BY 1, 2 HAVING song_id IN (SELECT song_id FROM songs)),
agg AS (SELECT song_id, max(n) AS most, max_by(day, day) AS last_day, max_by(last_seen, day) AS last_seen, count(*) AS days FROM seen GROUP BY 1)
SELECT s.song_id, title, view_count + coalesce(most, 0) * 100 AS view_count, coalesce('seen ' || last_day::VARCHAR, description) AS description, first_seen, coalesce(a.last_seen, s.last_seen) AS last_seen, times_fetched + coalesce(days, 0) AS times_fetched FROM songs s LEFT JOIN agg a USING (song_id)"""),
    "artist_pairs": with_views("songs", "feed", then="""a AS (SELECT snapshot_id, rank_in_snapshot AS r, channel AS c FROM feed JOIN songs USING (song_id) WHERE rank_in_snapshot <= 60)
SELECT least(x.c, y.c) AS artist_a, greatest(x.c, y.c) AS artist_b, count(*) AS co_count FROM a x JOIN a y USING (snapshot_id) WHERE x.r < y.r AND x.c <> y.c GROUP BY 1, 2"""),
    "dislike_counts": with_views("feedback", then="SELECT user_id, count(*) FILTER (signal < 0) AS dislikes, count(*) FILTER (signal < 0) >= 5 AS disabled FROM feedback GROUP BY 1"),
    "last_write_wins": with_views("feedback", then="SELECT user_id, max_by(song_id, id) AS song_id, max_by(signal, id) AS signal, max(id) AS id FROM feedback GROUP BY 1"),
    "journal_upsert": with_views("listens", "feedback", "songs", then="""e AS (SELECT user_id, id, started_at::DATE AS day, song_id, 1 AS plays, 0 AS likes FROM listens UNION ALL SELECT user_id, id, created_at::DATE, song_id, 0, 1 FROM feedback WHERE signal > 0)
SELECT user_id, day::VARCHAR AS day, sum(plays)::BIGINT AS plays, sum(likes)::BIGINT AS likes, min_by(genre_code, id) AS top_genre FROM e JOIN songs USING (song_id) GROUP BY user_id, day"""),
    "fetch_failures": "SELECT user_id, count(*) AS attempts, max_by(props, event_id) AS last_error, count(*) >= 5 AS blocked FROM events WHERE event_type = 'error' GROUP BY 1",
    "listen_context": with_views("listens", then="SELECT id, hour(started_at)::INT AS hour, (isodow(started_at) - 1)::INT AS dow FROM listens"),
    "catalog_purge": with_views("songs", then=f"SELECT song_id, times_fetched FROM songs WHERE NOT (last_seen < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND times_fetched < 3)"),
    "purge_dry_run": with_views("songs", then=f"SELECT count(*) AS before, count(*) FILTER (NOT (last_seen < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND times_fetched < 3)) AS after FROM songs"),
    "snapshot_retention": with_views("feed", then=f"SELECT snapshot_id::VARCHAR AS snapshot_id, song_id FROM feed WHERE snapshot_id >= (TIMESTAMP '{NOW}' - INTERVAL 7 DAY)::DATE"),
    "registry_latest": f"WITH {_HIST} SELECT key, max_by(run_id, id) AS run_id, max_by(ndcg10, id) AS ndcg10, max(id) AS id FROM hist GROUP BY key",
    "registry_rollback": f"WITH {_HIST} SELECT id, key, run_id, ndcg10 FROM hist WHERE key = 'purchase' AND run_id <> (SELECT max_by(run_id, id) FROM hist WHERE key = 'purchase') ORDER BY id DESC LIMIT 1",
    "newest_rows": f"WITH {_HIST} SELECT * FROM hist ORDER BY id DESC LIMIT 20",
    "job_log_latest": "SELECT event_type AS job, max(event_id) AS id, max_by(value < 100, event_id) AS ok, round(max_by(value, event_id), 3) AS secs FROM events GROUP BY 1",
    "status_counts": with_views("songs", "listens", "feedback", "audio", then="SELECT 'songs' AS what, count(*) AS n FROM songs UNION ALL SELECT 'listens', count(*) FROM listens UNION ALL SELECT 'feedback', count(*) FROM feedback UNION ALL SELECT 'heard', count(*) FROM audio"),
    "distinct_counts": with_views("feedback", then="SELECT count(DISTINCT user_id) AS users, count(DISTINCT song_id) AS songs FROM feedback"),
    "active_users": with_views("listens", "feedback", then="SELECT user_id FROM listens UNION SELECT user_id FROM feedback"),
    "prefix_filter": with_views("songs", then="SELECT song_id, channel FROM songs WHERE starts_with(channel, 'Brand#1')"),
    "slug": "SELECT page_id, substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM pages",
    "lyrics_title": with_views("songs", then="SELECT song_id, title AS clean FROM songs"),
    "conformed": with_views("songs", then="SELECT song_id, 0 AS has_remix, 0.5::DOUBLE AS energy_score, genre_code, NULL::VARCHAR AS mood_tags FROM songs"),
    "latest_artifact": "SELECT event_type AS model_name, 'runs/' || max_by(user_id, event_id) AS path FROM events GROUP BY 1",
}
