"""Affect queries over the ledger and measured features, and music-theory lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.operators import affect as A
from tessitura.operators import catalog as C
from tessitura.sources.star import Star, with_views

TODAY = "2024-01-30"


def taste_nodes(spark, d):
    return A.taste_nodes(Star(spark, d).audio_features())


def taste_edges(spark, d):
    s = Star(spark, d)
    return A.taste_edges(s.audio_features(), s.ledger(), ["user_id"])


def taste_profile(spark, d):
    return A.taste_profile(Star(spark, d).audio_features()).select("home_key", "bpm_mean", "valence_mean", "dance_mean", "n")


def emotion_now(spark, d):
    return A.emotion(Star(spark, d).ledger(), ["user_id"])


def emotion_recent(spark, d):
    return A.emotion(Star(spark, d).ledger(), ["user_id"], recent_first=True)


def streaks(spark, d):
    return C.streaks(Star(spark, d).listens().select("user_id", F.to_date("started_at").alias("day")), TODAY)


def weekly_digest(spark, d):
    s = Star(spark, d)
    since = F.expr(f"date'{TODAY}' - interval 7 day")
    e = s.listens().where(F.to_date("started_at") >= since).select("user_id", F.lit(1).alias("p"), F.lit(0).alias("l")).unionByName(s.feedback().where((F.col("signal") > 0) & (F.to_date("created_at") >= since)).select("user_id", F.lit(0).alias("p"), F.lit(1).alias("l")))
    return e.groupBy("user_id").agg(F.sum("p").alias("plays"), F.sum("l").alias("likes"))


def feel_like(spark, d):
    return A.feel_like(Star(spark, d).audio_features(), song_id="7", n=20)


def feel_like_mood(spark, d):
    return A.feel_like(Star(spark, d).audio_features(), seed=A.feel_seed("slow", valence=0.2), n=20)


def nearest_vectors(spark, d):
    """Cosine of one embedding with all others."""
    e = Star(spark, d).raw("embeddings")
    seed = e.where("vec_id = 0").select(F.col("embedding").alias("seed"))
    return e.where("vec_id <> 0").join(F.broadcast(seed), F.lit(True)).select("vec_id", F.round(A.cosine(F.col("seed"), F.col("embedding")), 5).alias("cos")).orderBy(F.desc("cos"), "vec_id").limit(50)


def _lyrics(s: Star):
    line = lambda i: F.concat(F.lit(f"[0{i}:1{i}.50] line {i} of "), "title")
    return s.songs().select("song_id", F.concat_ws("\n", *[line(i) for i in range(4)], F.lit("no stamp")).alias("plain"))


def _arcs(s: Star):
    return s.songs().select("song_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((i * 37 + F.col("duration")) % 100) / 100.0).alias("arousal"))


def lyric_lines(spark, d):
    return A.parse_lrc(_lyrics(Star(spark, d)))


def lyric_sections(spark, d):
    s = Star(spark, d)
    return A.lyric_sections(A.parse_lrc(_lyrics(s)), _arcs(s))


def captions(spark, d):
    return A.captions(Star(spark, d).audio_features())


def agent_brief(spark, d):
    return A.agent_brief(Star(spark, d).audio_features())


def heard_library(spark, d):
    f = Star(spark, d).audio_features()
    return f.join(A.captions(f), "song_id").select("song_id", "bpm", "musical_key", "mode", "danceability", "valence", "energy", F.length("caption").alias("caption_length"))


def dossier(spark, d, song_id: str = "1"):
    """A song's features, lyrics by section, and neighbours in feel, as one row. Lyrics are parsed of that song alone."""
    s = Star(spark, d)
    own = F.col("song_id") == song_id
    f = s.audio_features()
    lines = A.lyric_sections(A.parse_lrc(_lyrics(s).where(own)), _arcs(s).where(own)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "section"))), lambda x: x.section), ",").alias("sections"))
    near = A.feel_like(f, song_id=song_id, n=3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("feel_score"), "song_id"))), lambda x: x.song_id), ",").alias("near"))
    return f.where(own).select("song_id", "bpm", "musical_key").join(lines, F.lit(True)).join(near, F.lit(True))


def intervals(spark, d):
    return spark.range(0, 25).select(F.col("id").alias("semitones"), F.round(S.interval_consonance(F.col("id")), 6).alias("consonance"))


def fifth_distances(spark, d):
    keys = spark.createDataFrame([(k,) for k in ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]], "key string")
    return keys.join(keys.withColumnRenamed("key", "other"), F.lit(True)).select("key", "other", S.fifth_distance(F.col("key"), F.col("other")).alias("steps"), S.fifth_distance(F.col("key"), F.col("other"), False).alias("raw_steps"))


def tempo_fit(spark, d):
    return Star(spark, d).audio_features().select("song_id", F.round(S.tempo_fit(F.col("bpm")), 6).alias("fit"), F.round(S.golden_climax(F.col("climax_frac")), 6).alias("golden"), F.round(S.fibonacci_balance(F.col("energy"), F.col("brightness")), 6).alias("balance"))


def zipf_prior(spark, d):
    s = Star(spark, d).songs()
    return s.select("song_id", F.round(S.zipf_prior(F.col("song_id").cast("int"), F.lit(200)), 6).alias("prior"), S.interval_words(F.col("duration") * 60).alias("spoken"))


def track_reasons(spark, d):
    t = F.concat("title", F.when(F.length("title") % 2 == 0, F.lit(" chorus choir")).otherwise(F.lit(" dance party")))
    c = F.when(F.col("genre_code") < 10, F.col("channel"))
    return Star(spark, d).songs().select("song_id", F.array_join(S.track_reasons(t, F.col("duration"), c), "; ").alias("reasons"))


def claims(spark, d):
    return spark.createDataFrame([(k, *v) for k, v in S.CLAIMS.items()], "topic string, claim string, mathematics string")


QUERIES = {
    f.__name__: f
    for f in (
        track_reasons, claims, taste_nodes, taste_edges, taste_profile, emotion_now, emotion_recent, streaks, weekly_digest, feel_like, feel_like_mood, nearest_vectors, lyric_lines, lyric_sections, captions, agent_brief, heard_library, dossier,
        intervals, fifth_distances, tempo_fit, zipf_prior,
    )
}

_V = ("listens", "audio", "ledger")
_MOOD = "CASE WHEN coalesce(nullif(valence, 0), 0.5) < 0.35 THEN 'low' WHEN coalesce(nullif(valence, 0), 0.5) > 0.6 THEN 'high' ELSE 'mid' END"
_EMOTION = """l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS i FROM ledger QUALIFY i <= 10), w AS (SELECT *, 0.5::DOUBLE + 0.5::DOUBLE * {p} / n AS w FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM l)),
m AS (SELECT user_id, sum(arousal * w) / sum(w) AS a, sum(coalesce(nullif(valence, 0), 0.5) * w) / sum(w) AS v, count(*) AS n FROM w GROUP BY 1)
SELECT user_id, round(a, 3) AS arousal, round(v, 3) AS valence, CASE WHEN a > 0.7 THEN 'burning ' WHEN a < 0.35 THEN 'quiet ' ELSE '' END || CASE WHEN v < 0.35 THEN 'aching' WHEN v > 0.6 THEN 'warm' ELSE 'wistful' END AS label, n FROM m"""
_FEEL = "fv AS (SELECT song_id, [least(bpm / 200, 1), coalesce(nullif(danceability, 0), 0.5), coalesce(nullif(valence, 0), 0.5), coalesce(nullif(energy, 0), 0.5), coalesce(nullif(brightness, 0), 0.5), coalesce(nullif(harmonic_clarity, 0), 0.5)]::DOUBLE[] AS v FROM audio)"
_COS = "round(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})) + 1e-9), {n})"
_LINES = "lines AS (SELECT song_id, i * 60.0::DOUBLE + 10 + i + 0.5 AS t, 'line ' || i || ' of ' || title AS line FROM songs, (SELECT unnest(range(0, 4)) AS i))"
_SECT = f"{_LINES}, sect AS (SELECT l.*, ((least(floor(t / 10)::INT, 9) * 37 + duration) % 100) / 100.0::DOUBLE AS arousal FROM lines l JOIN songs USING (song_id))"
_SECTION = "CASE WHEN arousal < 0.3 THEN 'verse' WHEN arousal < 0.5 THEN 'lift' ELSE 'chorus' END"
_CAPTION = """CASE WHEN bpm <= 0 THEN 'Untimed' WHEN bpm < 90 THEN 'Slow' WHEN bpm < 110 THEN 'Relaxed' WHEN bpm < 135 THEN 'Driving' ELSE 'Racing' END || ' ' || CASE WHEN mode = 'minor' THEN CASE WHEN valence < 0.35 THEN 'mournful' WHEN valence < 0.55 THEN 'pensive' ELSE 'gentle' END ELSE CASE WHEN valence > 0.6 THEN 'bright' WHEN valence > 0.4 THEN 'mellow' ELSE 'bittersweet' END END
 || ' song in ' || musical_key || ' ' || mode || CASE WHEN bpm > 0 THEN ' at ' || round(bpm)::INT || ' BPM' ELSE '' END || ': ' || CASE WHEN energy < 0.4 THEN 'soft' WHEN energy < 0.7 THEN 'even' ELSE 'forceful' END || ' and ' || CASE WHEN brightness < 0.35 THEN 'close' WHEN brightness < 0.6 THEN 'plain' ELSE 'airy' END
 || CASE WHEN harmonic_clarity > 0.6 THEN ', clear' WHEN harmonic_clarity < 0.3 THEN ', blurred' ELSE '' END || '; it ' || CASE WHEN lift < 0.15 THEN 'stays level' ELSE CASE WHEN lift > 0.35 THEN 'rises steeply, cresting ' ELSE 'rises a little, cresting ' END || CASE WHEN climax_frac < 0.4 THEN 'early' WHEN climax_frac < 0.8 THEN 'past the middle' ELSE 'at the end' END END || '.'
 || CASE WHEN voice_pct > 0.05 THEN ' A voice enters after ' || round(voice_enter_s)::INT || ' s.' ELSE '' END"""
_KEYS = "keys AS (SELECT unnest(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']) AS key)"
_AT = "coalesce(list_position(['C','G','D','A','E','B','F#','C#','Ab','Eb','Bb','F'], {k}), 0)"
_FLAT = "CASE {k} WHEN 'G#' THEN 'Ab' WHEN 'D#' THEN 'Eb' WHEN 'A#' THEN 'Bb' ELSE {k} END"
_STEPS = "CASE WHEN {a} = 0 OR {b} = 0 THEN 6 ELSE least(abs({a} - {b}), 12 - abs({a} - {b})) END"
_PHI = repr(S.GOLDEN) + "::DOUBLE"

_DANCE = "least(1, 0.7::DOUBLE * (0.5 + 0.25::DOUBLE * 1.9) + 0.3::DOUBLE * exp(-0.5::DOUBLE * pow((duration / 60.0::DOUBLE - 3.5) / 2, 2)))"

ORACLES = {
    "track_reasons": with_views("songs", then=f"""t AS (SELECT *, length(title) % 2 = 0 AS even, len(regexp_extract_all(lower(title), '[a-z]+')) + 2 AS n FROM songs)
SELECT song_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN even AND 0.5 + 1.7::DOUBLE / n * 0.5 > 0.6 THEN 'consonant' END, CASE WHEN NOT even AND {_DANCE} > 0.65 THEN 'danceable' END, CASE WHEN even THEN 'singable' END, CASE WHEN genre_code < 10 THEN 'voice of ' || channel END], lambda x: x IS NOT NULL), '; '), ''), 'melodic') AS reasons FROM t"""),
    "claims": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (k, *v)) + ")" for k, v in S.CLAIMS.items()) + ") t(topic, claim, mathematics)",
    "taste_nodes": with_views("audio", then=f"SELECT 't:' || song_id AS id, 'track' AS kind, song_id AS label FROM audio UNION ALL SELECT DISTINCT 'key:' || musical_key || '-' || mode, 'key', musical_key || '-' || mode FROM audio UNION ALL SELECT DISTINCT 'mood:' || {_MOOD}, 'mood', {_MOOD} FROM audio"),
    "taste_edges": with_views(*_V, then=f"""st AS (SELECT song_id AS a, lead(song_id) OVER (PARTITION BY user_id ORDER BY ts, id) AS b FROM ledger), s AS (SELECT a, b, count(*) AS n FROM st WHERE a <> b GROUP BY 1, 2)
SELECT 't:' || song_id AS a, 'key:' || musical_key || '-' || mode AS b, 'in-key' AS kind, 1.0::DOUBLE AS w FROM audio UNION ALL SELECT 't:' || song_id, 'mood:' || {_MOOD}, 'feels', 1.0 FROM audio
UNION ALL SELECT 't:' || a, 't:' || b, 'followed', n FROM s UNION ALL SELECT 't:' || a, 't:' || b, 'same-color', n * 0.5 FROM s JOIN audio x ON x.song_id = a JOIN audio y ON y.song_id = b WHERE x.musical_key = y.musical_key"""),
    "taste_profile": with_views("audio", then="""k AS (SELECT musical_key || ' ' || mode AS k, count(*) AS n FROM audio GROUP BY 1)
SELECT (SELECT k FROM k ORDER BY n DESC, k LIMIT 1) AS home_key, round(avg(bpm) FILTER (bpm <> 0), 1) AS bpm_mean, round(avg(coalesce(nullif(valence, 0), 0.5)), 3) AS valence_mean, round(avg(coalesce(nullif(danceability, 0), 0.5)), 3) AS dance_mean, count(*) AS n FROM audio"""),
    "emotion_now": with_views(*_V, then=_EMOTION.format(p="i")),
    "emotion_recent": with_views(*_V, then=_EMOTION.format(p="(n - i + 1)")),
    "streaks": with_views("listens", then=f"""dd AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM (SELECT DISTINCT user_id, started_at::DATE AS day FROM listens) QUALIFY r <= 30)
SELECT user_id, count(*) FILTER (day + r::INT = DATE '{TODAY}' + 1) AS streak FROM dd GROUP BY 1"""),
    "weekly_digest": with_views("listens", "feedback", then=f"""e AS (SELECT user_id, 1 AS p, 0 AS l FROM listens WHERE started_at::DATE >= DATE '{TODAY}' - 7 UNION ALL SELECT user_id, 0, 1 FROM feedback WHERE signal > 0 AND created_at::DATE >= DATE '{TODAY}' - 7)
SELECT user_id, sum(p)::BIGINT AS plays, sum(l)::BIGINT AS likes FROM e GROUP BY 1"""),
    "feel_like": with_views("audio", then=f"{_FEEL}, seed AS (SELECT v AS s FROM fv WHERE song_id = '7')\nSELECT song_id, {_COS.format(a='s', b='v', n=6)} AS feel_score FROM fv, seed WHERE song_id <> '7' ORDER BY 2 DESC, 1 LIMIT 20"),
    "feel_like_mood": with_views("audio", then=f"{_FEEL}, seed AS (SELECT [0.4, 0.5, 0.2, 0.5, 0.3, 0.4]::DOUBLE[] AS s)\nSELECT song_id, {_COS.format(a='s', b='v', n=6)} AS feel_score FROM fv, seed ORDER BY 2 DESC, 1 LIMIT 20"),
    "nearest_vectors": f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), seed AS (SELECT v AS s FROM e WHERE vec_id = 0) SELECT vec_id, {_COS.format(a='s', b='v', n=5)} AS cos FROM e, seed WHERE vec_id <> 0 ORDER BY 2 DESC, 1 LIMIT 50",
    "lyric_lines": with_views("songs", then=f"{_LINES}\nSELECT song_id, t, line FROM lines"),
    "lyric_sections": with_views("songs", then=f"{_SECT}\nSELECT song_id, t, line, arousal, {_SECTION} AS section FROM sect"),
    "captions": with_views("audio", then=f"SELECT song_id, {_CAPTION} AS caption FROM audio"),
    "agent_brief": with_views("audio", then=f"c AS (SELECT song_id, {_CAPTION} AS caption FROM audio ORDER BY song_id LIMIT 12)\nSELECT string_agg(song_id || ': ' || caption, chr(10) ORDER BY song_id) AS brief FROM c"),
    "heard_library": with_views("audio", then=f"SELECT song_id, bpm, musical_key, mode, danceability, valence, energy, length({_CAPTION})::INT AS caption_length FROM audio"),
    "dossier": with_views("audio", "songs", then=f"""{_SECT}, {_FEEL}, near AS (SELECT f.song_id, {_COS.format(a='s.v', b='f.v', n=6)} AS c FROM fv f, fv s WHERE s.song_id = '1' AND f.song_id <> '1' ORDER BY 2 DESC, 1 LIMIT 3)
SELECT song_id, bpm, musical_key, (SELECT string_agg({_SECTION}, ',' ORDER BY t) FROM sect WHERE song_id = '1') AS sections, (SELECT string_agg(song_id, ',' ORDER BY c DESC, song_id) FROM near) AS near FROM audio WHERE song_id = '1'"""),
    "intervals": "SELECT i AS semitones, round((" + repr([c for _, c in S.interval_table()]) + "::DOUBLE[])[i % 12 + 1], 6) AS consonance FROM (SELECT unnest(range(0, 25)) AS i)",
    "fifth_distances": f"WITH {_KEYS}, p AS (SELECT a.key, b.key AS other, {_AT.format(k='a.key')} AS ra, {_AT.format(k='b.key')} AS rb, {_AT.format(k=_FLAT.format(k='a.key'))} AS fa, {_AT.format(k=_FLAT.format(k='b.key'))} AS fb FROM keys a, keys b) SELECT key, other, {_STEPS.format(a='fa', b='fb')}::INT AS steps, {_STEPS.format(a='ra', b='rb')}::INT AS raw_steps FROM p",
    "tempo_fit": with_views("audio", then=f"SELECT song_id, round(CASE WHEN bpm <= 0 THEN 0.5 ELSE exp(-0.5::DOUBLE * pow((bpm - 120) / 35, 2)) END, 6) AS fit, round(greatest(0, 1 - abs(climax_frac - 1 / {_PHI}) * {_PHI}), 6) AS golden, round(CASE WHEN energy <= 0 OR brightness <= 0 THEN 0.5 ELSE greatest(0, 1 - abs(greatest(energy, brightness) / least(energy, brightness) - {_PHI}) / {_PHI}) END, 6) AS balance FROM audio"),
    "zipf_prior": with_views("songs", then="SELECT song_id, round(0.5 * pow(greatest(song_id::INT, 1), -1.2::DOUBLE) + 0.5 * (1 - greatest(song_id::INT, 1) / 200), 6) AS prior, CASE WHEN duration % 60 = 0 THEN (duration // 60) || 'h' ELSE duration || 'm' END AS spoken FROM songs"),
}
