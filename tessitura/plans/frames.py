"""Interaction frame, split, negatives and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.operators import interactions as I
from tessitura.operators.order import numbered
from tessitura.sources.scratch import materialize
from tessitura.sources.star import NOW, Star, with_views

_FRAME = """
first_listens AS (SELECT * FROM listens QUALIFY row_number() OVER (PARTITION BY user_id, song_id ORDER BY id) = 1),
last_feedback AS (SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY user_id, song_id ORDER BY id DESC) = 1),
base AS (
  SELECT user_id, song_id, signal::DOUBLE AS reward, CASE WHEN signal > 0 THEN 5.0 ELSE -5.0 END::DOUBLE AS plan_reward, created_at AS timestamp, 'feedback' AS source FROM last_feedback
  UNION ALL
  SELECT user_id, song_id, r, r, started_at, 'listen' FROM (SELECT *, CASE WHEN completion_pct >= 0.8 THEN 3.0 WHEN completion_pct >= 0.3 THEN 1.0 ELSE -2.0 END::DOUBLE AS r FROM first_listens) ANTI JOIN last_feedback USING (user_id, song_id)
)"""


def _confidence(c: str) -> str:
    return f"""frame AS (SELECT *, ({c}) * pow(0.5, greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(timestamp)) / 86400 / 30) AS confidence FROM base)"""


FRAME = f"{_FRAME}, {_confidence('CASE WHEN plan_reward > 0 THEN 1 + 2 * plan_reward ELSE 1 END')}"
_ALIAS = f"{_FRAME}, {_confidence('CASE WHEN plan_reward = 1 THEN 11 WHEN plan_reward > 0 THEN 1 + 2 * plan_reward ELSE 1 END')}"
SPLIT = """stamps AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM frame),
edge AS (SELECT timestamp AS edge_ts FROM stamps WHERE i = least(greatest(floor(0.85 * n), 1), n - 1)),
parted AS (SELECT *, CASE WHEN timestamp >= (SELECT edge_ts FROM edge) OR (plan_reward > 0 AND row_number() OVER (PARTITION BY user_id, plan_reward > 0 ORDER BY timestamp DESC, song_id DESC) <= 5) THEN 'valid' ELSE 'train' END AS part FROM frame)"""
#: A ranking to evaluate: each user's songs by how often all users like them in training, seen ones out.
RANKED = """likes AS (SELECT song_id, count(*) AS n FROM parted WHERE part = 'train' AND plan_reward > 0 GROUP BY song_id),
ranked AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, song_id) AS rank FROM (SELECT DISTINCT user_id FROM parted WHERE part = 'valid') CROSS JOIN likes ANTI JOIN (SELECT user_id, song_id FROM parted WHERE part = 'train') t USING (user_id, song_id)),
valid AS (SELECT * FROM parted WHERE part = 'valid')"""


def frame_of(spark, d, **options):
    s = Star(spark, d)
    return I.frame(s.listens(), s.feedback(), NOW, **options)


def split_of(spark, d):
    return I.split(frame_of(spark, d))


def _rounded(df):
    return df.withColumn("confidence", F.round("confidence", 6))


def interaction_frame(spark, d):
    return _rounded(frame_of(spark, d))


def interaction_frame_legacy_alias(spark, d):
    return _rounded(frame_of(spark, d, legacy_alias=True))


def temporal_split(spark, d):
    return split_of(spark, d).select("user_id", "song_id", "plan_reward", "timestamp", "part")


def leave_last_n(spark, d):
    return I.leave_last_rows(frame_of(spark, d), 5).select("user_id", "song_id", "timestamp")


def split_fingerprint(spark, d):
    return I.fingerprint(split_of(spark, d).where("part = 'train'"))


def frame_hash(spark, d):
    return I.fingerprint(frame_of(spark, d), F.format_string("%.2f", "reward"))


def running_average(spark, d):
    return I.running_average(Star(spark, d).feedback()).withColumn("average", F.round("average", 9))


def negatives_hash(spark, d):
    return I.negatives(frame_of(spark, d), Star(spark, d).songs())


def pairwise_triples(spark, d):
    return I.pairwise(frame_of(spark, d), Star(spark, d).songs())


def ordered_frame_hash(spark, d):
    """The running hash of all rewards in order of time, and of all stamps."""
    f = frame_of(spark, d)
    rewards, stamps = F.format_string("%.2f", "plan_reward"), F.round(F.unix_micros("timestamp") / 1e6).cast("long")
    return spark.createDataFrame([tuple(I.ordered_fingerprint(f, rewards, stamps))], "frame_hash string, split_hash string")


def ranked_and_valid(spark, d, k: int = 10):
    """Each validation user's first k songs by likes in training, without those the user has there; and the validation rows.

    A user with m training songs has their first k among the first k + m of all, so only those are met: no user
    meets the whole list, and none is cut off.
    """
    parted = materialize(split_of(spark, d), "parted")
    train, valid = parted.where("part = 'train'"), parted.where("part = 'valid'")
    likes = train.where("plan_reward > 0").groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    places = numbered(likes, [F.desc("n"), F.asc("song_id")], "place").select("place", "song_id")
    has = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("m"))
    users = valid.select("user_id").distinct().join(has, "user_id", "left")
    near = users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(0)) + k - 1)).alias("place")).join(places, "place")
    new = near.join(train.select("user_id", "song_id"), ["user_id", "song_id"], "left_anti")
    ranked = new.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("place"))).where(F.col("rank") <= k)
    return ranked.select("user_id", "song_id", "rank"), valid


def evaluation(spark, d):
    """Error and ranking of a score by damped song averages, over the validation rows."""
    parted = materialize(split_of(spark, d), "parted")
    train, valid = parted.where("part = 'train'"), parted.where("part = 'valid'")
    mean = train.agg(F.coalesce(F.avg("plan_reward"), F.lit(0.0)).alias("mean"))
    songs = train.groupBy("song_id").agg(F.sum("plan_reward").alias("s"), F.count(F.lit(1)).alias("n"))
    score = F.round((F.coalesce("s", F.lit(0.0)) + 5 * F.col("mean")) / (F.coalesce("n", F.lit(0)) + 5), 6)
    scored = valid.join(songs, "song_id", "left").join(F.broadcast(mean), F.lit(True)).select("user_id", "song_id", score.alias("score"))
    return I.evaluate(scored, valid).select(*[F.round(c, 6).alias(c) for c in ("rmse", "precision", "recall", "ndcg")], "users", "interactions")


def recall_ndcg_hit(spark, d):
    h = I.hits(*ranked_and_valid(spark, d))
    return h.select("user_id", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "hitrate", "standard_ndcg")])


def coverage_novelty(spark, d):
    return I.catalog_metrics(*ranked_and_valid(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("coverage", "novelty", "diversity")])


def genre_hitrate(spark, d):
    ranked, valid = ranked_and_valid(spark, d)
    return I.genre_hitrate(ranked, valid, Star(spark, d).songs()).withColumn("hitrate", F.round("hitrate", 6))


def promotion(spark, d):
    """Every day's model against the day before: daily likes stand for quality, daily songs for coverage."""
    e = Star(spark, d).feedback().groupBy(F.to_date("created_at").alias("day")).agg((F.count_if(F.col("signal") > 0) / F.count(F.lit(1))).alias("ndcg"), (F.count_distinct("song_id") / 100.0).alias("coverage"))
    w = Window.orderBy("day")  # a row a day
    prev = lambda c: F.lag(c).over(w)
    return e.select(F.col("day").cast("string").alias("day"), I.should_promote(F.col("ndcg"), F.col("coverage"), prev("ndcg"), prev("coverage")).alias("promote"))


def eval_mixture(spark, d):
    s = Star(spark, d).audio_features().select("song_id", F.col("danceability").alias("s_als"), F.col("valence").alias("s_two_tower"), F.col("energy").alias("s_retriever"), F.col("brightness").alias("s_sequence"))
    return s.select("song_id", F.round(S.weighted(S.EVAL_MIXTURE), 6).alias("score"))


QUERIES = {f.__name__: f for f in (interaction_frame, interaction_frame_legacy_alias, temporal_split, leave_last_n, split_fingerprint, frame_hash, ordered_frame_hash, running_average, negatives_hash, pairwise_triples, recall_ndcg_hit, coverage_novelty, genre_hitrate, evaluation, promotion, eval_mixture)}

_V = ("listens", "feedback")
_PRINT = """lines AS (SELECT md5(user_id || '|' || song_id || '|' || {v}) AS h FROM {t}),
sums AS (SELECT count(*) AS n, bit_xor(('0x' || substring(h, 1, 8))::BIGINT) AS a, bit_xor(('0x' || substring(h, 9, 8))::BIGINT) AS b, bit_xor(('0x' || substring(h, 17, 8))::BIGINT) AS c, bit_xor(('0x' || substring(h, 25, 8))::BIGINT) AS d FROM lines)
SELECT substring(sha256(concat_ws('|', n, a, b, c, d)), 1, 16) AS frame_hash FROM sums"""
_B = "('0x' || substring(md5('neg|' || kind || '|' || user_id || '|' || pos || '|' || k{more}), 1, 8))::BIGINT"
_NEG = f"""places AS (SELECT song_id AS neg, log10(greatest(view_count, 10)) AS w, row_number() OVER (ORDER BY song_id) - 1 AS i FROM songs),
likes AS (SELECT DISTINCT user_id, song_id FROM frame WHERE plan_reward > 0),
draws AS (SELECT user_id, song_id AS pos, kind, k FROM likes, (SELECT 'uniform' AS kind, unnest(range(1, 57)) AS k UNION ALL SELECT 'popular', unnest(range(1, 113))) t),
drawn AS (SELECT *, ({_B.format(more='')} * (SELECT count(*) FROM places)) // 4294967296 AS i FROM draws),
fair AS (SELECT user_id, pos, neg, kind, min(k) AS k FROM drawn JOIN places USING (i) WHERE (kind = 'uniform' OR ({_B.format(more=" || '|accept'")} + 0.5::DOUBLE) / 4294967296 < round(w / (SELECT max(w) FROM places), 6))
  AND (user_id, neg) NOT IN (SELECT (user_id, song_id) FROM likes) GROUP BY 1, 2, 3, 4),
uni AS (SELECT * FROM fair WHERE kind = 'uniform' QUALIFY row_number() OVER (PARTITION BY user_id, pos ORDER BY k) <= 2),
pops AS (SELECT f.* FROM fair f ANTI JOIN uni u ON f.user_id = u.user_id AND f.pos = u.pos AND f.neg = u.neg WHERE f.kind = 'popular' QUALIFY row_number() OVER (PARTITION BY f.user_id, f.pos ORDER BY f.k) <= 2),
negs AS (SELECT user_id, pos, neg, kind FROM uni UNION ALL SELECT user_id, pos, neg, kind FROM pops)"""
_HITS = """good AS (SELECT DISTINCT user_id, song_id FROM valid WHERE plan_reward > 0),
met AS (SELECT r.user_id, sum((g.song_id IS NOT NULL)::INT) AS h, sum((g.song_id IS NOT NULL)::INT / log2(rank + 1)) AS dcg FROM ranked r LEFT JOIN good g USING (user_id, song_id) WHERE rank <= 10 GROUP BY r.user_id),
users AS (SELECT user_id, count(*) AS relevant FROM good GROUP BY user_id),
ideals AS (SELECT n, sum(1 / log2(i + 1)) AS ideal FROM (SELECT unnest(range(1, 11)) AS n) a, (SELECT unnest(range(1, 11)) AS i) b WHERE i <= n GROUP BY n)
SELECT user_id, round(coalesce(h, 0) / relevant, 6) AS recall, CASE WHEN h > 0 THEN round(dcg / a.ideal, 6) ELSE 0.0 END::DOUBLE AS ndcg, CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hitrate, CASE WHEN h > 0 THEN round(dcg / b.ideal, 6) ELSE 0.0 END::DOUBLE AS standard_ndcg
FROM users LEFT JOIN met USING (user_id) LEFT JOIN ideals a ON a.n = h LEFT JOIN ideals b ON b.n = least(relevant, 10)"""

ORACLES = {
    "interaction_frame": with_views(*_V, then=f"{FRAME}\nSELECT * REPLACE (round(confidence, 6) AS confidence) FROM frame"),
    "interaction_frame_legacy_alias": with_views(*_V, then=f"{_ALIAS}\nSELECT * REPLACE (round(confidence, 6) AS confidence) FROM frame"),
    "temporal_split": with_views(*_V, then=f"{FRAME}, {SPLIT}\nSELECT user_id, song_id, plan_reward, timestamp, part FROM parted"),
    "leave_last_n": with_views(*_V, then=f"{FRAME}\nSELECT user_id, song_id, timestamp FROM frame WHERE plan_reward > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, song_id DESC) <= 5"),
    "split_fingerprint": with_views(*_V, then=f"{FRAME}, {SPLIT}, {_PRINT.format(v='round(epoch_us(timestamp) / 1e6)::BIGINT', t=chr(40) + 'SELECT * FROM parted WHERE part = ' + chr(39) + 'train' + chr(39) + chr(41))}"),
    "frame_hash": with_views(*_V, then=f"{FRAME}, {_PRINT.format(v='printf(' + chr(39) + '%.2f' + chr(39) + ', reward)', t='frame')}"),
    "running_average": with_views("feedback", then="""s AS (SELECT user_id, song_id, signal::DOUBLE AS x, row_number() OVER (PARTITION BY user_id, song_id ORDER BY id) AS i FROM feedback),
a AS (SELECT user_id, song_id, i, x FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.song_id, s.i, (a.x + s.x) / 2 FROM a JOIN s ON s.user_id = a.user_id AND s.song_id = a.song_id AND s.i = a.i + 1)
SELECT user_id, song_id, round(max_by(x, i), 9) AS average FROM a GROUP BY 1, 2"""),
    "negatives_hash": with_views(*_V, "songs", then=f"{FRAME}, {_NEG}\nSELECT * FROM negs"),
    "pairwise_triples": with_views(*_V, "songs", then=f"{FRAME}, {_NEG}\nSELECT user_id, pos, neg FROM negs"),
    "ordered_frame_hash": with_views(*_V, then=f"""{FRAME}
SELECT substring(sha256(string_agg(user_id || '|' || song_id || '|' || printf('%.2f', plan_reward), '' ORDER BY timestamp, user_id, song_id)), 1, 16) AS frame_hash, substring(sha256(string_agg(user_id || '|' || song_id || '|' || round(epoch_us(timestamp) / 1e6)::BIGINT, '' ORDER BY timestamp, user_id, song_id)), 1, 16) AS split_hash FROM frame"""),
    "evaluation": with_views(*_V, then=f"""{FRAME}, {SPLIT}, tr AS (SELECT * FROM parted WHERE part = 'train'), m AS (SELECT coalesce(avg(plan_reward), 0) AS mean FROM tr), g AS (SELECT song_id, sum(plan_reward) AS s, count(*) AS n FROM tr GROUP BY 1),
sc AS (SELECT v.user_id, v.song_id, plan_reward, round((coalesce(s, 0) + 5 * mean) / (coalesce(n, 0) + 5), 6) AS score FROM (SELECT * FROM parted WHERE part = 'valid') v LEFT JOIN g USING (song_id), m),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) AS rank FROM sc),
u AS (SELECT user_id, count(*) FILTER (plan_reward > 0 AND rank <= 10) AS h, coalesce(sum(1 / log2(rank + 1)) FILTER (plan_reward > 0 AND rank <= 10), 0) AS dcg, count(*) FILTER (plan_reward > 0) AS rel, sum(pow(plan_reward - score, 2)) AS sq, count(*) AS n FROM rk GROUP BY 1),
ideals AS (SELECT h AS n, sum(1 / log2(i + 1)) AS ideal FROM (SELECT unnest(range(1, 11)) AS h) a, (SELECT unnest(range(1, 11)) AS i) b WHERE i <= h GROUP BY 1)
SELECT round(sqrt(sum(sq) / sum(u.n)), 6) AS rmse, round(avg(h / 10) FILTER (rel > 0), 6) AS precision, round(avg(h / rel) FILTER (rel > 0), 6) AS recall, round(avg(CASE WHEN h > 0 THEN dcg / ideal ELSE 0 END) FILTER (rel > 0), 6) AS ndcg, count(*) FILTER (rel > 0) AS users, sum(u.n)::BIGINT AS interactions FROM u LEFT JOIN ideals ON ideals.n = h"""),
    "recall_ndcg_hit": with_views(*_V, then=f"{FRAME}, {SPLIT}, {RANKED}, {_HITS}"),
    "coverage_novelty": with_views(*_V, then=f"""{FRAME}, {SPLIT}, {RANKED},
shown AS (SELECT song_id, count(*) AS n FROM ranked WHERE rank <= 10 AND user_id IN (SELECT user_id FROM valid WHERE plan_reward > 0) GROUP BY song_id)
SELECT round(count(*) / (SELECT count(DISTINCT song_id) FROM valid), 6) AS coverage, round(avg(-log2(n / (SELECT sum(n) FROM shown) + 1e-9)), 6) AS novelty, round(least(1.0, count(*) / sum(n) * 10), 6) AS diversity FROM shown"""),
    "genre_hitrate": with_views(*_V, "songs", then=f"""{FRAME}, {SPLIT}, {RANKED}
SELECT coalesce(s.genre_code, 20) AS genre_code, round(avg((r.song_id IS NOT NULL)::INT), 6) AS hitrate FROM (SELECT * FROM valid WHERE plan_reward > 0) v LEFT JOIN songs s USING (song_id) LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.user_id = v.user_id AND r.song_id = v.song_id GROUP BY 1"""),
    "promotion": with_views("feedback", then="""e AS (SELECT created_at::DATE AS day, count(*) FILTER (signal > 0) / count(*) AS ndcg, count(DISTINCT song_id) / 100.0::DOUBLE AS coverage FROM feedback GROUP BY 1),
l AS (SELECT *, lag(ndcg) OVER (ORDER BY day) AS pn, lag(coverage) OVER (ORDER BY day) AS pc FROM e)
SELECT day::VARCHAR AS day, CASE WHEN pn IS NULL THEN true ELSE ndcg > pn AND CASE WHEN pc > 0 THEN (pc - coverage) / pc ELSE 0 END <= 0.05 END AS promote FROM l"""),
    "eval_mixture": with_views("audio", then="SELECT song_id, round(0.35::DOUBLE * danceability + 0.25::DOUBLE * valence + 0.25::DOUBLE * energy + 0.15::DOUBLE * brightness, 6) AS score FROM audio"),
}
