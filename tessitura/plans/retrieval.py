"""Retrieval, content and bandit queries, and the flagship: top ten for every user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.operators import catalog as C
from tessitura.operators import content as T
from tessitura.operators import ensemble
from tessitura.operators import retrieval as R
from tessitura.plans.frames import FRAME, frame_of
from tessitura.sources.scratch import materialize
from tessitura.sources.star import NOW, Star, with_views

_V = ("listens", "feedback")
_POS = "pos AS (SELECT user_id, song_id, timestamp FROM frame WHERE plan_reward > 0)"
_OLD = "old AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, song_id) AS i FROM pos QUALIFY i <= 60)"
_LAST = "hist AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, song_id DESC) AS back FROM pos)"
_CO = """half AS (SELECT least(a.song_id, b.song_id) AS x, greatest(a.song_id, b.song_id) AS y, count(*) AS weight FROM old a JOIN old b ON a.user_id = b.user_id AND b.i BETWEEN a.i + 1 AND a.i + 10 AND a.song_id <> b.song_id GROUP BY 1, 2),
co AS (SELECT x AS src, y AS dst, weight FROM half UNION ALL SELECT y, x, weight FROM half)"""
_KNN = """up AS (SELECT DISTINCT user_id, song_id FROM {pos}), deg AS (SELECT song_id, count(*) AS n FROM up GROUP BY 1),
shared AS (SELECT a.song_id AS src, b.song_id AS dst, count(*) AS n FROM up a JOIN up b USING (user_id) WHERE a.song_id <> b.song_id GROUP BY 1, 2),
knn AS (SELECT src, dst, round(s.n / sqrt((x.n * y.n)::DOUBLE), 9) AS sim, row_number() OVER (PARTITION BY src ORDER BY round(s.n / sqrt((x.n * y.n)::DOUBLE), 9) DESC, dst) AS r FROM shared s JOIN deg x ON x.song_id = src JOIN deg y ON y.song_id = dst QUALIFY r <= 50)"""
_EXPAND = """{n} AS (SELECT user_id, dst AS song_id, ((sum(round({w} * 1e9)::BIGINT) + 500)::BIGINT // 1000) / 1e6::DOUBLE AS w FROM (SELECT * FROM hist WHERE back <= 20) h JOIN {e} ON h.song_id = src GROUP BY 1, 2)"""
_POPULAR = "popular AS (SELECT song_id, row_number() OVER (ORDER BY view_count DESC, song_id) AS pos FROM songs)"
_BASE = f"{FRAME}, {_POS}, {_OLD}, {_LAST}, {_CO}, {_KNN.format(pos='pos')}"
_TFIDF = r"""docs AS (SELECT song_id, list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'), '\s+'), lambda w: w <> '') AS ws FROM songs),
tf AS (SELECT song_id, len(ws) AS len, term, count(*) AS tf FROM (SELECT song_id, ws, unnest(ws) AS term FROM docs) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM songs),
raw AS (SELECT song_id, term, tf / len * (ln((n + 1) / (df + 1)) + 1) AS x FROM tf JOIN df USING (term), n WHERE df >= 2 AND df <= 0.8::DOUBLE * n),
vecs AS (SELECT song_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY song_id)), 9) AS weight FROM raw)"""
_PROFILE = """hl AS (SELECT user_id, song_id, sum(greatest(coalesce(nullif(completion_pct, 0), 0.3), 0.1)) AS w FROM (SELECT * FROM listens QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) <= 200) GROUP BY 1, 2),
tot AS (SELECT user_id, sum(w) AS total FROM hl WHERE song_id IN (SELECT song_id FROM vecs) GROUP BY 1),
mean AS (SELECT user_id, term, sum(w * weight) / any_value(total) AS x FROM hl JOIN vecs USING (song_id) JOIN tot USING (user_id) GROUP BY 1, 2),
prof AS (SELECT user_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id)), 9) AS weight FROM mean)"""


class Retriever(ensemble.Retriever):
    """The candidate sources over one folder of tables; of all its positives, unless a frame is given."""

    def __init__(self, spark, d, frame=None):
        self.star = Star(spark, d)
        self.songs = self.star.songs()
        frame = materialize(frame_of(spark, d), "frame") if frame is None else frame
        super().__init__(frame, R.fresh(C.latest_snapshot(self.star.feed_songs()), 500), R.popular(self.songs, 500))

    def scored(self):
        return self.score(self.pool())


def flagship_topk(spark, d):
    """Retrieve, score, cap genres at three, and take the top ten of every user."""
    r = Retriever(spark, d)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("raw"), "song_id"))
    ranked = R.cap_per_genre(r.scored().withColumn("rank", rank), r.songs)
    return ranked.where("rank <= 10").select("user_id", "rank", "song_id", "genre_code", "raw", "score")


def sparse_frame(spark, d):
    """Purchases as a frame: the first of each (customer, part)."""
    p = Star(spark, d).purchases()
    return p.groupBy("user_id", "song_id").agg(F.min("ts").alias("timestamp")).withColumn("plan_reward", F.lit(1.0))


def flagship_topk_sparse(spark, d):
    """Item neighbours over the large purchase log: ten new parts for every customer."""
    f = materialize(sparse_frame(spark, d), "sparse-frame")  # read three times
    return R.top_new(f).select("user_id", "rank", "song_id", F.col("w").alias("score"))


def cooccurrence(spark, d):
    return R.cooccurrence(frame_of(spark, d))


def item_knn(spark, d):
    return R.item_knn(frame_of(spark, d)).select("src", "dst", "sim")


def history_expansion(spark, d):
    f = frame_of(spark, d)
    return R.expand(f, R.cooccurrence(f), "weight")


def pool_merge(spark, d):
    return Retriever(spark, d).pool()


def retriever_score(spark, d):
    return Retriever(spark, d).scored().select("user_id", "song_id", "raw", "score")


def markov(spark, d):
    return R.markov(frame_of(spark, d))


def skipgram_pairs(spark, d):
    return R.window_pairs(frame_of(spark, d), 3).groupBy("song_id", "other").agg(F.count(F.lit(1)).alias("n"))


def top_popular(spark, d):
    return R.popular(Star(spark, d).songs(), 500)


def doc_freq(spark, d):
    docs = Star(spark, d).raw("documents").select(F.col("doc_id").cast("string").alias("song_id"), F.col("text").alias("title"))
    return T.document_frequency(T.terms(docs))


def _vectors(spark, d):
    return T.tfidf(Star(spark, d).songs())


def tfidf(spark, d):
    return _vectors(spark, d).withColumn("weight", F.round("weight", 6))


def user_profile(spark, d):
    return T.profiles(Star(spark, d).listens(), _vectors(spark, d)).withColumn("weight", F.round("weight", 6))


def content_score(spark, d):
    s, v = Star(spark, d), _vectors(spark, d)
    pairs = s.feedback().select("user_id", "song_id").distinct()
    return T.content_score(pairs, T.profiles(s.listens(), v), v).select("user_id", "song_id", F.round("s_content", 6).alias("s_content"))


def _arms(spark, d):
    return T.posteriors(Star(spark, d).feedback().select("user_id", "song_id", F.col("signal").cast("double").alias("reward")))


def bandit_posterior(spark, d):
    return _arms(spark, d)


def bandit_confidence(spark, d):
    return T.bandit_confidence(_arms(spark, d)).select("user_id", "song_id", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6).alias("mean"), F.round("confidence", 6).alias("confidence"))


def song_feature_tokens(spark, d):
    s = Star(spark, d)
    return T.song_tokens(s.songs(), s.audio_features())


def user_feature_tokens(spark, d):
    return T.user_tokens(Star(spark, d).listens().select("user_id").distinct())


def metadata_vector(spark, d):
    return T.metadata_vector(Star(spark, d).songs()).select("song_id", F.posexplode("features").alias("i", "x"))


def math_vector(spark, d):
    return T.math_vector(Star(spark, d).songs()).select("song_id", F.posexplode("priors").alias("i", "x"))


QUERIES = {f.__name__: f for f in (flagship_topk, flagship_topk_sparse, cooccurrence, item_knn, history_expansion, pool_merge, retriever_score, markov, skipgram_pairs, top_popular, doc_freq, tfidf, user_profile, content_score, bandit_posterior, bandit_confidence, song_feature_tokens, user_feature_tokens, metadata_vector, math_vector)}

_TOP = lambda n, w, k, e: f"{n} AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {w} DESC, dst) AS tr FROM {e} QUALIFY tr <= {k})"
_SCORED = f"""{_BASE}, {_TOP('co30', 'weight', 30, 'co')}, {_TOP('knn30', 'sim', 30, 'knn')}, {_POPULAR},
{_EXPAND.format(n='co_sum', w='weight', e='co30')}, {_EXPAND.format(n='knn_sum', w='sim', e='knn30')}, {_EXPAND.format(n='co_all', w='weight', e='co')}, {_EXPAND.format(n='knn_all', w='sim', e='knn')},
fresh AS (SELECT song_id, rank_in_snapshot AS pos FROM feed WHERE snapshot_id = (SELECT max(snapshot_id) FROM feed)),
us AS (SELECT DISTINCT user_id FROM pos),
parts AS (
  SELECT user_id, song_id, 0 AS source, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, song_id) AS pos FROM co_sum QUALIFY pos <= 500
  UNION ALL SELECT user_id, song_id, 1, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, song_id) AS pos FROM knn_sum QUALIFY pos <= 500
  UNION ALL SELECT user_id, song_id, 2, pos FROM us, fresh WHERE pos <= 500
  UNION ALL SELECT user_id, song_id, 3, pos FROM us, popular WHERE pos <= 500),
once AS (SELECT user_id, song_id, source, pos, row_number() OVER (PARTITION BY user_id, song_id ORDER BY source, pos) AS o FROM parts ANTI JOIN (SELECT * FROM hist WHERE back <= 60) h USING (user_id, song_id) QUALIFY o = 1),
pool AS (SELECT user_id, song_id, source, row_number() OVER (PARTITION BY user_id ORDER BY source, pos, song_id) AS place FROM once QUALIFY place <= 2000),
scored AS (SELECT user_id, song_id, source, place, round(log10(1 + coalesce(c.w, 0)) * 0.5 + least(coalesce(k.w, 0), 2.0) * 0.25 + CASE WHEN song_id IN (SELECT song_id FROM fresh WHERE pos <= 200) THEN 0.2 ELSE 0 END + CASE WHEN song_id IN (SELECT song_id FROM popular WHERE pos <= 200) THEN 0.1 ELSE 0 END, 6) AS raw
  FROM pool LEFT JOIN co_all c USING (user_id, song_id) LEFT JOIN knn_all k USING (user_id, song_id))"""
_SPARSE = """pos AS (SELECT user_id, song_id, min(ts) AS timestamp FROM purchases GROUP BY 1, 2)"""

ORACLES = {
    "flagship_topk": with_views(*_V, "songs", "feed", then=f"""{_SCORED},
ranked AS (SELECT s.*, coalesce(genre_code, 20) AS genre_code, row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, song_id) AS r0 FROM scored s LEFT JOIN songs USING (song_id)),
capped AS (SELECT *, row_number() OVER (PARTITION BY user_id, genre_code ORDER BY r0) AS g FROM ranked QUALIFY g <= 3)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY r0) AS rank, song_id, genre_code, raw, round(least(raw, 1.0) * 2 - 1, 6) AS score FROM capped QUALIFY rank <= 10"""),
    "flagship_topk_sparse": with_views("purchases", then=f"""{_SPARSE}, {_LAST}, {_KNN.format(pos='pos')}, {_EXPAND.format(n='ex', w='sim', e='knn')}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, song_id) AS rank, song_id, w AS score FROM ex ANTI JOIN pos USING (user_id, song_id) QUALIFY rank <= 10"""),
    "cooccurrence": with_views(*_V, then=f"{FRAME}, {_POS}, {_OLD}, {_CO}\nSELECT * FROM co"),
    "item_knn": with_views(*_V, then=f"{FRAME}, {_POS}, {_KNN.format(pos='pos')}\nSELECT src, dst, sim FROM knn"),
    "history_expansion": with_views(*_V, then=f"{FRAME}, {_POS}, {_OLD}, {_LAST}, {_CO}, {_TOP('co30', 'weight', 30, 'co')}, {_EXPAND.format(n='ex', w='weight', e='co30')}\nSELECT * FROM ex"),
    "pool_merge": with_views(*_V, "songs", "feed", then=f"{_SCORED}\nSELECT * FROM pool"),
    "retriever_score": with_views(*_V, "songs", "feed", then=f"{_SCORED}\nSELECT user_id, song_id, raw, round(least(raw, 1.0) * 2 - 1, 6) AS score FROM scored"),
    "markov": with_views(*_V, then=f"""{FRAME}, {_POS}, st AS (SELECT song_id AS src, lead(song_id) OVER (PARTITION BY user_id ORDER BY timestamp, song_id) AS dst FROM pos),
c AS (SELECT src, dst, count(*) AS n FROM st WHERE dst IS NOT NULL GROUP BY 1, 2)
SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 9) AS p FROM c"""),
    "skipgram_pairs": with_views(*_V, then=f"{FRAME}, {_POS}, {_OLD}\nSELECT a.song_id, b.song_id AS other, count(*) AS n FROM old a JOIN old b ON a.user_id = b.user_id AND b.i BETWEEN a.i + 1 AND a.i + 3 AND a.song_id <> b.song_id GROUP BY 1, 2"),
    "top_popular": with_views("songs", then=f"{_POPULAR}\nSELECT * FROM popular WHERE pos <= 500"),
    "doc_freq": r"""WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'), '\s+'), lambda w: w <> '')) AS term FROM documents) SELECT term, count(*) AS df FROM w GROUP BY 1""",
    "tfidf": with_views("songs", then=f"{_TFIDF}\nSELECT song_id, term, round(weight, 6) AS weight FROM vecs"),
    "user_profile": with_views("songs", "listens", then=f"{_TFIDF}, {_PROFILE}\nSELECT user_id, term, round(weight, 6) AS weight FROM prof"),
    "content_score": with_views("songs", *_V, then=f"""{_TFIDF}, {_PROFILE}, pairs AS (SELECT DISTINCT user_id, song_id FROM feedback),
dots AS (SELECT p.user_id, p.song_id, sum(v.weight * f.weight) AS c FROM pairs p JOIN vecs v USING (song_id) JOIN prof f ON f.user_id = p.user_id AND f.term = v.term GROUP BY 1, 2)
SELECT user_id, song_id, round(CASE WHEN song_id IN (SELECT song_id FROM vecs) AND user_id IN (SELECT user_id FROM prof) THEN coalesce(c, 0) * 2 - 1 ELSE 0 END, 6) AS s_content FROM pairs LEFT JOIN dots USING (user_id, song_id)"""),
    "bandit_posterior": with_views("feedback", then="SELECT user_id, song_id, 1 + sum(greatest(signal, 0))::DOUBLE AS alpha, 1 + sum(greatest(-signal, 0))::DOUBLE AS beta, count(*) AS n_pulls FROM feedback GROUP BY 1, 2"),
    "bandit_confidence": with_views("feedback", then="""a AS (SELECT user_id, song_id, 1 + sum(greatest(signal, 0))::DOUBLE AS a, 1 + sum(greatest(-signal, 0))::DOUBLE AS b FROM feedback GROUP BY 1, 2)
SELECT user_id, song_id, round(a / (a + b), 6) AS mean, round(1 - least(a * b / ((a + b) * (a + b) * (a + b + 1)) * 10, 1), 6) AS confidence FROM a"""),
    "song_feature_tokens": with_views("songs", "audio", then="""j AS (SELECT s.*, a.bpm, a.musical_key, a.mode, a.brightness, a.danceability FROM songs s LEFT JOIN audio a USING (song_id)),
t AS (SELECT song_id, unnest(['genre:' || genre_code, 'lang:' || language_code, 'energy:' || CASE WHEN energy_score > 0.66 THEN 'hi' WHEN energy_score < 0.33 THEN 'lo' ELSE 'mid' END, 'artist:' || substring(channel, 1, 48), 'key:' || musical_key || '-' || mode,
 'tempo:' || CASE WHEN bpm > 0 THEN CASE WHEN bpm < 90 THEN 'slow' WHEN bpm < 130 THEN 'mid' ELSE 'fast' END END, 'bright:' || CASE WHEN brightness > 0.66 THEN 'hi' WHEN brightness < 0.33 THEN 'lo' WHEN brightness IS NOT NULL THEN 'mid' END, 'dance:' || CASE WHEN danceability > 0.66 THEN 'hi' WHEN danceability < 0.33 THEN 'lo' WHEN danceability IS NOT NULL THEN 'mid' END]) AS token FROM j)
SELECT * FROM t WHERE token IS NOT NULL"""),
    "user_feature_tokens": with_views("listens", then="SELECT user_id, unnest(['u:' || user_id % 97, 'tod:3', 'dow:2']) AS token FROM (SELECT DISTINCT user_id FROM listens)"),
    "metadata_vector": with_views("songs", then="""v AS (SELECT song_id, [log10(view_count), like_count / view_count, least(duration / 600.0::DOUBLE, 1), 0, 0.5, least(length(title) / 100.0::DOUBLE, 1), 0, 0, 0, language_code / 9.0::DOUBLE, genre_code / 20.0::DOUBLE, energy_score]::DOUBLE[] AS f FROM songs)
SELECT song_id, i - 1 AS i, round(f[i], 6) AS x FROM v, (SELECT unnest(range(1, 13)) AS i)"""),
    "math_vector": with_views("songs", then="""v AS (SELECT song_id, [0.5, 0.7::DOUBLE * 0.5 + 0.3::DOUBLE * exp(-0.5::DOUBLE * pow((duration / 60.0::DOUBLE - 3.5) / 2, 2)), 0.5, least(duration / 600.0::DOUBLE, 1), least(length(title) / 100.0::DOUBLE, 1), coalesce(nullif(energy_score, 0), 0.5), 0.95, least((length(title) - length(replace(title, ' ', '')) + 1) / 12.0::DOUBLE, 1)]::DOUBLE[] AS f FROM songs)
SELECT song_id, i - 1 AS i, round(f[i], 6) AS x FROM v, (SELECT unnest(range(1, 9)) AS i)"""),
}
