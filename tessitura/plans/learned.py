"""Learned models, whole recommendations, audio and streams. Where SQL has no form of it, rows only."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.operators import audio as W
from tessitura.operators import content as T
from tessitura.operators import ensemble as E
from tessitura.operators import interactions as I
from tessitura.operators import models as M
from tessitura.operators import retrieval as R
from tessitura.operators import serving as V
from tessitura.operators import topk as K
from tessitura.plans.frames import FRAME, frame_of, split_of
from tessitura.operators.model_store import ModelStore, input_versions
from tessitura.plans.retrieval import Retriever
from tessitura.plans.serving import NIGHT, _prefs
from tessitura.sources.scratch import folder, materialize, run_folder
from tessitura.sources.star import NOW, Star, with_views
from tessitura.streaming import signals as G

_OUT = ["user_id", "rank", "song_id", "score"]
#: What fits are kept under: part of the key of every stored model. Change it with the code of a fit.
SETTINGS = {"retriever": {"fresh": 500, "popular": 500}, "ensemble": {"rank": E.RANK, "light": False}}


def models(spark) -> ModelStore:
    """Where models are stored: the folder in ``tessitura.models.dir``, or else one of the application's own."""
    return ModelStore(spark, spark.conf.get("tessitura.models.dir", None) or f"{run_folder(spark)}/models")


def _name(d, kind: str) -> str:
    """Models of each folder of tables have names of their own."""
    return f"{kind}-{hashlib.sha256(str(d).encode()).hexdigest()[:12]}"


def _inputs(spark, d) -> dict[str, str]:
    return input_versions(spark, [f"{d}/{t}.parquet" for t in ("events", "part")])


def forget(spark, d) -> None:
    """Delete the stored models of a folder of tables: what is asked for next is fitted."""
    for kind in SETTINGS:
        models(spark).forget(_name(d, kind))


def _retriever(spark, d) -> Retriever:
    """Candidate sources fitted on all positives, and the pool, as stored."""

    def fit():
        own = Retriever(spark, d)
        return {**own.tables(), "pool": own.pool()}, {}

    m = models(spark).get(_name(d, "retriever"), fit, settings=SETTINGS["retriever"], inputs=_inputs(spark, d))
    own = Retriever.restored(m.tables)
    own.star, own.stored_pool = Star(spark, d), m.tables["pool"]
    own.songs = own.star.songs()
    return own


def _unseen(spark, d) -> DataFrame:
    return _retriever(spark, d).stored_pool.select("user_id", "song_id")


def _top(scored):
    return M.top_per_user(scored.withColumn("score", F.round("score", 6))).select(*_OUT)


def als_topk(spark, d):
    users, items = M.als(frame_of(spark, d), rank=16, iterations=5)
    return _top(M.score_pairs(_unseen(spark, d), users, items, 16))


def als_exact_topk(spark, d):
    """The exact top ten of all songs but each user's last 60, by plain regularised factors; 0 for a user or song without."""
    f, none = materialize(frame_of(spark, d), "frame"), F.array(*[F.lit(0.0)] * 8)
    users, items = M.exact_als(f, materialize, rank=8, iterations=2)
    every = Star(spark, d).songs().select("song_id").unionByName(f.select("song_id")).where("song_id is not null").distinct()
    # nobody has heard a song without factors, and all score 0: only the ten first by id can be among a user's ten
    unknown = every.join(items, "song_id", "left_anti").orderBy("song_id").limit(10).withColumn("vector", none)
    users = R.positives(f).select("user_id").distinct().join(users, "user_id", "left").withColumn("vector", F.coalesce("vector", none))
    return K.top_without(users, items.unionByName(unknown), R.last(f, R.HISTORY), 10, R.HISTORY, places=6).select(*_OUT)


def als_all_topk(spark, d):
    """The exact top ten of all songs for every user, heard ones among them, by plain regularised factors."""
    users, items = M.exact_als(frame_of(spark, d), materialize, rank=8, iterations=2)
    return K.top_products(users, items, 10).rows.withColumn("score", F.round("score", 6))


def max_product_topk(spark, d):
    """The ten vectors with the greatest product with each vector whose id is divisible by 20, among all."""
    e = Star(spark, d).raw("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = K.top_products(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "user_id"), e.withColumnRenamed("vec_id", "song_id"), 10)
    return found.rows.select(F.col("user_id").alias("seed"), "rank", F.col("song_id").alias("vec_id"), F.round("score", 6).alias("score"))


def svd_biases(spark, d):
    mean, users, items = M.biases(frame_of(spark, d))
    return users.select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id"), F.round("b_user", 6).alias("bias")).unionByName(items.select(F.lit("item").alias("kind"), F.col("song_id").alias("id"), F.round("b_item", 6).alias("bias")))


def svd_topk(spark, d):
    # the frame that the candidate sources stored: the fit reads it five times
    return _top(M.svd_predict(M.svd(_retriever(spark, d).frame, rank=8), _unseen(spark, d), rank=8))


def item2vec_nn(spark, d):
    """The songs nearest to every song whose id is divisible by 20."""
    vectors = materialize(M.item2vec(frame_of(spark, d)), "item2vec")
    return M.neighbours(vectors, Star(spark, d).songs().where("cast(song_id as int) % 20 = 0").select("song_id")).select("seed", "rank", "song_id", F.round("sim", 6).alias("sim"))


def _triples(spark, d):
    return I.pairwise(frame_of(spark, d), Star(spark, d).songs(), per_positive=2)


def two_tower_topk(spark, d):
    users, songs = M.pairwise_factors(_triples(spark, d), size=16, epochs=3, unit=True)
    pool = _unseen(spark, d)
    return _top(M.score_pairs(pool, users, M.with_hashed(songs, pool, 16), 16))


def fm_topk(spark, d):
    s = Star(spark, d)
    users, songs = M.pairwise_factors(_triples(spark, d), size=16, epochs=2, tokens=T.song_tokens(s.songs(), s.audio_features()))
    return _top(M.score_pairs(_unseen(spark, d), users, songs, 16))


def ncf_topk(spark, d):
    meta = T.metadata_vector(Star(spark, d).songs())
    users, songs, weights = M.neural(frame_of(spark, d), meta)
    j = _unseen(spark, d).join(users.withColumnRenamed("vector", "x"), "user_id", "left").join(songs.withColumnRenamed("vector", "y"), "song_id", "left").join(meta, "song_id", "left")
    return _top(j.select("user_id", "song_id", M.neural_score(weights)("x", "y", "features").alias("score")))


def sequence_markov(spark, d):
    """The score without its attention part: half certain, plus the next-song probability from the latest song."""
    n = M.next_songs(frame_of(spark, d))
    return n.select("user_id", "song_id", F.round((0.6 * 0.5 + 0.4 * F.least(5 * F.col("p"), F.lit(1.0))) * 2 - 1, 6).alias("score"))


def sequence_score(spark, d):
    f = frame_of(spark, d)
    return _top(M.attention_score(f, _unseen(spark, d), M.attention(f, size=16), 16))


def judged_pairs(spark, d):
    p = split_of(spark, d)
    return E.judged(p.where("part = 'train'"), p.where("part = 'valid'"))


def _ensemble(spark, d):
    """(ensemble fitted on the training part, blender weights from the validation part, candidate pool)."""

    def fit():
        s, parted = Star(spark, d), materialize(split_of(spark, d), "parted")
        train, valid = (parted.where(f"part = '{p}'").drop("part") for p in ("train", "valid"))
        train = materialize(train, "train")
        own = E.Ensemble(train, s.songs(), s.audio_features(), Retriever(spark, d, train))
        weights = materialize(own.blender(valid), "weights")
        return {**own.tables(), "blender": weights, "moods": own.mood_blender(valid, weights), "pool": own.retriever.pool()}, own.values()

    # one version is opened once: its tables and values belong together, whatever becomes current meanwhile
    m = models(spark).get(_name(d, "ensemble"), fit, settings=SETTINGS["ensemble"], inputs=_inputs(spark, d))
    own = E.Ensemble.restored(m.tables, m.values, Star(spark, d).songs())
    own.moods = m.tables["moods"]
    return own, m.tables["blender"], m.tables["pool"]


def blender_weights(spark, d):
    """Weights and pairwise accuracy of all users (-1) and of each with five judged pairs or more."""
    w = _ensemble(spark, d)[1]
    return w.select("user_id", "mood", "n_pairs", F.round("accuracy", 6).alias("accuracy"), F.array_join(F.transform("weights", lambda x: F.format_string("%.4f", x)), ",").alias("weights"))


def mood_weights(spark, d):
    """Weights of each user's moods and of all users' (-1), and how many held-out pairs they and the user's own order rightly."""
    w = _ensemble(spark, d)[0].moods
    return w.select("user_id", "mood", "n_pairs", "held_out", F.round("accuracy", 6).alias("accuracy"), F.round("user_accuracy", 6).alias("user_accuracy"), F.array_join(F.transform("weights", lambda x: F.format_string("%.4f", x)), ",").alias("weights"))


def _vectors(s: Star):
    return s.raw("embeddings").select(F.col("vec_id").cast("string").alias("song_id"), F.col("embedding").alias("vector"))


def mmr_topk(spark, d):
    r = _retriever(spark, d)
    scored = r.score(_unseen(spark, d)).join(r.songs.select("song_id", "genre_code"), "song_id", "left").select("user_id", "song_id", F.col("raw").alias("score"), F.coalesce("genre_code", F.lit(20)).alias("genre_code"))
    return V.mmr(scored, _vectors(r.star), depth=10).withColumn("score", F.round("score", 6))


def _arms(s: Star):
    return T.posteriors(s.feedback().select("user_id", "song_id", F.col("signal").cast("double").alias("reward")))


def thompson_topk(spark, d):
    return M.top_per_user(T.thompson(_arms(Star(spark, d))), 5, "theta").select("user_id", "rank", "song_id", F.round("theta", 6).alias("theta"))


def train(spark, d, history, mode: str = "light", **options):
    """A training run over the tables; see ``operators.training``."""
    from tessitura.operators import catalog as C
    from tessitura.operators import training

    s = Star(spark, d)
    songs = s.songs()
    return training.run(frame_of(spark, d), history, mode, songs=songs, audio=s.audio_features(), fresh=R.fresh(C.latest_snapshot(s.feed_songs()), 500), popular=R.popular(songs, 500), **options)


def features_of(spark, d, *, users: list[int] | None = None, mood: str = "", cached: DataFrame | None = None) -> DataFrame:
    """Candidates of all users, or of some, with all their scores."""
    return _features(spark, d, _ensemble(spark, d), users, mood, cached)[0]


def _features(spark, d, fitted, users, mood, cached) -> tuple[DataFrame, DataFrame]:
    """(candidates with all their scores, the rows of their songs)."""
    s, (own, _, pool) = Star(spark, d), fitted
    if users is not None:
        pool, cached = pool.where(F.col("user_id").isin(users)), cached if cached is None else cached.where(F.col("user_id").isin(users))
    songs = s.songs()
    heard = s.ledger().groupBy("song_id").agg(F.max("ts").alias("heard_at")).where((F.col("heard_at") >= F.expr(f"timestamp'{NIGHT}' - interval 7 day")))
    some = materialize(E.candidates(pool, _prefs(s), heard, V.recently_played(s.listens(), NIGHT), songs, cached=cached), "candidates")
    vecs = T.tfidf(songs)
    content = T.content_score(some.select("user_id", "song_id"), T.profiles(s.listens(), vecs), vecs)
    # stored, so its size is known: where the candidates' songs are few, their rows go to every task
    wanted = materialize(songs.join(some.select("song_id").distinct(), "song_id", "left_semi"), "candidate-songs")
    return E.features(own, some, _arms(s), content, wanted, NOW, mood=mood), wanted


def recommend(spark, d, *, users: list[int] | None = None, top_k: int = 10, slots: int | None = None, mood: str = "", cached: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(served rows, cache rows) of all users, or of some: pool, scores of all models, blend, re-ranking, rules, reasons."""
    s, fitted = Star(spark, d), _ensemble(spark, d)
    scored, wanted = _features(spark, d, fitted, users, mood, cached)
    weights = fitted[1]
    if mood:
        weights = weights.select("user_id", "mood", "weights").unionByName(fitted[0].moods.where(F.col("mood") == mood).select("user_id", "mood", "weights"))
    return E.serve(scored, weights, s.audio_features(), _vectors(s), wanted, _prefs(s), top_k=top_k, slots=slots, mood=mood)


def recommend_all(spark, d):
    """The whole serve for every user."""
    return recommend(spark, d)[0].withColumn("score", F.round("score", 6))


def rec_items(spark, d):
    """What a serve writes: its items, with the sub-scores."""
    sessions, items = E.written(recommend(spark, d, mood="gym")[0], NIGHT, "v1")
    return items.join(sessions.select("session_id", "user_id", "status"), "session_id").select("user_id", "song_id", "rank", F.round("final_score", 6).alias("final_score"), "svd_score", "ncf_score", "content_score", "bandit_score", "recency_score", "status")


def audio_features(spark, d):
    f = W.features(W.synthetic_clips(Star(spark, d).songs()))
    return f.select("song_id", F.round("bpm", 1).alias("bpm"), "musical_key", "mode", "key_alt", "energy", "danceability", "valence", "harmonic_clarity", "brightness", "voice_pct", "median_f0", "register", "lift")


def audio_composites(spark, d):
    """Energy, danceability, valence and clarity of measured values."""
    a = Star(spark, d).audio_features()
    raw = a.select("song_id", "bpm", "mode", "brightness", "key_strength", (F.col("energy") * 0.4).alias("rms"), F.col("lift").alias("tempo_strength"), F.array(*[F.abs(F.sin(F.col("bpm") * i + F.col("lift"))) / 4 for i in range(1, 13)]).alias("chroma"))
    return W.composites(raw).select("song_id", "energy", "danceability", "valence", "harmonic_clarity")


def bloom_slots(spark, d):
    from tessitura.operators.catalog import bloom_slots as slots

    return Star(spark, d).songs().select("song_id", slots(F.col("song_id")).alias("slots")).select("song_id", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"))


def bloom_dedup(spark, d):
    """Songs that a filter over the songs of every third id takes for new."""
    from tessitura.operators import catalog as C

    songs = Star(spark, d).songs().select("song_id")
    return C.bloom_unseen(songs, C.bloom_filter(songs.where("cast(song_id as int) % 3 = 0")))


def synthetic_songs(spark, d):
    """A generated population: ranks drawn by Zipf's law through the inverse of its cumulative weights."""
    n = 500
    w = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-1.2)).alias("w"))
    cum = w.withColumn("high", F.sum("w").over(Window.orderBy("rank"))).withColumn("low", F.col("high") - F.col("w"))
    total = w.agg(F.sum("w").alias("total"))
    draws = spark.range(0, 2000).select("id", I.unit(F.lit("zipf"), F.col("id").cast("string")).alias("u")).join(F.broadcast(total), F.lit(True)).withColumn("x", F.col("u") * F.col("total"))
    return draws.join(F.broadcast(cum), (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark, d):
    return G.read_events(spark, d)


def _drained(spark, stream, label, mode="complete"):
    return G.drain(stream, f"{label}_{uuid.uuid4().hex}", folder(spark, f"stream-{label}"), mode)


def stream_bandit(spark, d):
    return _drained(spark, G.running_posteriors(_stream(spark, d)), "bandit")


def stream_dislikes(spark, d):
    return _drained(spark, G.running_dislikes(_stream(spark, d)), "dislikes")


def stream_windows(spark, d):
    w = _drained(spark, G.windowed_plays(_stream(spark, d)), "windows")
    return w.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def stream_online_users(spark, d):
    out = _drained(spark, G.online_users(_stream(spark, d)), "online", "update")
    return out.groupBy("user_id").agg(F.max_by("norm", "n").alias("norm"), F.max("n").alias("n")).withColumn("norm", F.round("norm", 6))


QUERIES = {
    f.__name__: f
    for f in (
        als_topk, als_exact_topk, als_all_topk, max_product_topk, svd_biases, svd_topk, item2vec_nn, two_tower_topk, fm_topk, ncf_topk, sequence_markov, sequence_score, judged_pairs, blender_weights, mood_weights, mmr_topk, thompson_topk, recommend_all, rec_items,
        audio_features, audio_composites, bloom_slots, bloom_dedup, synthetic_songs, stream_bandit, stream_dislikes, stream_windows, stream_online_users,
    )
}

_V = ("listens", "feedback")
_POSTERIOR = "SELECT user_id, song_id, 1 + sum(greatest(signal, 0))::DOUBLE AS alpha, 1 + sum(greatest(-signal, 0))::DOUBLE AS beta, count(*) AS n_pulls FROM feedback GROUP BY 1, 2"
_SPLIT = """stamps AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM frame),
edge AS (SELECT timestamp AS edge_ts FROM stamps WHERE i = least(greatest(floor(0.85 * n), 1), n - 1)),
parted AS (SELECT *, CASE WHEN timestamp >= (SELECT edge_ts FROM edge) OR (plan_reward > 0 AND row_number() OVER (PARTITION BY user_id, plan_reward > 0 ORDER BY timestamp DESC, song_id DESC) <= 5) THEN 'valid' ELSE 'train' END AS part FROM frame)"""

_BLOOM = """hashed AS (SELECT song_id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(song_id, '.'), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM songs),
bloom AS (SELECT song_id, list_transform([2, 3, 5, 7, 11, 13, 17], lambda p: ((h * p::UHUGEINT + (p * p)::UHUGEINT) % 2000003::UHUGEINT)::INT) AS slots FROM hashed)"""

ORACLES = {
    "max_product_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS seed, b.vec_id, round(list_dot_product(a.v, b.v), 9) AS s FROM e a, e b WHERE a.vec_id % 20 = 0)
SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY s DESC, vec_id) AS rank, vec_id, round(s, 6) AS score FROM p QUALIFY rank <= 10""",
    "svd_biases": with_views(*_V, then=f"""{FRAME}, m AS (SELECT avg(plan_reward) AS m FROM frame), r AS (SELECT *, plan_reward - m AS rest FROM frame, m), bi AS (SELECT song_id, sum(rest) / (count(*) + 5) AS b FROM r GROUP BY 1), bu AS (SELECT user_id, sum(rest - b) / (count(*) + 5) AS b FROM r JOIN bi USING (song_id) GROUP BY 1)
SELECT 'user' AS kind, user_id::VARCHAR AS id, round(b, 6) AS bias FROM bu UNION ALL SELECT 'item', song_id, round(b, 6) FROM bi"""),
    "bloom_slots": with_views("songs", then=f"{_BLOOM}\nSELECT song_id, array_to_string(slots, ',') AS slots FROM bloom"),
    "bloom_dedup": with_views("songs", then=f"{_BLOOM}, bits AS (SELECT DISTINCT unnest(slots) AS slot FROM bloom WHERE song_id::INT % 3 = 0), each AS (SELECT song_id, unnest(slots) AS slot FROM bloom)\nSELECT DISTINCT song_id FROM each ANTI JOIN bits USING (slot)"),
    "synthetic_songs": """WITH w AS (SELECT r AS rank, pow(r, -1.2::DOUBLE) AS w FROM (SELECT unnest(range(1, 501)) AS r)), c AS (SELECT rank, w, sum(w) OVER (ORDER BY rank) AS high FROM w),
d AS (SELECT ((('0x' || substring(md5('zipf|' || i), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296) * (SELECT sum(w) FROM w) AS x FROM (SELECT unnest(range(0, 2000)) AS i))
SELECT rank, count(*) AS n FROM d JOIN c ON x >= high - w AND x < high GROUP BY 1""",
    "audio_composites": with_views("audio", then="""r AS (SELECT *, 1 - exp(-4 * energy * 0.4::DOUBLE) AS e, CASE WHEN bpm = 0 THEN 0.5 ELSE exp(-0.5::DOUBLE * pow((bpm - 120) / 40, 2)) END AS sweet, list_sort(list_transform(range(1, 13), lambda i: abs(sin(bpm * i + lift)) / 4), 'DESC') AS c FROM audio)
SELECT song_id, round(e, 3) AS energy, round(greatest(0, least(1, 0.5::DOUBLE * lift + 0.3::DOUBLE * e + 0.2::DOUBLE * sweet)), 3) AS danceability,
 round(greatest(0, least(1, 0.45::DOUBLE + CASE mode WHEN 'major' THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END + 0.25::DOUBLE * (brightness - 0.5) + 0.15::DOUBLE * (e - 0.5))), 3) AS valence, round(greatest(0, least(1, 0.5::DOUBLE * key_strength + 0.5::DOUBLE * (c[1] + c[2] + c[3]))), 3) AS harmonic_clarity FROM r"""),
    "sequence_markov": with_views(*_V, then=f"""{FRAME}, pos AS (SELECT * FROM frame WHERE plan_reward > 0), st AS (SELECT song_id AS src, lead(song_id) OVER (PARTITION BY user_id ORDER BY timestamp, song_id) AS dst FROM pos), c AS (SELECT src, dst, count(*) AS n FROM st WHERE dst IS NOT NULL GROUP BY 1, 2),
mk AS (SELECT src, dst, round(n / sum(n) OVER (PARTITION BY src), 9) AS p FROM c), l AS (SELECT user_id, song_id AS src FROM pos QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, song_id DESC) = 1)
SELECT user_id, dst AS song_id, round((0.6::DOUBLE * 0.5 + 0.4::DOUBLE * least(5 * p, 1)) * 2 - 1, 6) AS score FROM l JOIN mk USING (src)"""),
    "judged_pairs": with_views(*_V, then=f"""{FRAME}, {_SPLIT}, o AS (SELECT user_id, song_id AS neg FROM parted WHERE part = 'train' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp, song_id) = 1)
SELECT user_id, song_id AS pos, neg FROM parted JOIN o USING (user_id) WHERE part = 'valid' AND plan_reward > 0 AND song_id <> neg"""),
    "stream_bandit": with_views("feedback", then=_POSTERIOR),
    "stream_dislikes": with_views("feedback", then="SELECT user_id, count(*) FILTER (signal < 0) AS dislikes, count(*) FILTER (signal < 0) >= 5 AS disabled FROM feedback GROUP BY 1"),
    "stream_windows": "SELECT epoch(ts::DATE)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
