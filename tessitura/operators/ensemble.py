"""All scorers fitted on one frame, their scores of candidates side by side, and the serve built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.operators import content as T
from tessitura.operators import interactions as I
from tessitura.operators import models as M
from tessitura.operators import retrieval as R
from tessitura.operators import serving as V
from tessitura.sources.scratch import discard, materialize

PAIR = ["user_id", "song_id"]
FEATURES = list(S.BLEND)
RANK = 16
#: What a mood adds to recency.
MOOD_BOOST = {"gym": 0.1, "morning": 0.05}
#: The genres that a mood asks for.
MOOD_GENRES = {"morning": [6, 3, 9], "gym": [4, 2, 16], "4am": [0, 6, 18], "chill": [0, 6, 9], "sad": [6, 18, 5], "party": [3, 4, 12], "focus": [0, 10, 9]}
DEFAULT_SLOTS = 3
RETRIEVER_TABLES = ["frame", "fresh", "popular", "co", "knn"]


class Retriever:
    """Candidate sources fitted on a frame: co-occurrence, item neighbours, the newest feed, the most viewed songs."""

    def __init__(self, frame: DataFrame, fresh: DataFrame, popular: DataFrame):
        # stored, as several steps read each of them
        self.frame, self.fresh, self.popular = frame, fresh, popular
        self.co, self.knn = materialize(R.cooccurrence(frame), "cooccurrence"), materialize(R.item_knn(frame), "knn")

    @classmethod
    def restored(cls, tables: dict[str, DataFrame]) -> Retriever:
        """One whose parts have been stored: frame, fresh, popular, co, knn."""
        own = cls.__new__(cls)
        own.frame, own.fresh, own.popular, own.co, own.knn = (tables[t] for t in RETRIEVER_TABLES)
        return own

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in RETRIEVER_TABLES}

    def pool(self) -> DataFrame:
        co, knn = R.expand(self.frame, self.co, "weight"), R.expand(self.frame, self.knn, "sim")
        return R.pool(self.frame, [co, knn], [self.fresh, self.popular])

    def score(self, candidates: DataFrame) -> DataFrame:
        top = lambda f: f.where("pos <= 200")
        return R.retriever_score(candidates, self.frame, R.all_edges(self.co, self.knn), top(self.fresh), top(self.popular))


def _wide(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row an id, a vector column a model, null where the model doesn't know the id; stored."""
    stack = None
    for name, df in parts.items():
        one = df.select(key, F.lit(name).alias("m"), F.col("vector").cast("array<float>").alias("v"))
        stack = one if stack is None else stack.unionByName(one)
    return materialize(stack.groupBy(key).agg(*[F.first(F.when(F.col("m") == n, F.col("v")), ignorenulls=True).alias(f"{key[0]}_{n}") for n in parts]), f"vectors-{key}")


class Ensemble:
    """Every scorer fitted on a training frame. ``light`` leaves out side-feature factors, biased factors and the neural
    scorer, whose scores are then 0, as are those of a model that was given too few rows."""

    _of_valid: tuple[DataFrame, DataFrame] | None = None  # a validation part and its judged pairs

    def __init__(self, frame: DataFrame, songs: DataFrame, audio: DataFrame, retriever: Retriever, *, light: bool = False):
        self.frame, self.songs, self.retriever, self.light = frame, songs, retriever, light
        users, items = {}, {}
        triples = materialize(I.pairwise(frame, songs, per_positive=2), "triples")
        users["als"], items["als"] = M.als(frame, rank=RANK, iterations=5)
        users["two_tower"], items["two_tower"] = M.pairwise_factors(triples, size=RANK, epochs=3, unit=True)
        sequence = M.attention(frame, size=RANK)
        users["sequence"], items["sequence"] = M.session_vectors(frame, sequence), sequence[0]
        if not light:
            users["feature_mf"], items["feature_mf"] = M.pairwise_factors(triples, size=RANK, epochs=2, tokens=T.song_tokens(songs, audio))
            self.mean, users["svd"], items["svd"] = M.svd(frame, rank=RANK)
            users["ncf"], items["ncf"], self.weights = M.neural(frame, T.metadata_vector(songs))
        self.users, self.items = _wide(users, "user_id"), _wide(items, "song_id")
        self.next = materialize(M.next_songs(frame), "next-songs")

    def tables(self) -> dict[str, DataFrame]:
        """All that is fitted, to be stored; the rest is in ``values``."""
        return {"users": self.users, "items": self.items, "next": self.next, **self.retriever.tables()}

    def values(self) -> dict:
        return {"light": self.light} | ({} if self.light else {"mean": float(self.mean), "weights": [float(w) for w in self.weights]})

    @classmethod
    def restored(cls, tables: dict[str, DataFrame], values: dict, songs: DataFrame) -> Ensemble:
        """One that was stored as ``tables`` and ``values``, for the songs of now."""
        own = cls.__new__(cls)
        own.users, own.items, own.next, own.frame = (tables[t] for t in ("users", "items", "next", "frame"))
        own.songs, own.retriever, own.light = songs, Retriever.restored(tables), values["light"]
        if not own.light:
            own.mean, own.weights = values["mean"], np.array(values["weights"])
        return own

    def score(self, candidates: DataFrame) -> DataFrame:
        """(user, song, s_als, s_two_tower, s_sequence, s_retriever and, unless light, s_feature_mf, s_svd, s_ncf).

        Rows that are shuffled carry no vectors: pairs are joined first, then those with a song that a model knows meet
        one row a user and one a song. A song that none knows has the same scores whatever the vectors.
        """
        raw = candidates.select(*PAIR).distinct()
        ours = self.retriever.score(raw).select(*PAIR, F.col("score").alias("s_retriever"))
        # the retriever returns each pair once: pairs don't meet themselves again
        met = materialize(ours.where("user_id is not null and song_id is not null").join(self.next.withColumnRenamed("p", "__p"), PAIR, "left"), "met")
        names = self.items.select("song_id")
        songs = self.items if self.light else self.items.join(T.metadata_vector(self.songs.join(names, "song_id", "left_semi")).hint("merge"), "song_id", "left")
        j = met.join(names, "song_id", "left_semi").join(self.users.hint("merge"), "user_id", "left").join(materialize(songs, "known-songs"), "song_id")
        product = lambda n: F.coalesce(M.dot(f"u_{n}", f"s_{n}", RANK), F.lit(0.0))
        hashed = I.unit(F.lit("tower"), F.col("user_id").cast("string"), "song_id") * 0.5 - 0.25
        unknown = lambda user: F.when(user, hashed).otherwise(0.0)
        out = [
            product("als").alias("s_als"), F.coalesce(M.dot("u_two_tower", "s_two_tower", RANK), unknown(F.col("u_two_tower").isNotNull() & F.col("s_two_tower").isNull())).alias("s_two_tower"),
            M.sequence_score(F.col("u_sequence"), F.col("s_sequence"), F.col("__p"), RANK).alias("s_sequence"),
        ]
        # the scores of a song without vectors; of its user only whether they have one counts
        rest = met.join(names, "song_id", "left_anti").join(self.users.select("user_id", F.col("u_two_tower").isNotNull().alias("__known")), "user_id", "left")
        none = F.lit(None).cast("array<float>")
        plain = [F.lit(0.0).alias("s_als"), unknown(F.coalesce("__known", F.lit(False))).alias("s_two_tower"), M.sequence_score(none, none, F.col("__p"), RANK).alias("s_sequence")]
        if self.light:
            zeros = [F.lit(0.0).alias(f"s_{n}") for n in ("feature_mf", "svd", "ncf")]
            out, plain = out + zeros, plain + zeros
        else:
            out += [product("feature_mf").alias("s_feature_mf"), M.svd_score(self.mean, "u_svd", "s_svd", RANK).alias("s_svd"), M.neural_score(self.weights)("u_ncf", "s_ncf", "features").alias("s_ncf")]
            plain += [F.lit(0.0).alias("s_feature_mf"), F.lit(float(self.mean)).alias("s_svd"), F.lit(0.5).alias("s_ncf")]
        return j.select(*PAIR, *out, "s_retriever").unionByName(rest.select(*PAIR, *plain, "s_retriever"))

    def mixture(self, candidates: DataFrame) -> DataFrame:
        """The fixed mixture that rankings are evaluated by."""
        return self.score(candidates).select(*PAIR, S.weighted(S.EVAL_MIXTURE).alias("score"))

    def blender(self, valid: DataFrame, *, mood: str = "") -> DataFrame:
        """Weights for all users and for each with enough judged pairs; see ``models.blender``."""
        return M.blender(self._judged(valid), S.BLEND, mood=mood)

    def mood_blender(self, valid: DataFrame, weights: DataFrame) -> DataFrame:
        """Weights by mood around those of ``blender``: a judged pair belongs to every mood that asks for its liked song's genre."""
        moods = self.songs.sparkSession.createDataFrame([(m, g) for m, genres in MOOD_GENRES.items() for g in genres], "mood string, genre_code int")
        pairs = self._judged(valid)
        liked = self.songs.select(F.col("song_id").alias("pos"), "genre_code").join(pairs.select("pos").distinct(), "pos", "left_semi")
        of_song = materialize(liked.join(F.broadcast(moods), "genre_code").select("pos", "mood"), "liked-moods")
        return M.mood_blender(pairs.join(of_song, "pos"), weights, FEATURES)

    def _judged(self, valid: DataFrame) -> DataFrame:
        """Judged pairs (user_id, pos, neg) with the features of both sides (p_<f>, q_<f>); stored, and once for all blenders of a validation part."""
        if self._of_valid is None or self._of_valid[0] is not valid:
            pairs = materialize(judged(self.frame, valid), "judged-pairs")
            wanted = pairs.select("user_id", F.col("pos").alias("song_id")).union(pairs.select("user_id", "neg"))
            scores = materialize(self.score(wanted), "judged-scores")
            known = [c for c in FEATURES if f"s_{c}" in scores.columns]
            for side, to in (("p", "pos"), ("q", "neg")):
                # merged, as a table of all pairs must not pass through the driver
                pairs = pairs.join(scores.select("user_id", F.col("song_id").alias(to), *[F.col(f"s_{c}").alias(f"{side}_{c}") for c in known]).hint("merge"), ["user_id", to], "left")
            self._of_valid = valid, materialize(pairs, "judged-features")
            discard(scores)
        pairs = self._of_valid[1]
        return pairs.select("*", *[F.lit(0.0).alias(f"{side}_{c}") for side in "pq" for c in FEATURES if f"{side}_{c}" not in pairs.columns])


def judged(train: DataFrame, valid: DataFrame) -> DataFrame:
    """(user_id, pos, neg): each liked validation row with the user's first other training row."""
    liked = valid.where("plan_reward > 0").select("user_id", F.col("song_id").alias("pos"))
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("timestamp", "song_id"))
    other = train.withColumn("i", first).where("i = 1").select("user_id", F.col("song_id").alias("neg"))
    return liked.join(other, "user_id").where("pos <> neg")


def blended(scores: DataFrame, weights: DataFrame | None, mood: str = "") -> DataFrame:
    """Add ``blend`` in [-1, 1]: by the user's weights of the mood, else their own, else those of all (user -1), else the fixed ones.

    weights: (user_id, mood, weights in the order of FEATURES).
    """
    x = F.array(*[F.coalesce(F.col(f"s_{f}"), F.lit(0.0)) for f in FEATURES])
    w = F.array(*[F.lit(v) for v in S.BLEND.values()])
    if weights is not None:
        own = weights.where((F.col("mood") == mood) | (F.col("mood") == "")).groupBy("user_id").agg(F.max_by("weights", (F.col("mood") == mood).cast("int")).alias("__w"))
        everyone = own.where("user_id = -1").select(F.col("__w").alias("__all"))  # one row at most
        scores = scores.join(own.where("user_id <> -1"), "user_id", "left").join(F.broadcast(everyone), F.lit(True), "left")
        w = F.coalesce("__w", "__all", w)
    return scores.withColumn("blend", 2 * S.sigmoid(M.dot(x, w, len(FEATURES))) - 1).drop("__w", "__all")


def candidates(pool: DataFrame, prefs: DataFrame, heard: DataFrame, played: DataFrame, songs: DataFrame, *, cached: DataFrame | None = None, limit: int = 2000) -> DataFrame:
    """(user, song, fresh): the cached list and the pool, once each and up to the limit, in the catalog and not blocked,
    and up to 20 songs heard lately, marked fresh.

    pool: (user, song, place); cached: (user, song, rank).
    """
    rows = pool.select(*PAIR, F.lit(1).alias("source"), "place")
    if cached is not None:
        rows = cached.select(*PAIR, F.lit(0).alias("source"), F.col("rank").alias("place")).where("place <= 200").unionByName(rows)
    once = rows.groupBy(*PAIR).agg(F.min(F.struct("source", "place")).alias("x"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("x.source", "x.place", "song_id"))
    own = once.withColumn("r", place).where(F.col("r") <= limit).join(songs.select("song_id"), "song_id", "left_semi")
    own = V.without(own.select(*PAIR), V.blacklisted(prefs))
    return V.inject_heard(own, heard, played, songs)


def features(ensemble: Ensemble, pool: DataFrame, arms: DataFrame, content: DataFrame, songs: DataFrame, now: str, *, mood: str = "", draw: str = "0") -> DataFrame:
    """pool (user, song, fresh) with every score that the blend takes, what explains them, and the songs' columns.

    arms: posteriors (user, song, alpha, beta); a song without one is drawn from Beta(1, 1). content: (user, song, s_content).
    """
    drawn = T.thompson(arms, draw).select(*PAIR, "theta")
    t = ensemble.score(pool).join(pool, PAIR).join(drawn, PAIR, "left").join(content, PAIR, "left").join(songs, "song_id")
    theta = F.coalesce("theta", I.unit(F.lit("arm"), F.lit(draw), F.col("user_id").cast("string"), "song_id"))
    recency = S.clip(S.recency(F.col("last_seen"), now) + MOOD_BOOST.get(mood, 0.0), 0.0, 1.0)
    return t.withColumn("p_bandit", theta).withColumn("p_recency", recency).withColumn("s_content", F.coalesce("s_content", F.lit(0.0))).withColumn("s_bandit", F.col("p_bandit") * 2 - 1).withColumns({
        "s_recency": F.col("p_recency") * 2 - 1, "s_freshness": F.col("p_recency") * 2 - 1, "s_repeat_pen": F.lit(0.0),
    })


def music_bonus() -> Column:
    """Of measured songs by tempo, key and dance; of others by title and length."""
    measured = (F.coalesce("bpm", F.lit(0.0)) != 0) | (F.coalesce("key_strength", F.lit(0.0)) != 0)
    return F.when(measured, S.measured_bonus(F.col("bpm"), F.col("key_strength"), F.col("danceability"))).otherwise(S.title_bonus(F.col("title"), F.col("duration")))


def serve(scored: DataFrame, weights: DataFrame | None, audio: DataFrame, vectors: DataFrame | None, songs: DataFrame, prefs: DataFrame, *, top_k: int = 10, slots: int | None = None, mood: str = "") -> tuple[DataFrame, DataFrame]:
    """(top_k rows a user with reasons, the full list for the cache: user, song, score, rank up to 200).

    scored: of ``features``. Blend, music bonus and boost of fresh songs; re-ranking of all rows of a user, with a share
    by their exploration slots; block list, genre cap, anchor, cut.
    """
    measured = audio.select("song_id", "bpm", "key_strength", "danceability")
    bonus = materialize(songs.join(measured, "song_id", "left").select("song_id", music_bonus().alias("__bonus")), "bonus")
    t = blended(scored, weights, mood).join(bonus, "song_id").withColumn("score", V.final_score(F.col("blend"), F.col("__bonus"), F.col("fresh")))
    # titles come to the served rows alone
    t = materialize(t.select(*PAIR, "fresh", "score", "genre_code", "s_svd", "s_ncf", "s_content", "p_bandit", "p_recency"), "blended")
    own = S.exploration_slots(F.round(S.falsy(F.col("adventurous"), 0.3) * 10)) if slots is None else F.lit(slots)
    lam = prefs.select("user_id", V.mmr_lambda(own).alias("lam"))
    ranked = t.select(*PAIR, "score", "genre_code").join(lam, "user_id", "left").withColumn("lam", F.coalesce("lam", V.mmr_lambda(F.lit(DEFAULT_SLOTS))))
    diverse = materialize(V.mmr(ranked, vectors, depth=max(3 * top_k, top_k + 5), lam=F.col("lam")), "diverse")
    final = V.hard_rules(diverse, songs, prefs, top_k)
    why = t.select(*PAIR, "fresh", *[S.norm(F.col(f"s_{n}")).alias(f"s_{n}") for n in ("svd", "ncf", "content")], F.col("p_bandit").alias("s_bandit"), F.col("p_recency").alias("s_recency"))
    out = final.join(why, PAIR).join(songs.select("song_id", "title"), "song_id").withColumn("final_score", F.col("score"))
    out = out.select(*PAIR, "rank", "title", "fresh", "score", V.why().alias("why"), V.why_in_words(F.col("title")).alias("why_text"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "song_id"))
    return out, t.select(*PAIR, "score").withColumn("rank", place).where(F.col("rank") <= 200)


def written(served: DataFrame, at: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Rows of recommendation_sessions and rec_items for a served list: one session a user."""
    from tessitura.sources.schemas import conform

    session = F.sha1(F.concat_ws("|", F.col("user_id").cast("string"), F.lit(at), F.lit(version))).alias("session_id")
    sessions = served.select("user_id", session).distinct().select("session_id", "user_id", F.lit(at).cast("timestamp").alias("created_at"), F.lit(version).alias("model_version"), F.lit("ensemble").alias("algorithm"), F.lit("pending").alias("status"))
    part = lambda p: F.get_json_object("why", f"$.breakdown.{p}").cast("double").alias(f"{p}_score")
    items = served.select(session, "song_id", "rank", F.col("score").alias("final_score"), *[part(p) for p in V.PARTS], F.col("why").alias("why_top10"))
    return conform(sessions, "recommendation_sessions"), conform(items, "rec_items")
