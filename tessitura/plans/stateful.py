"""Tables that are changed in place: the catalog by buckets, and what the feedback stream leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import catalog as C
from tessitura.operators import models as M
from tessitura.plans import catalog as plans
from tessitura.plans.frames import frame_of
from tessitura.sources.scratch import folder, materialize
from tessitura.sources.star import Star, with_views
from tessitura.sources.store import Store
from tessitura.streaming import feedback as B
from tessitura.streaming import signals as G

RANK, RATE, REG = 8, 0.01, 0.02


def _store(spark) -> Store:
    return Store(spark, folder(spark, "store"))


def catalog_upsert_buckets(spark, d):
    """The upsert of ``catalog_upsert`` as changes of a stored catalog, a month at a time: the same rows, by buckets."""
    store, rules = _store(spark), {c: r for c, r in C.SONG_RULES.items() if c != "mood_tags"}
    old, new = plans.upserted(spark, d)
    c = store.change()
    c.replace("songs", old.select("song_id", *rules), ["song_id"])
    c.commit()
    new = materialize(new, "daily")
    for (month,) in sorted(new.select(F.month("last_seen")).distinct().collect()):  # twelve at most
        store.upsert("songs", new.where(F.month("last_seen") == month), ["song_id"], rules)
    return store.read("songs").select("song_id", "title", "view_count", "description", "first_seen", "last_seen", "times_fetched")


def _streamed(spark, d, *, factors: bool) -> Store:
    store = _store(spark)
    if factors:
        mean, users, songs = M.svd(frame_of(spark, d), rank=RANK)
        B.seed(store, mean, users, songs, size=RANK, rate=RATE, reg=REG)
    rows = G.signals(G.read_events(spark, d)).select(F.col("event_id").alias("id"), "user_id", "song_id", F.col("reward").cast("int").alias("signal"), F.col("ts").alias("created_at"))
    B.run(rows, store, folder(spark, "stream-feedback")).awaitTermination()
    return store


def stream_feedback(spark, d):
    """Arms and dislike counters after the stream of all signals, each taken once."""
    store = _streamed(spark, d, factors=False)
    n = store.read_appended("feedback").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_signals"))
    arms = B.posteriors(store).drop("last_pulled")
    return arms.join(B.dislikes(store).select("user_id", F.col("count").alias("dislikes"), "disabled"), "user_id", "left").join(n, "user_id").select(
        "user_id", "song_id", "alpha", "beta", "n_pulls", F.coalesce("dislikes", F.lit(0)).alias("dislikes"), F.coalesce("disabled", F.lit(False)).alias("disabled"), "n_signals"
    )


def stream_factors(spark, d):
    """Biased factors fitted on the frame and moved on by every signal of the stream."""
    store = _streamed(spark, d, factors=True)
    of = lambda table, key: store.read(table).select(F.lit(key).alias("kind"), F.col(key).cast("string").alias("id"), "n", F.round(F.element_at("vector", 1), 6).alias("bias"), F.round(F.sqrt(M.dot("vector", "vector", RANK + 1)), 6).alias("norm"))
    return of("user_factors", "user_id").unionByName(of("song_factors", "song_id"))


QUERIES = {f.__name__: f for f in (catalog_upsert_buckets, stream_feedback, stream_factors)}

ORACLES = {
    "catalog_upsert_buckets": plans.ORACLES["catalog_upsert"],
    "stream_feedback": with_views("feedback", then="""arms AS (SELECT user_id, song_id, 1 + sum(greatest(signal, 0))::DOUBLE AS alpha, 1 + sum(greatest(-signal, 0))::DOUBLE AS beta, count(*) AS n_pulls FROM feedback GROUP BY 1, 2),
u AS (SELECT user_id, count(*) FILTER (signal < 0) AS dislikes, count(*) FILTER (signal < 0) >= 5 AS disabled, count(*) AS n_signals FROM feedback GROUP BY 1)
SELECT user_id, song_id, alpha, beta, n_pulls, dislikes, disabled, n_signals FROM arms JOIN u USING (user_id)"""),
}
