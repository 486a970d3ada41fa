"""One stream of feedback, exactly once: rows, dislike counters, bandit arms and both factor tables, a commit a batch.

A micro-batch is one change of a ``Store``: what it adds to every table becomes visible with one log file, which also
holds the stream's name and the batch's number. Spark delivers a batch again after a crash; if its commit is there, it
is left out, and if not, what it had written is not part of any snapshot. So the tables are those of each signal taken
once, wherever the stream was killed.

Tables: ``feedback`` (rows as they came); ``dislike_counts`` (user_id, count, last_reset); ``bandit_arms`` (user_id,
song_id, gain, loss, n_pulls, last_pulled), sums that posteriors are read from; ``user_factors`` and ``song_factors``
(id, vector, n), moved by ``online.online_step``; ``settings`` of the factors (mean, size, rate, reg) are the store's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessitura.sources.schemas import conform
from tessitura.sources.scratch import discard, materialize
from tessitura.sources.store import BUCKETS, Change, Conflict, Store
from tessitura.streaming.online import online_step

LIMIT = 5
SIGNALS = ["id", "user_id", "song_id", "signal", "created_at"]
FACTORS = {"user_id": "user_factors", "song_id": "song_factors"}
_ARMS = {"gain": "sum", "loss": "sum", "n_pulls": "sum", "last_pulled": "max"}


def seed(store: Store, mean: float, users: DataFrame, songs: DataFrame, *, size: int, rate: float = 0.01, reg: float = 0.02, buckets: int = BUCKETS) -> int:
    """Put fitted factors (id, vector with the bias first) in the store, from where the stream moves them on."""
    c = store.change()
    for key, df in (("user_id", users), ("song_id", songs)):
        rows = df.where(F.col(key).isNotNull()).select(key, F.col("vector").cast("array<double>").alias("vector"), F.lit(0).cast("long").alias("n"))
        c.replace(FACTORS[key], materialize(rows, "seed"), [key], buckets=buckets)
    one = store.spark.createDataFrame([(1, float(mean), size, float(rate), float(reg))], "one int, mean double, size int, rate double, reg double")
    c.replace("settings", one, ["one"], buckets=1)
    return c.commit()


def take_in(c: Change, rows: DataFrame, version: str, *, buckets: int = BUCKETS) -> None:
    """Add a batch of signals (SIGNALS, and rec_session_id if there is one), stored, to a change. Signals without a user or
    song are kept in ``feedback`` and count nowhere else."""
    c.append("feedback", conform(rows.withColumn("model_version", F.lit(version)), "feedback"))
    known = rows.where("user_id is not null and song_id is not null and signal is not null")
    dislikes = known.where("signal < 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("count"), F.min("created_at").alias("last_reset")).withColumn("seq", F.lit(0))
    c.upsert("dislike_counts", materialize(dislikes, "dislikes"), ["user_id"], {"count": "sum", "last_reset": "old"}, buckets=buckets)
    s = F.col("signal").cast("double")
    arms = known.groupBy("user_id", "song_id").agg(
        F.sum(F.greatest(s, F.lit(0.0))).alias("gain"), F.sum(F.greatest(-s, F.lit(0.0))).alias("loss"), F.count(F.lit(1)).alias("n_pulls"), F.max("created_at").alias("last_pulled")
    ).withColumn("seq", F.lit(0))
    c.upsert("bandit_arms", materialize(arms, "arms"), ["user_id", "song_id"], _ARMS, buckets=buckets)
    if c.known("settings"):
        m = c.read("settings").first()
        moved = online_step(known.select("user_id", "song_id", F.col("id").alias("seq"), s.alias("reward")), *(c.read_for(t, known) for t in FACTORS.values()), m["mean"], m["size"], rate=m["rate"], reg=m["reg"])
        for (key, table), df in zip(FACTORS.items(), [materialize(df, "moved") for df in moved]):
            c.replace(table, df, [key], buckets=buckets)


def batch_writer(store: Store, stream: str, version: str, *, tries: int = 5, buckets: int = BUCKETS, before_commit: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch``. Another writer's commit in between makes it start its change anew, ``tries`` times.

    before_commit: called with the batch's number when all is written and nothing is visible yet; for tests.
    """

    def write(batch: DataFrame, number: int) -> None:
        if store.done(stream, number):
            return
        rows = materialize(batch.select(*SIGNALS, *[c for c in batch.columns if c == "rec_session_id"]), "signals")
        for left in range(tries - 1, -1, -1):
            c = store.change()
            take_in(c, rows, version, buckets=buckets)
            if before_commit:
                before_commit(number)
            try:
                c.commit(stream, number)
                break
            except Conflict:
                if store.done(stream, number):
                    break
                if not left:
                    raise
        discard(rows)

    return write


def run(signals: DataFrame, store: Store, checkpoint: str, *, stream: str = "feedback", version: str = "v0", **options) -> StreamingQuery:
    """Start the stream over all there is now; ``signals`` has the columns of SIGNALS. Start it again to go on."""
    return signals.writeStream.foreachBatch(batch_writer(store, stream, version, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def posteriors(store: Store, version: int | None = None) -> DataFrame:
    """(user_id, song_id, alpha, beta, n_pulls, last_pulled)."""
    a = store.read("bandit_arms", version)
    return a.select("user_id", "song_id", (1 + F.col("gain")).alias("alpha"), (1 + F.col("loss")).alias("beta"), "n_pulls", "last_pulled")


def dislikes(store: Store, version: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(user_id, count, last_reset, disabled): users that reach the limit get no recommendations."""
    return store.read("dislike_counts", version).withColumn("disabled", F.col("count") >= limit)
