"""Structured Streaming over listening signals: posteriors, dislike counters, windows, sessions, online factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.sources import files

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Stream event files of a folder; ts becomes a timestamp with zone, as watermarks need."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events*.parquet").parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("song_id", F.get_json_object("props", "$.k"))


def signals(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("purchase", "error")).withColumn("reward", F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0))


def running_posteriors(events: DataFrame) -> DataFrame:
    """Beta posterior of each arm so far; update or complete mode."""
    r = F.col("reward")
    return signals(events).groupBy("user_id", "song_id").agg((1 + F.sum(F.greatest(r, F.lit(0.0)))).alias("alpha"), (1 + F.sum(F.greatest(-r, F.lit(0.0)))).alias("beta"), F.count(F.lit(1)).alias("n_pulls"))


def running_dislikes(events: DataFrame, limit: int = 5) -> DataFrame:
    """Dislikes by user so far, and whether they switch recommendations off."""
    n = signals(events).groupBy("user_id").agg(F.sum(F.when(F.col("reward") < 0, 1).otherwise(0)).alias("dislikes"))
    return n.withColumn("disabled", F.col("dislikes") >= limit)


def windowed_plays(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by type and window; append mode closes a window once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def refreshed_terms(titles: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """New titles against a frozen vocabulary (term, idf): a stream-static join, no state."""
    from tessitura.functions.scalars import words

    w = titles.select("song_id", words(F.col("title")).alias("w")).select("song_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return w.join(vocabulary, "term").select("song_id", "term", (F.col("idf") / F.col("len")).alias("weight"))


def online_users(events: DataFrame, items: dict[str, np.ndarray] | None = None, size: int = 8, rate: float = 0.05, reg: float = 0.02) -> DataFrame:
    """User vectors and biases that follow each signal: one gradient step towards or from the song's vector, kept as
    state by user; a new user starts at zero.

    items: vectors of the songs served online; any other song has the hashed vector of its id, so no signal is lost.
    """
    from tessitura.operators.models import hashed_vectors

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        v, n, bias = (np.array(state.get[0]), state.get[1], state.get[2]) if state.exists else (np.zeros(size), 0, 0.0)
        for pdf in batches:
            pdf = pdf.sort_values("event_id")
            vectors = hashed_vectors([f"song:{s}" for s in pdf["song_id"]], size) if len(pdf) else []
            for song, r, y in zip(pdf["song_id"], pdf["reward"], vectors):
                y = y if items is None or song not in items else items[song]
                e = r - bias - float(v @ y)
                bias += rate * (e - reg * bias)
                v = v + rate * (e * y - reg * v)
                n += 1
        state.update((v.tolist(), n, bias))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "norm": [float(np.linalg.norm(v))], "bias": [bias]})

    s = signals(events).select("user_id", "event_id", "song_id", "reward")
    return s.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, norm double, bias double", "v array<double>, n long, bias double", "update", "NoTimeout")


def online_factors(events: DataFrame, users: DataFrame, songs: DataFrame, mean: float, *, rate: float = 0.01, reg: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """One step of both sides on a batch of signals (user_id, song_id, reward): new (user_id, vector), (song_id, vector).

    Vectors hold the bias first. Ids that are not known yet start at zero, so both tables grow; ids without a signal
    stay. Every signal is judged by the factors before the batch, and an id moves by the sum of its steps, which
    combine before they are shuffled. For ``foreachBatch``: the two results become the tables of the next batch.
    """
    from tessitura.operators.models import dot

    size = len(users.first()["vector"])
    zero = F.array(*[F.lit(0.0)] * size)
    vector = lambda c: F.coalesce(F.col(c), zero)
    j = events.join(users.withColumnRenamed("vector", "p"), "user_id", "left").join(songs.withColumnRenamed("vector", "q"), "song_id", "left").select("user_id", "song_id", "reward", vector("p").alias("p"), vector("q").alias("q"))
    rest = lambda c: F.slice(c, 2, size - 1)
    j = j.withColumn("e", F.col("reward") - (mean + F.col("p")[0] + F.col("q")[0] + (dot(rest("p"), rest("q"), size - 1) if size > 1 else F.lit(0.0))))

    def moved(old: DataFrame, key: str, own: str, other: str) -> DataFrame:
        step = [F.col("e") - reg * F.col(own)[0]] + [F.col("e") * F.col(other)[i] - reg * F.col(own)[i] for i in range(1, size)]
        sums = j.groupBy(key).agg(F.array(*[F.sum(s) for s in step]).alias("step"))
        both = old.join(sums, key, "full_outer")
        return both.select(key, F.zip_with(vector("vector"), F.coalesce("step", zero), lambda v, s: v + 2 * rate * s).alias("vector"))

    return moved(users, "user_id", "p", "q"), moved(songs, "song_id", "q", "p")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all there is now, into Parquet beside its checkpoint, and return what it says.

    A batch overwrites its own folder, so one that is delivered again changes nothing. complete: the last batch, which is
    the whole result; else the rows of all batches.
    """
    spark, rows = stream.sparkSession, f"{checkpoint.rstrip('/')}-rows"
    q = stream.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{rows}/{number:012d}")).start().awaitTermination()
    found = files.names(spark, rows)
    return spark.read.schema(stream.schema).parquet(*[f"{rows}/{n}" for n in (found[-1:] if mode == "complete" else found)]) if found else spark.createDataFrame([], stream.schema)
