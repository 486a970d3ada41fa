"""Training runs: split, fit, evaluate, promote; their history is append-only and the registry a view of it."""

from __future__ import annotations

import functools
import json
import os
import resource
import subprocess
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.operators import catalog as C
from tessitura.operators import ensemble as E
from tessitura.operators import interactions as I
from tessitura.operators import models as M
from tessitura.operators import retrieval as R
from tessitura.sources import files
from tessitura.sources.scratch import materialize

HISTORY = "id long, key string, run_id string, model_version string, ndcg10 double, coverage double, updated_at timestamp"
STALE_LOCK_HOURS = 4


CONFIG = {"rank": E.RANK, "history": R.HISTORY, "reach": R.REACH, "seen": M.SEEN, "context": M.CONTEXT, "alpha": S.ALPHA, "half_life_days": S.INTERACTION_HALFLIFE_DAYS}
#: Rows of a smoke run: a check of the wiring.
SMOKE = (1500, 300)


def commit_id() -> str:
    """The short id of the code's commit, if git can tell."""
    try:
        done = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, cwd=os.path.dirname(__file__))
        return done.stdout.strip() or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def peak_memory_mb() -> float:
    """Of this process."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def run(frame: DataFrame, history: DataFrame, mode: str = "light", *, songs: DataFrame, audio: DataFrame, fresh: DataFrame, popular: DataFrame, distractors: int = 100, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One run over a frame: (report, rows to append to the history).

    light: factors, towers, attention and retrievers; deep: all scorers and the blender; smoke: light, on a few rows.
    Rankings are by the fixed mixture. Candidates of a user are their validation songs and some others of the
    validation set, the first by hash. The result always goes to staging, and to prod if it beats prod; a smoke run
    registers nothing. The report is the run's manifest too: code, settings, frame and peak memory of the driver.
    """
    if mode not in ("light", "deep", "smoke"):
        raise ValueError(f"unknown mode {mode}")
    spark, began = frame.sparkSession, time.time()
    parted = materialize(I.split(frame), "train-split")
    train, valid = parted.where("part = 'train'").drop("part"), parted.where("part = 'valid'").drop("part")
    if mode == "smoke":
        first = lambda df, n: materialize(df.orderBy(F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "song_id"))).limit(n), "smoke")
        train, valid = first(train, SMOKE[0]), first(valid, SMOKE[1])
    fitted = E.Ensemble(train, songs, audio, E.Retriever(train, fresh, popular), light=mode != "deep")
    pool = valid.select("song_id").distinct().orderBy(F.md5("song_id"), "song_id").limit(distractors)
    users = valid.where("plan_reward > 0").select("user_id").distinct()
    candidates = valid.select("user_id", "song_id").union(users.join(F.broadcast(pool), F.lit(True))).distinct().join(users, "user_id", "left_semi")
    ranked = materialize(M.top_per_user(fitted.mixture(candidates), 10), "train-ranked")
    loss = M.als_loss(train, fitted.users.select("user_id", F.col("u_als").alias("vector")).where("vector is not null"), fitted.items.select("song_id", F.col("s_als").alias("vector")).where("vector is not null"), 0.08).first()["loss"]
    accuracy = fitted.blender(valid).where("user_id = -1").first()["accuracy"] if mode == "deep" else None
    h = I.hits(ranked, valid).agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("hitrate").alias("hitrate"), F.count(F.lit(1)).alias("users"))
    report = h.join(I.catalog_metrics(ranked, valid), F.lit(True))
    row = report.first()
    prod = C.registry(history).where("key = 'prod'").select("ndcg10", "coverage").first()
    better = spark.range(1).select(I.should_promote(F.lit(row["ndcg"]), F.lit(row["coverage"]), F.lit(prod["ndcg10"] if prod else None).cast("double"), F.lit(prod["coverage"] if prod else None).cast("double"))).first()[0]
    run_id = uuid.uuid4().hex[:12]
    keys = [] if mode == "smoke" else ["staging"] + ["prod"] * bool(better)
    last = history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    new = spark.createDataFrame([(last + 1 + i, k, run_id, mode, row["ndcg"], row["coverage"], None) for i, k in enumerate(keys)], HISTORY).withColumn("updated_at", at)
    summary = report.withColumn("run_id", F.lit(run_id)).withColumn("mode", F.lit(mode)).withColumn("promoted", F.lit(bool(better) and mode != "smoke")).withColumn("secs", F.lit(round(time.time() - began, 2)))
    manifest = {"commit_id": commit_id(), "config": json.dumps(CONFIG), "peak_memory_mb": round(peak_memory_mb(), 1), "loss": M.UNFITTED if loss is None else float(loss), "blender_accuracy": accuracy}
    for name, value in manifest.items():
        summary = summary.withColumn(name, F.lit(value).cast("double" if name in ("peak_memory_mb", "loss", "blender_accuracy") else "string"))
    return summary.join(I.fingerprint(train), F.lit(True)), new


def missing_files(spark: SparkSession, artifacts: DataFrame, run_id: str) -> list[str]:
    """Paths of a run's models (a few) that are no longer there: what to know before it becomes current again."""
    paths = [r["model_path"] for r in artifacts.where(F.col("run_id") == run_id).select("model_path").collect()]
    of = spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if not of(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(of(p))]


def acquire_lock(spark: SparkSession, path: str) -> bool:
    """Create the lock file, or take over one that is stale; False while another run holds it. Of any number that ask at
    once, one gets it.

    A stale lock goes under a second file, which one run creates and which says who may look again and delete it.
    """
    if files.create(spark, path, ""):
        return True
    stale = lambda p: (at := files.modified(spark, p)) is not None and lock_is_stale((time.time() - at) / 3600)
    taking = f"{path}.takeover"
    if not stale(path):
        return False
    if not files.create(spark, taking, ""):
        if stale(taking):  # of a run that died while it took over: the next one may
            files.delete(spark, taking)
        return False
    try:
        if stale(path):
            files.delete(spark, path)
        return files.create(spark, path, "")
    finally:
        files.delete(spark, taking)


def release_lock(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)


def roll_back(history: DataFrame, key: str = "prod") -> DataFrame:
    """The row to append so that the newest other run is current again; empty if there is none."""
    last = history.agg(F.max("id").alias("__last"))
    return C.rollback(history, key).join(F.broadcast(last), F.lit(True)).withColumn("id", F.col("__last") + 1).drop("__last")


def lock_is_stale(age_hours: float) -> bool:
    return age_hours >= STALE_LOCK_HOURS


def due_weekly(days_since: float) -> bool:
    """Weekly models train when the last run is over seven days old."""
    return days_since > 7


def job(log: list[dict], name: str | None = None) -> Callable:
    """Decorator: append each call's job, start, seconds, ok and note to a log, and let its error through."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def inner(*args: Any, **kwargs: Any) -> Any:
            began, row = time.time(), {"job": name or f.__name__, "ok": 0, "note": ""}
            try:
                out = f(*args, **kwargs)
                row["ok"] = 1
                return out
            except Exception as e:
                row["note"] = f"{type(e).__name__}: {e}"[:200]
                raise
            finally:
                log.append(row | {"started_at": began, "secs": round(time.time() - began, 3)})

        return inner

    return wrap


def cache_top(ranked: DataFrame, path: str, at: str, n: int = 200) -> None:
    """Write each user's first n as the serving cache."""
    ranked.where(F.col("rank") <= n).withColumn("cached_at", F.lit(at).cast("timestamp")).write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str, now: str, max_age_hours: int = 26) -> DataFrame:
    """The cache, without rows older than it may be."""
    return spark.read.parquet(path).where(F.col("cached_at") >= F.expr(f"timestamp'{now}' - interval {max_age_hours} hour"))


GENRES = 20
#: Rewards of a generated listen, and how often each falls to songs of a preferred genre and to others.
OUTCOMES = [("like", 1.0, 0.35, 0.10), ("full", 0.8, 0.40, 0.20), ("partial", 0.2, 0.20, 0.35), ("dislike", -1.0, 0.05, 0.35)]


def synthetic_catalog(spark: SparkSession, songs: int, seed: str = "synthetic") -> DataFrame:
    """A generated catalog, from hashes: song n has genre n mod GENRES, log-normal views (12, 2) of at least 1,000, and
    likes of 1 to 15% of them."""
    u = lambda k: I.unit(F.lit(seed), F.lit(k), F.col("id").cast("string"))
    normal = F.sqrt(-2 * F.log(u("views"))) * F.cos(u("angle") * 6.283185307179586)
    views = F.greatest(F.floor(F.exp(12 + 2 * normal)), F.lit(1000)).cast("long")
    genre = (F.col("id") % GENRES).cast("int")
    return spark.range(songs).select(
        F.col("id").cast("string").alias("song_id"), F.concat(F.lit("Synthetic Track "), F.col("id").cast("string")).alias("title"), F.concat(F.lit("Artist_"), F.floor(u("artist") * 500).cast("string")).alias("channel"),
        F.floor(90 + u("duration") * 390).cast("int").alias("duration"), views.alias("view_count"), F.floor(views * (0.01 + 0.14 * u("likes"))).cast("long").alias("like_count"), genre.alias("genre_code"), F.lit(0).alias("language_code"),
        F.round(u("energy"), 3).alias("energy_score"), F.floor(1 + u("fetched") * 10).cast("int").alias("times_fetched"),
    )


def synthetic_interactions(spark: SparkSession, users: int, songs: int, per_user: int, seed: str = "synthetic") -> DataFrame:
    """(user_id, song_id, reward) of a generated population: each user prefers three genres, which take 70% of the picks,
    evenly; the others follow Zipf's law (1.2) over all songs, by the inverse of the continuous law. Rewards by OUTCOMES.

    From hashes: the same whatever the partitioning. A song picked twice counts once.
    """
    u = lambda k: I.unit(F.lit(seed), F.lit(k), F.col("user_id").cast("string"), F.col("n").cast("string"))
    d = spark.range(users).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(1), F.lit(per_user))).alias("n"))
    high = 1 - float(songs) ** -0.2
    zipf = F.least(F.floor(F.pow(1 - u("r") * high, F.lit(-5.0))), F.lit(songs)).cast("long") - 1
    start = F.pmod(F.xxhash64("user_id", F.lit(seed)), F.lit(GENRES))
    favourite = F.pmod(start + F.floor(u("which") * 3) * 7, F.lit(GENRES))  # of start, start + 7, start + 14
    in_genre = F.least(favourite + GENRES * F.floor(u("song") * F.ceil(F.lit(songs) / GENRES)), F.lit(songs - 1)).cast("long")
    picked = d.withColumn("pick", F.when(u("g") < 0.7, in_genre).otherwise(zipf)).withColumn("liked", F.pmod(F.col("pick") - start, F.lit(GENRES)).isin(0, 7, 14)).withColumn("o", u("o"))
    reward, upto = F.lit(OUTCOMES[-1][1]), [0.0, 0.0]
    cases = []
    for _, value, own, other in OUTCOMES[:-1]:
        upto = [upto[0] + own, upto[1] + other]
        cases.append((F.col("o") < F.when(F.col("liked"), upto[0]).otherwise(upto[1]), value))
    for condition, value in cases[::-1]:
        reward = F.when(condition, value).otherwise(reward)
    return picked.withColumn("reward", reward).groupBy("user_id", F.col("pick").cast("string").alias("song_id")).agg(F.min_by("reward", "n").alias("reward"))
