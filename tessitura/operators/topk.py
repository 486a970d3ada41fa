"""Exact top-k of products of all users with all songs, leaving out blocks that can't hold any of them.

Songs are put in the order of their vectors' lengths, the longest first. A product is at most the two lengths
multiplied, so once a user's k-th best score is above their length times the longest of what is left, they are done. Songs
pass by in that order, a bounded number at a time (broadcast, and released again); users keep their k best so far as a
stored table, and only those who are not done are read again. Nothing is shuffled but the final rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.operators.models import _lists, _rows
from tessitura.operators.order import numbered
from tessitura.sources.scratch import discard, materialize

#: Songs of a pass, and of a block within it that is tested and multiplied as one.
PASS, BLOCK = 16_384, 1024
#: Scores are rounded to so many places, so that ties are ties whatever the shape of a product; bounds allow for it.
PLACES = 9


@dataclass
class Found:
    """rows: (user_id, rank, song_id, score); products computed, and users times songs."""

    rows: DataFrame
    computed: int
    all: int


def _merged(ids: np.ndarray, scores: np.ndarray, new_ids: np.ndarray, new_scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, ties by id."""
    if len(new_scores) > 4 * k:
        cut = np.partition(new_scores, -k)[-k]
        new_ids, new_scores = new_ids[new_scores >= cut], new_scores[new_scores >= cut]
    ids, scores = np.r_[ids, new_ids], np.r_[scores, new_scores]
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def _pass(shipped, k: int, rest: float, id_type: pa.DataType, places: int):
    """Users past one pass of songs; rest: the greatest length of the songs after it."""
    slack = 10.0 ** (1 - places)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shipped.value
        lengths = np.linalg.norm(matrix, axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("vector")).astype(float)
            length = np.linalg.norm(x, axis=1)
            held = [(np.array(i, object), np.array(s, float)) for i, s in zip(batch.column("ids").to_pylist(), batch.column("scores").to_pylist())]
            least = np.array([s[-1] if len(s) == k else -np.inf for _, s in held])
            computed = np.zeros(len(x), np.int64)
            for at in range(0, len(names), BLOCK):
                near = np.flatnonzero(length * lengths[at] >= least - slack)  # the block's first is its longest
                if not len(near):
                    continue
                products = np.round(x[near] @ matrix[at : at + BLOCK].T, places)
                computed[near] += products.shape[1]
                for r, row in zip(near.tolist(), products):
                    use = np.flatnonzero(row >= least[r])
                    if len(use):
                        held[r] = _merged(*held[r], names[at + use], row[use], k)
                        if len(held[r][1]) == k:
                            least[r] = held[r][1][-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("user_id"), _lists(x), pa.array([i.tolist() for i, _ in held], pa.list_(id_type)), pa.array([s.tolist() for _, s in held], pa.list_(pa.float64())), pa.array(length * rest >= least - slack), pa.array(computed)],
                ["user_id", "vector", "ids", "scores", "live", "computed"],
            )

    return run


def top_products(users: DataFrame, songs: DataFrame, k: int = 10, *, songs_a_pass: int = PASS, places: int = PLACES) -> Found:
    """The k songs with the greatest products for each user, of (user_id, vector) and (song_id, vector): all pairs are
    covered, by a product or by a bound. Ties go to the smaller id. Rows without an id or vector are left out; there are
    fewer than k rows a user only if there are fewer songs.
    """
    spark = users.sparkSession
    sound = lambda df, key: df.where(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(key, F.col("vector").cast("array<double>").alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    ordered = materialize(numbered(sound(songs, "song_id").withColumn("length", F.sqrt(square)), [F.desc("length"), "song_id"]).select("i", "song_id", "vector", "length"), "topk-songs")
    n_songs = ordered.count()
    id_type = pa.string() if isinstance(ordered.schema["song_id"].dataType, T.StringType) else pa.int64()
    names = ordered.schema["song_id"].dataType
    users = sound(users, "user_id")
    schema = T.StructType([
        users.schema["user_id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("ids", T.ArrayType(names)), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("live", T.BooleanType()), T.StructField("computed", T.LongType()),
    ])
    live = users.select("user_id", "vector", F.array().cast(T.ArrayType(names)).alias("ids"), F.array().cast("array<double>").alias("scores"))
    done, computed, n_users, step = [], 0, None, None
    for at in range(0, max(n_songs, 1), songs_a_pass):
        own = ordered.where(F.col("i").between(at, at + songs_a_pass - 1)).orderBy("i").collect()  # songs_a_pass
        after = ordered.where(F.col("i") == at + songs_a_pass).select("length").first()
        matrix = np.array([r["vector"] for r in own], float) if own else np.zeros((0, 0))
        shipped = spark.sparkContext.broadcast((np.array([r["song_id"] for r in own], object), matrix))
        before, step = step, materialize(live.mapInArrow(_pass(shipped, k, after["length"] if after else -1.0, id_type, places), schema), "topk-users")
        shipped.destroy()
        n, pairs = step.agg(F.count(F.lit(1)), F.coalesce(F.sum("computed"), F.lit(0))).first()
        n_users = n if n_users is None else n_users
        computed += pairs
        # of the pass before only those who were done are read again, and they are copied out
        done.append(materialize(step.where(~F.col("live") if after else F.lit(True)).select("user_id", "ids", "scores"), "topk-done"))
        live = step.where("live").select("user_id", "vector", "ids", "scores")
        if before is not None:
            discard(before)
        if not after or live.isEmpty():
            break
    if step is not None:
        discard(step)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    out = rows.select("user_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "x")).select("user_id", (F.col("rank") + 1).alias("rank"), F.col("x.ids").alias("song_id"), F.col("x.scores").alias("score"))
    return Found(out, computed, n_users * n_songs)


def top_without(users: DataFrame, songs: DataFrame, without: DataFrame, k: int, most: int, *, places: int = PLACES) -> DataFrame:
    """(user_id, rank, song_id, score): the k songs with the greatest products for each user but the user's own in
    ``without`` (user_id, song_id). Those are ``most`` a user or fewer, so what is wanted is among the k + most greatest.
    """
    rows = top_products(users, songs, k + most, places=places).rows.withColumn("score", F.col("score") + 0.0)  # no zeros below zero
    rest = rows.drop("rank").join(without.select("user_id", "song_id"), ["user_id", "song_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "song_id"))
    return rest.withColumn("rank", rank).where(F.col("rank") <= k).select("user_id", "rank", "song_id", "score")
