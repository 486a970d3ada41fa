"""Online steps of biased factors: every user and every song takes its signals of a batch one after another, exactly.

A signal moves a vector s = (bias, factors) by ``s += rate * ((t - s.z) z - reg * s)``, z the other side's (1, factors)
and t the reward without the mean and the other side's bias. Within a batch the other side is as the batch found it, so
a batch of one signal is the plain online step, both sides by the vectors before it.

Such a step is affine in s, and steps in a row are one affine map. So a batch is range-partitioned by (id, signal): an
id that lies in one partition is stepped there, all ids of an Arrow batch at once; one that is cut by a partition's ends,
as is one with a third of all signals, is folded in each into a map (a matrix of size + 1 columns), and its few maps are
applied one after another. Rows of a partition pass through once, and no id has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.operators.models import _lists, _rows

#: As often as the rate of the fit.
FASTER = 2.0


def stepped(s: np.ndarray, z: np.ndarray, t: np.ndarray, rate: float, reg: float) -> np.ndarray:
    """One signal for each row of s: n x (size + 1)."""
    e = t - (s * z).sum(1)
    return s + rate * (e[:, None] * z - reg * s)


def _fold(m: np.ndarray, z: np.ndarray, t: np.ndarray, rate: float, reg: float) -> np.ndarray:
    """The map [A | c] after the signals of z and t, in order."""
    for row, target in zip(z, t):
        e = -(row @ m)
        e[-1] += target
        m = m + rate * (np.outer(row, e) - reg * m)
    return m


def _runs(size: int, rate: float, reg: float):
    width = size + 1
    identity = np.hstack([np.eye(width), np.zeros((width, 1))])
    names = ["id", "part", "n", "vector", "map"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the last id: id, partition, number before, vector before, map, signals
        first = True  # whether that is the partition's first

        def rows(ids, part: int, n: np.ndarray, vectors: np.ndarray, maps: np.ndarray | None) -> pa.RecordBatch:
            none = pa.nulls(len(n), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(n), part, np.int32)), pa.array(n), _lists(vectors), none if maps is None else _lists(maps)], names)

        def closed(cut: bool) -> pa.RecordBatch:
            key, part, n, s, m, more = held
            ids = pa.array([key], id_type)
            if cut:
                return rows(ids, part, np.array([more]), s[None], m.reshape(1, -1))
            return rows(ids, part, np.array([n + more]), (m[:, :width] @ s + m[:, width])[None], None)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, id_type = batch.column("id"), batch.column("id").type
            plain = ids.to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(plain[1:] != plain[:-1]) + 1]
            ends = np.r_[starts[1:], len(plain)]
            own, z = _rows(batch.column("own")), np.hstack([np.ones((len(plain), 1)), _rows(batch.column("other"))[:, 1:]])
            t, n = batch.column("t").to_numpy(), batch.column("n").to_numpy()
            part = batch.column("part")[0].as_py()
            if held is not None and plain[0] == held[0]:
                held = (*held[:4], _fold(held[4], z[: ends[0]], t[: ends[0]], rate, reg), held[5] + int(ends[0]))
                starts, ends = starts[1:], ends[1:]
            if not len(starts):
                continue
            if held is not None:
                yield closed(first)
                first = False
            a = starts[:-1] if held is not None or not first else starts[:0]
            if held is None and len(starts) > 1:  # the partition's first id, which may go on from the one before
                k = slice(starts[0], ends[0])
                held = (plain[starts[0]], part, int(n[starts[0]]), own[starts[0]], _fold(identity, z[k], t[k], rate, reg), int(ends[0] - starts[0]))
                yield closed(True)
                first, a = False, starts[1:-1]
            if len(a):
                length, s = np.diff(np.r_[a, starts[-1]]), own[a].astype(float)
                for i in range(int(length.max())):
                    live = np.flatnonzero(length > i)
                    s[live] = stepped(s[live], z[a[live] + i], t[a[live] + i], rate, reg)
                yield rows(ids.take(pa.array(a)), part, n[a] + length, s, None)
            k = slice(starts[-1], ends[-1])
            held = (plain[starts[-1]], part, int(n[starts[-1]]), own[starts[-1]], _fold(identity, z[k], t[k], rate, reg), int(ends[-1] - starts[-1]))
        if held is not None:
            yield closed(True)

    return run


def _applied(width: int):
    """Maps of one id, by partition, on its vector; a row for each partition that has a part of it."""

    def run(batch: pa.Table) -> pa.Table:
        order = np.argsort(batch.column("part").to_numpy())
        maps = _rows(batch.column("map").combine_chunks()).reshape(-1, width, width + 1)
        s = _rows(batch.column("vector").combine_chunks())[order[0]]
        for i in order:
            s = maps[i][:, :width] @ s + maps[i][:, width]
        n = int(batch.column("n").to_numpy().sum()) + batch.column("before")[0].as_py()
        return pa.table({"id": batch.column("id").slice(0, 1), "vector": _lists(s[None]), "n": pa.array([n], pa.int64())})

    return run


def _side(j: DataFrame, key: str, own: str, other: str, n: str, target: Column, size: int, rate: float, reg: float, partitions: int | None) -> DataFrame:
    rows = j.select(F.col(key).alias("id"), "seq", F.col(own).alias("own"), F.col(other).alias("other"), target.alias("t"), F.col(n).alias("n"))
    id_type = rows.schema["id"].dataType
    dealt = (rows.repartitionByRange(partitions, "id", "seq") if partitions else rows.repartitionByRange("id", "seq")).sortWithinPartitions("id", "seq")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("id", id_type), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("vector", doubles), T.StructField("map", doubles)])
    from tessitura.sources.scratch import materialize

    done = materialize(dealt.mapInArrow(_runs(size, rate, reg), schema), f"online-{key}")  # stored: a second partitioning would cut elsewhere
    cut = done.where("map is not null").join(rows.groupBy("id").agg(F.max("n").alias("before")), "id")  # two ids a partition at most
    joined = cut.groupBy("id").applyInArrow(_applied(size + 1), T.StructType([T.StructField("id", id_type), T.StructField("vector", doubles), T.StructField("n", T.LongType())]))
    return done.where("map is null").select("id", "vector", "n").unionByName(joined).withColumnRenamed("id", key)


def online_step(signals: DataFrame, users: DataFrame, songs: DataFrame, mean: float, size: int, *, rate: float = 0.01, reg: float = 0.02, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(user_id, vector, n) and (song_id, vector, n) of the ids that have signals in the batch (user_id, song_id, seq, reward), which
    ``seq`` orders; n: signals so far.

    users, songs: (id, vector, n), size + 1 numbers with the bias first, read before they are changed. Unknown ids start
    at zero, so both sides grow. Rows without an id on either side, or without a reward, are left out. rate: of the fit;
    steps are twice as long.
    """
    zero = F.array(*[F.lit(0.0)] * (size + 1))
    of = lambda df, key, v, n: df.select(key, F.col("vector").cast("array<double>").alias(v), F.col("n").alias(n))
    j = signals.where("user_id is not null and song_id is not null and reward is not null").select("user_id", "song_id", "seq", F.col("reward").cast("double").alias("reward"))
    j = j.join(of(users, "user_id", "p", "n_p"), "user_id", "left").join(of(songs, "song_id", "q", "n_q"), "song_id", "left").select(
        "user_id", "song_id", "seq", "reward", F.coalesce("p", zero).alias("p"), F.coalesce("q", zero).alias("q"), F.coalesce("n_p", F.lit(0)).cast("long").alias("n_p"), F.coalesce("n_q", F.lit(0)).cast("long").alias("n_q")
    )
    rest = F.col("reward") - F.lit(float(mean))
    speed = rate * FASTER
    return (
        _side(j, "user_id", "p", "q", "n_p", rest - F.col("q")[0], size, speed, reg, partitions),
        _side(j, "song_id", "q", "p", "n_q", rest - F.col("p")[0], size, speed, reg, partitions),
    )
