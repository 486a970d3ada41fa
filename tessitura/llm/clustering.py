"""Lloyd's clustering of integer vectors with Yinyang bounds: few distances after the first round, the exact result.

Centroids are put in groups once, by a few rounds of the same clustering over the first centroids. A vector keeps an
upper bound of the distance to its centroid and, for each group, a lower bound of the distance to any other centroid of
it. When centroids move, the upper bound grows by its centroid's drift and a group's lower bound shrinks by the largest
drift in the group. Then, for each vector:

1. global filter: no group's lower bound is at or below the upper bound (once more with the exact distance): it stays;
2. group filter: groups whose lower bound is above the upper bound are left out;
3. centroid filter: of the others, a centroid whose own drift leaves the old bound above the best distance so far;
4. what survives is scanned exactly.

Distances are of integers and exact. Bounds are in doubles, loosened by more than their rounding, and only strict
inequality filters, so that ties go to the smaller number as if all had been scanned.

Vectors and bounds are a table stored once a round; a round is one pass over it, in which nothing is shuffled, and an
aggregate of the vectors that changed cluster (or of all, in the first), from which the driver has the sums of the
centroids. Centroids are all that travels: their number is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm._shared import arrow_limits, col, discard, materialize

#: Components from here on could make a squared distance pass 64 bits.
LARGEST = 1 << 27
#: Bounds are loosened by this share and this much.
SHARE, SLACK = 1e-9, 1e-3
#: Vectors a block within a task; a block's distances to all centroids are one matrix.
BLOCK = 4096


class Rounds(NamedTuple):
    vectors: DataFrame  # __id, cluster, distance (squared)
    centroids: np.ndarray  # k x dim, after the last update
    scanned: list[int]  # distances computed in each assignment
    possible: int  # vectors times centroids


def integer_vectors(vectors: DataFrame, dim: int, scale: float, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``__id, x``: rows whose vector has ``dim`` components, none null, infinite or not a number; x: floor(scale * component), as longs.

    Other rows are left out, null vectors too. A component of 2^27 or more in size is an error, as its squared
    distances need not fit 64 bits.
    """
    v = col(vector_col)
    sound = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    scaled = F.transform(v, lambda c: F.when(F.abs(s := F.floor(c.cast("double") * F.lit(float(scale)))) < LARGEST, s).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")).cast("long")))
    return vectors.where(sound).select(col(id_col).alias("__id"), scaled.alias("x"))


def first_centroids(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors with the smallest hex SHA-256 of ``prefix`` and the decimal id, in that order; all, if fewer.

    Of rows with one id those with the smaller vector come first; rows without an id come last.
    """
    key = F.sha2(F.concat(F.lit(prefix), F.col("__id").cast("string")), 256)
    rows = vectors.select("x", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["x"]) if rows else 0)


def grouped(centroids: np.ndarray, n_groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, 0 to at most n_groups - 1, none empty: Lloyd's rounds from evenly spaced ones."""
    k = len(centroids)
    c = centroids.astype(np.float64)
    heads = c[np.linspace(0, k - 1, min(n_groups, k)).astype(int)] if k else c
    group = np.zeros(k, np.int64)
    for _ in range(rounds if k else 0):
        group = np.argmin(((c[:, None] - heads[None]) ** 2).sum(2), 1)
        heads = np.array([c[group == g].mean(0) if (group == g).any() else h for g, h in enumerate(heads)])
    return np.unique(group, return_inverse=True)[1].astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x (n x dim) to all of c (k x dim), int64."""
    largest = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4.0 * x.shape[1] * float(largest) ** 2 < 2.0**52:  # then every sum is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to the same row of c."""
    return ((x - c) ** 2).sum(1)


def _least_by_group(d: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    return np.stack([d[:, group == g].min(1) for g in range(n_groups)], 1)


def scan_all(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance and lower bounds by group, from all distances."""
    d = squared(x, c)
    cluster = d.argmin(1)  # the first of equal ones
    best = d[np.arange(len(x)), cluster]
    root = np.sqrt(d.astype(np.float64))
    root[np.arange(len(x)), cluster] = np.inf
    return cluster, best, _least_by_group(root, group, group.max(initial=-1) + 1)


def filtered(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One assignment by the three filters: cluster, upper and lower bounds, distances computed."""
    n_groups = lower.shape[1]
    at_most = np.array([drift[group == g].max() for g in range(n_groups)])
    upper, before = upper + drift[cluster], lower
    lower = before - at_most[None]
    cluster, n = cluster.copy(), 0
    reach = lambda u: u * (1 + SHARE) + SLACK
    idle = lower.min(1) > reach(upper)
    live = np.flatnonzero(~idle)
    if len(live):
        upper[live] = np.sqrt(own(x[live], c[cluster[live]]).astype(np.float64))
        n += len(live)
        live = live[lower[live].min(1) <= reach(upper[live])]
    if not len(live):
        return cluster, upper, lower, n
    # best distances stay squared whole numbers, so that ties are seen
    v, was, old = x[live], cluster[live], before[live]
    best, best_c = own(v, c[was]), was.copy()
    # of each group, over all centroids but the one that the vector had: the least bound, whose it is (-1: not scanned), the next
    least, whose, second = lower[live].copy(), np.full((len(live), n_groups), -1), lower[live].copy()
    for g in range(n_groups):
        near = np.flatnonzero(lower[live, g] <= reach(np.sqrt(best.astype(np.float64))))
        if not len(near):
            continue
        one, arg, two = np.full(len(near), np.inf), np.full(len(near), -1), np.full(len(near), np.inf)
        for j in np.flatnonzero(group == g):
            bound = old[near, g] - drift[j]
            other = was[near] != j
            scan = other & (bound <= reach(np.sqrt(best[near].astype(np.float64))))
            value = np.where(other, bound, np.inf)  # what the filter leaves out is at least its bound away
            rows = near[scan]
            if len(rows):
                d = own(v[rows], c[j][None])
                n += len(rows)
                value[scan] = np.sqrt(d.astype(np.float64))
                better = (d < best[rows]) | ((d == best[rows]) & (j < best_c[rows]))
                best[rows[better]], best_c[rows[better]] = d[better], j
            two = np.minimum(two, np.maximum(one, value))
            arg = np.where(value < one, np.where(scan, j, -1), arg)
            one = np.minimum(one, value)
        least[near, g], whose[near, g], second[near, g] = one, arg, two
    bounds = np.where(whose == best_c[:, None], second, least)  # without the new centroid, and with the one that it had:
    moved = np.flatnonzero(best_c != was)
    at = group[was[moved]]
    bounds[moved, at] = np.minimum(bounds[moved, at], upper[live][moved])
    cluster[live], upper[live], lower[live] = best_c, np.sqrt(best.astype(np.float64)), bounds
    return cluster, upper, lower, n


_STATE = T.StructType([
    T.StructField("x", T.ArrayType(T.LongType(), False)), T.StructField("was", T.IntegerType()), T.StructField("cluster", T.IntegerType()),
    T.StructField("upper", T.DoubleType()), T.StructField("lower", T.ArrayType(T.DoubleType(), False)), T.StructField("scans", T.LongType()),
])


def _matrix(column: pa.ListArray, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def _list(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))


def _pass(assign: Callable, with_state: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = _matrix(batch.column("x"), np.int64)
                was = batch.column("cluster").to_numpy() if with_state else np.full(len(x), -1)
                held = (was.astype(np.int64), batch.column("upper").to_numpy(zero_copy_only=False).copy(), _matrix(batch.column("lower"), np.float64)) if with_state else ()
                cluster, upper, lower, scans = assign(x, *held)
                each = np.zeros(len(x), np.int64)
                each[0] = scans
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id"), _list(x), pa.array(was.astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(upper), _list(lower), pa.array(each)],
                    ["__id", "x", "was", "cluster", "upper", "lower", "scans"],
                )

    return run


def _moves(state: DataFrame, dim: int) -> dict[int, tuple[int, list[int]]]:
    """What clusters gain and lose by the vectors that changed: number and sums, a row a cluster."""
    x = F.col("x")
    ends = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))
    moved = state.where("cluster <> was").select("x", F.explode(ends).alias("e")).where("e.c >= 0")
    sums = moved.groupBy("e.c").agg(F.sum("e.s").alias("n"), *[F.sum(x[i] * F.col("e.s")).alias(f"s{i}") for i in range(dim)]).collect()
    return {r[0]: (r[1], [int(v) for v in r[2:]]) for r in sums}


def _exact(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column("cluster")
                d = own(_matrix(batch.column("x"), np.int64), centroids[cluster.to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column("__id"), cluster, pa.array(d)], ["__id", "cluster", "distance"])

    return run


def yinyang(vectors: DataFrame, centroids: np.ndarray, rounds: int, *, group_size: int = 10) -> Rounds:
    """Cluster ``__id, x`` (see ``integer_vectors``) from the centroids given.

    Each of ``rounds`` rounds assigns every vector to its nearest centroid (equal distances: the smaller number), then
    replaces each centroid that has vectors by their componentwise floor(sum / count); one without stays. Then vectors
    are assigned once more. Rows with one id, or none, are vectors like others. Without vectors there is nothing to
    return. group_size: centroids to a group, on average.
    """
    k, spark = len(centroids), vectors.sparkSession
    id_field = vectors.schema["__id"]
    schema = T.StructType([T.StructField("__id", id_field.dataType), *_STATE])
    if not k:
        return Rounds(vectors.limit(0).select("__id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).drop("x"), centroids, [], 0)
    dim, group = centroids.shape[1], grouped(centroids, max(1, round(k / group_size)))
    counts, sums = np.zeros(k, object), np.zeros((k, dim), object)
    c = centroids

    def first(x: np.ndarray) -> tuple:
        cluster, best, lower = scan_all(x, centroids, group)
        return cluster, np.sqrt(best.astype(np.float64)), lower, len(x) * k

    arrow_limits(spark, rows=BLOCK)
    state = materialize(vectors.mapInArrow(_pass(first, False), schema), "cluster-0")
    scanned = [_scans(state)]
    for i in range(rounds):
        for j, (n, s) in _moves(state, dim).items():
            counts[j] += n
            sums[j] += np.array(s, object)
        new = np.array([[int(v) // int(n) for v in s] if n else old.tolist() for s, n, old in zip(sums, counts, c)], np.int64)
        drift = np.sqrt(own(new, c).astype(np.float64)) * (1 + SHARE)
        after = materialize(state.select("__id", "x", "cluster", "upper", "lower").mapInArrow(_pass(lambda x, *held, new=new, drift=drift: filtered(x, *held, new, group, drift), True), schema), f"cluster-{i + 1}")
        discard(state)
        state, c = after, new
        scanned.append(_scans(state))
    placed = state.select("__id", "x", "cluster").mapInArrow(_exact(c), T.StructType([schema["__id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))
    return Rounds(placed, c, scanned, int(counts.sum()) * k)


def _scans(state: DataFrame) -> int:
    return state.agg(F.coalesce(F.sum("scans"), F.lit(0))).first()[0]


def summarised(done: Rounds) -> DataFrame:
    """``__id, cluster, distance``, then ``cluster_inertia`` and ``inertia`` (distance summed over the cluster and over all) and ``centroid_sha256`` (hex, of the components joined by commas).

    What is joined has a row a cluster.
    """
    held = done.vectors
    per = held.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    rows = [(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in per), ",".join(map(str, done.centroids[r["cluster"]].tolist()))) for r in per]
    by = held.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, text string").select("cluster", "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256"))
    return held.join(F.broadcast(by), "cluster")
