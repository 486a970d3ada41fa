"""Yinyang rounds against scans of everything: the same clusters, ties and centroids, from fewer distances."""

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tessitura.llm import clustering as C

BIG = "vec_id long, embedding array<float>, cluster string, x int, __id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "mine", 7, 8) for i, v in rows], BIG)


def brute(x, c, rounds):
    """Clusters, distances and centroids by all distances, in Python's whole numbers."""
    x, c = [list(map(int, v)) for v in x], [list(map(int, v)) for v in c]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        for j in range(len(c)):
            if mine := [v for v, o in zip(x, own) if o == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [near(v)[1] for v in x], [near(v)[0] for v in x], c


def shapes():
    r = np.random.default_rng(3)
    blobs = r.integers(-300, 300, (12, 6))[r.integers(0, 12, 700)] + r.integers(-25, 26, (700, 6))
    grid = r.integers(0, 3, (400, 6))  # ties everywhere
    return {"blobs": blobs, "grid": grid, "copies": np.repeat(blobs[:5], 60, 0), "negative": -np.abs(blobs[:200]), "large": blobs[:150] * 300_000, "line": np.arange(300)[:, None] * np.ones((1, 6), int)}


@pytest.mark.parametrize("name", shapes())
@pytest.mark.parametrize("k,size", [(17, 5), (40, 10), (3, 10)])
def test_as_brute_force(spark, name, k, size):
    x = shapes()[name]
    vectors = C.integer_vectors(frame(spark, [(i, v / 4) for i, v in enumerate(x)]), 6, 4.0)
    starts = C.first_centroids(vectors, k, "2:")
    order = sorted(range(len(x)), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:k]
    assert starts.tolist() == x[order].tolist()
    done = C.yinyang(vectors, starts, 4, group_size=size)
    cluster, distance, centroids = brute(x, starts, 4)
    got = {r["__id"]: (r["cluster"], r["distance"]) for r in done.vectors.collect()}
    assert got == {i: (a, b) for i, (a, b) in enumerate(zip(cluster, distance))} and done.centroids.tolist() == centroids
    assert done.possible == len(x) * len(starts) and done.scanned[0] == done.possible


def test_filters_leave_most_distances_out(spark):
    r = np.random.default_rng(8)
    x = r.integers(-2000, 2000, (40, 16))[r.integers(0, 40, 4000)] + r.integers(-40, 41, (4000, 16))
    vectors = C.integer_vectors(frame(spark, list(enumerate(x))), 16, 1.0)
    done = C.yinyang(vectors, C.first_centroids(vectors, 40, "2:"), 5)
    assert sum(done.scanned[1:]) < 0.15 * done.possible * 5


def test_bounds_hold(spark):
    """After every round, for every vector: the upper bound is no less and each group's lower bound no more than the true distance."""
    r = np.random.default_rng(1)
    x, c = r.integers(-50, 50, (500, 4)), r.integers(-50, 50, (12, 4))
    group = C.grouped(c, 3)
    cluster, best, lower = C.scan_all(x, c, group)
    upper = np.sqrt(best.astype(float))
    for _ in range(12):
        new = c + r.integers(-6, 7, c.shape)
        cluster, upper, lower, _ = C.filtered(x, cluster, upper, lower, new, group, np.sqrt(C.own(new, c).astype(float)))
        c = new
        d = C.squared(x, c)
        assert (cluster == d.argmin(1)).all()
        root = np.sqrt(d.astype(float))
        assert (upper >= root[np.arange(len(x)), cluster] - 1e-6).all()
        root[np.arange(len(x)), cluster] = np.inf
        for g in range(lower.shape[1]):
            assert (lower[:, g] <= root[:, group == g].min(1) + 1e-6).all()


def test_groups():
    c = np.array([[0, 0], [100, 0], [1, 0], [101, 1], [2, 1]])
    g = C.grouped(c, 2)
    assert g[0] == g[2] == g[4] != g[1] == g[3]
    assert C.grouped(c, 9).max() == 4 and C.grouped(c[:0], 3).tolist() == []
    assert C.grouped(np.zeros((4, 2), int), 3).tolist() == [0, 0, 0, 0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 2]), (1, [1, 2]), (None, [5, 5]), (2, None), (3, [1]), (4, [1, 2, 3]), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, []), (9, [-0.5, 0.25])]
    vectors = C.integer_vectors(frame(spark, rows), 2, 2.0)
    assert sorted((r["__id"] or 0, *r["x"]) for r in vectors.collect()) == [(0, 10, 10), (1, 2, 4), (1, 2, 4), (9, -1, 0)]
    starts = C.first_centroids(vectors, 9, "2:")
    assert starts.tolist()[-1] == [10, 10] and len(starts) == 4  # without an id: last
    done = C.yinyang(vectors, starts, 3)
    got = C.summarised(done).collect()
    assert len(got) == 4 and {r["distance"] for r in got} == {0} and {r["inertia"] for r in got} == {0}
    copies = [r["cluster"] for r in got if r["__id"] == 1]
    assert copies[0] == copies[1]  # the smaller of two equal centroids


def test_empty_and_too_large(spark):
    vectors = C.integer_vectors(frame(spark, [(1, None)]), 2, 1.0)
    done = C.yinyang(vectors, C.first_centroids(vectors, 5, "2:"), 2)
    assert C.summarised(done).collect() == [] and done.scanned == []
    with pytest.raises(PySparkException, match="or more"):
        C.integer_vectors(frame(spark, [(1, [3e38, 1])]), 2, 256.0).collect()
