"""Learned scorers. Training is distributed: library ALS and Word2Vec, exact ALS by joins and summed normal equations,
and gradient models (pairwise factors, biased factors, a neural scorer, attention) that every partition trains on its
own rows from one common start, and whose parameters are averaged by the rows that touched them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.operators import retrieval as R
from tessitura.operators.order import numbered
from tessitura.sources.scratch import materialize as store

#: What a fit on too few rows reports as its loss.
UNFITTED = 999.0


def index(df: DataFrame, column: str) -> DataFrame:
    """(column, i): dense integer ids from 0, in order, without a global sort in one task."""
    return numbered(df.select(column).distinct(), [column]).select(column, F.col("i").cast("int").alias("i"))


def als(frame: DataFrame, *, rank: int = 32, iterations: int = 10, reg: float = 0.08, alpha: float = 2.0, seed: int = 42):
    """Library implicit ALS: (user factors, item factors) as (id, vector).

    Its preference is the rating's sign and its confidence 1 + alpha |r|, so r = (c - 1) / alpha; decayed confidences
    below 1 would turn to dislikes and are held just above zero. Its regularisation grows with a row's ratings.
    """
    from pyspark.ml.recommendation import ALS

    pos = frame.where("plan_reward > 0").groupBy("user_id", "song_id").agg(F.max("confidence").alias("c"))
    users, items = index(pos, "user_id"), index(pos, "song_id")
    data = pos.join(users.withColumnRenamed("i", "u"), "user_id").join(items.withColumnRenamed("i", "v"), "song_id").select("u", "v", F.greatest((F.col("c") - 1) / alpha, F.lit(1e-3)).cast("float").alias("r"))
    fitted = ALS(rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=True, userCol="u", itemCol="v", ratingCol="r", seed=seed).fit(data)
    of = lambda factors, ids, name: factors.withColumnRenamed("id", "i").join(ids, "i").select(name, F.col("features").alias("vector"))
    return of(fitted.userFactors, users, "user_id"), of(fitted.itemFactors, items, "song_id")


def hashed_vectors(keys: list[str], size: int) -> np.ndarray:
    """Unit vectors with normal entries drawn from the keys' MD5s: the same everywhere."""
    seeds = np.array([int.from_bytes(hashlib.md5(k.encode()).digest()[:8], "little") for k in keys], np.uint64).reshape(-1, 1)
    x = seeds + np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(float) / (1 << 53)
    v = np.sqrt(-2 * np.log(u[:, :size] + 1e-300)) * np.cos(2 * np.pi * u[:, size:])
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)


def hashed_vector(key: str, size: int) -> np.ndarray:
    return hashed_vectors([key], size)[0]


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(matrix: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, size = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size or 1, dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(matrix, float).ravel()))


def exact_als(frame: DataFrame, materialize, *, rank: int = 16, iterations: int = 3, reg: float = 0.08):
    """ALS with plain regularisation and any confidence: (user factors, item factors).

    Each half-step joins the pairs with the other side's factors; every Arrow batch sums its rows' normal equations by
    id, so an id with a third of all pairs is summed wherever its pairs are, and rank * rank numbers a batch and id are
    shuffled. materialize(df, label) writes each side's factors, which keeps the plan short.
    """
    pairs = materialize(frame.where("plan_reward > 0").groupBy("user_id", "song_id").agg(F.max("confidence").alias("c")), "als-pairs")

    @F.pandas_udf("array<double>")
    def start(key: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_vectors(list(key), rank) * 0.1), dtype=object)

    items = materialize(pairs.select("song_id").distinct().withColumn("vector", start("song_id")), "als-items")

    def solve(own: str, other: str, factors: DataFrame) -> DataFrame:
        kind = pairs.schema[own].dataType.simpleString()

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rank, rank))
            for batch in batches:
                v = _rows(batch.column(0))
                total += v.T @ v if len(v) else 0
            yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1))], names=["g"])

        gram = reg * np.eye(rank) + sum(np.array(r["g"]).reshape(rank, rank) for r in factors.select("vector").mapInArrow(grams, "g array<double>").collect())  # a row a partition

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):  # rank * rank numbers a row
                    part = batch.slice(at, 2000)
                    codes, uniques = pd.factorize(part.column(0).to_pandas(), sort=False)
                    order = np.argsort(codes, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
                    y, c = _rows(part.column(2))[order], part.column(1).to_numpy(zero_copy_only=False)[order]
                    a = np.add.reduceat((y[:, :, None] * y[:, None, :]).reshape(len(y), -1) * (c - 1)[:, None], first, axis=0)
                    b = np.add.reduceat(y * c[:, None], first, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(uniques, part.column(0).type), _lists(np.hstack([a, b]))], names=[own, "x"])

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}  # of the ids of one partition
            kinds = None
            for batch in batches:
                kinds = batch.column(0).type
                for key, x in zip(batch.column(0).to_pylist(), _rows(batch.column(1))):
                    held[key] = held[key] + x if key in held else x
            keys = list(held)
            for at in range(0, len(keys), 5000):
                x = np.stack([held[k] for k in keys[at : at + 5000]])
                v = np.linalg.solve(gram + x[:, : rank * rank].reshape(-1, rank, rank), x[:, rank * rank :, None])[:, :, 0]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 5000], kinds), _lists(v)], names=[own, "vector"])

        part = pairs.join(factors, other).select(own, "c", "vector").mapInArrow(sums, f"{own} {kind}, x array<double>")
        return part.repartition(own).mapInArrow(finish, f"{own} {kind}, vector array<double>")

    users = None
    for _ in range(iterations):
        users = materialize(solve("user_id", "song_id", items), "als-users")
        items = materialize(solve("song_id", "user_id", users), "als-items")
    return users, items


def als_loss(frame: DataFrame, users: DataFrame, items: DataFrame, reg: float = 0.0) -> DataFrame:
    """Mean c (1 - x.y)^2 over the positive pairs plus reg times the squared factors: one row. Under ten pairs: UNFITTED."""
    p = frame.where("plan_reward > 0").groupBy("user_id", "song_id").agg(F.max("confidence").alias("c"))
    j = p.join(users.withColumnRenamed("vector", "x"), "user_id").join(items.withColumnRenamed("vector", "y"), "song_id")
    fit = j.agg(F.sum(F.col("c") * F.pow(1 - dot("x", "y"), F.lit(2))).alias("s"), F.count(F.lit(1)).alias("n"))
    norms = users.select("vector").unionByName(items.select("vector")).agg(F.coalesce(F.sum(dot("vector", "vector")), F.lit(0.0)).alias("r"))
    return fit.join(norms, F.lit(True)).select(F.when(F.col("n") < 10, UNFITTED).otherwise((F.col("s") + reg * F.col("r")) / F.col("n")).alias("loss"))


def dot(a: str | Column, b: str | Column, size: int | None = None) -> Column:
    """Dot product of two arrays; with their size known, as one flat expression."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    if size is None:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    out = a[0].cast("double") * b[0].cast("double")
    for i in range(1, size):
        out = out + a[i].cast("double") * b[i].cast("double")
    return out


def score_pairs(candidates: DataFrame, users: DataFrame, items: DataFrame, size: int | None = None) -> DataFrame:
    """Dot products of candidates; 0 for unknown users or songs. size: of the vectors, if known, which is faster."""
    j = candidates.join(users.withColumnRenamed("vector", "__x"), "user_id", "left").join(items.withColumnRenamed("vector", "__y"), "song_id", "left")
    return j.select(*candidates.columns, F.coalesce(dot("__x", "__y", size), F.lit(0.0)).alias("score"))


def with_hashed(items: DataFrame, songs: DataFrame, size: int, scale: float = 0.5) -> DataFrame:
    """items, and for songs without a vector the hashed one of their id, scaled: unlike for each, and small."""

    @F.pandas_udf("array<double>")
    def hashed(key: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_vectors([f"song:{k}" for k in key], size) * scale), dtype=object)

    new = songs.select("song_id").distinct().join(items, "song_id", "left_anti")
    return items.select("song_id", "vector").unionByName(new.select("song_id", hashed("song_id").alias("vector")))


def top_per_user(scored: DataFrame, k: int = 10, score: str = "score") -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(score), "song_id"))
    return scored.withColumn("rank", r).where(F.col("rank") <= k)


def biases(frame: DataFrame, damping: float = 5.0):
    """(mean, user biases, item biases) of plan rewards, damped averages of what the step before left."""
    mean = frame.agg(F.coalesce(F.avg("plan_reward"), F.lit(0.0)).alias("mean"))
    r = frame.join(F.broadcast(mean), F.lit(True)).withColumn("rest", F.col("plan_reward") - F.col("mean"))
    items = r.groupBy("song_id").agg((F.sum("rest") / (F.count(F.lit(1)) + damping)).alias("b_item"))
    users = r.join(items, "song_id").groupBy("user_id").agg((F.sum(F.col("rest") - F.col("b_item")) / (F.count(F.lit(1)) + damping)).alias("b_user"))
    return mean, users, items


def item2vec(frame: DataFrame, *, size: int = 32, window: int = 3, iterations: int = 3) -> DataFrame:
    """Unit vectors of songs from the users' first 60 positives in order: (song_id, vector)."""
    from pyspark.ml.feature import Word2Vec

    s = R.oldest(frame).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "song_id"))), lambda x: x.song_id).alias("s"))
    fitted = Word2Vec(vectorSize=size, windowSize=window, minCount=1, maxIter=iterations, seed=42, inputCol="s", outputCol="v").fit(s)
    from pyspark.ml.functions import vector_to_array

    v = fitted.getVectors().select(F.col("word").alias("song_id"), vector_to_array("vector").alias("v"))
    return v.withColumn("l", F.sqrt(dot("v", "v")) + 1e-9).select("song_id", F.transform("v", lambda x: x / F.col("l")).alias("vector"))


#: Seed vectors that a pass over all vectors compares.
SEEDS = 4096


def neighbours(vectors: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """The k songs nearest to each seed song, (seed, song_id, sim, rank), by products with all vectors.

    A stated set of queries against all rows, in blocks: SEEDS seed vectors a pass, as one matrix in each task; of a
    batch of vectors only the k nearest to each seed are passed on.
    """
    spark, found = vectors.sparkSession, None
    chosen = seeds.select("song_id").join(vectors, "song_id").orderBy("song_id")
    block: list = []

    def near(block: list) -> DataFrame:
        shipped = spark.sparkContext.broadcast(([r["song_id"] for r in block], np.array([r["vector"] for r in block], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries = shipped.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                names, sims = np.array(batch.column(0).to_pylist(), object), queries @ _rows(batch.column(1)).T
                sims = np.where(np.array(ids, object)[:, None] == names[None], -np.inf, np.round(sims, 9))
                order = np.argsort(names, kind="stable")  # ties go to the smaller id
                best = order[np.argsort(-sims[:, order], axis=1, kind="stable")[:, :k]]
                values = np.take_along_axis(sims, best, axis=1)
                use = np.isfinite(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])[use.ravel()].tolist(), pa.string()), pa.array(names[best][use].tolist(), pa.string()), pa.array(values[use])], names=["seed", "song_id", "sim"])

        return vectors.select("song_id", "vector").mapInArrow(run, "seed string, song_id string, sim double")

    for row in chosen.toLocalIterator():
        block.append(row)
        if len(block) == SEEDS:
            part, block = near(block), []
            found = part if found is None else found.unionByName(part)
    if block or found is None:
        part = near(block) if block else vectors.sparkSession.createDataFrame([], "seed string, song_id string, sim double")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("sim"), "song_id"))).where(F.col("rank") <= k)


#: Rows that a task trains on at once.
CHUNK = 200_000
Parts = Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]  # kind, keys, rows that touched each, vectors


def averaged(rows: DataFrame, order: list[str], local: Callable[[pd.DataFrame], Parts]) -> DataFrame:
    """(kind, key, n, vector): the parameters that ``local`` fits on each CHUNK of rows, users together, averaged by n.

    Rows are dealt by user and sorted, so equal data give equal parameters. What is shuffled afterwards is a vector for
    each key and chunk that touched it. The result is stored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def fitted() -> Iterator[pd.DataFrame]:
            for kind, keys, n, vectors in local(pd.concat(held, ignore_index=True)):
                use = np.flatnonzero(n)
                if len(use):
                    yield pd.DataFrame({"kind": kind, "key": [keys[i] for i in use], "n": n[use], "vector": list(vectors[use].astype(float))})

        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= CHUNK:
                yield from fitted()
                held, size = [], 0
        if size:
            yield from fitted()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}  # of the keys of one partition
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            flat, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                v = flat[ends[i] : ends[i + 1]] * n[i]
                if key in sums:
                    sums[key][0] += n[i]
                    sums[key][1] += v
                else:
                    sums[key] = [n[i], v]
        keys = list(sums)
        for at in range(0, len(keys), 10_000):
            some = keys[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some], pa.string()), pa.array([int(sums[k][0]) for k in some], pa.int64()), pa.array([sums[k][1] / sums[k][0] for k in some], pa.list_(pa.float64()))],
                names=["kind", "key", "n", "vector"],
            )

    schema = "kind string, key string, n long, vector array<double>"
    parts = rows.repartition("user_id").sortWithinPartitions("user_id", *order).mapInPandas(run, schema)
    return store(parts.repartition("kind", "key").mapInArrow(mean, schema), "averaged")


def of_kind(fitted: DataFrame, kind: str, name: str) -> DataFrame:
    """(name, vector) of one kind; users' ids are numbers."""
    key = F.col("key").cast("long") if name == "user_id" else F.col("key")
    return fitted.where(F.col("kind") == kind).select(key.alias(name), "vector")


class _Table:
    """Vectors of the keys met in a chunk, with Adagrad sums."""

    def __init__(self, keys, vectors: np.ndarray):
        self.keys, self.v = [str(k) for k in keys], vectors.astype(float)
        self.g, self.n = np.full(len(self.v), 1e-8), np.zeros(len(self.v), np.int64)

    def step(self, at: np.ndarray, gradient: np.ndarray, rate: float, reg: float = 0.0) -> None:
        """Step against the gradients of rows ``at``, summed where they repeat."""
        order = np.argsort(at, kind="stable")
        rows, first, counts = np.unique(at[order], return_index=True, return_counts=True)
        g = np.add.reduceat(gradient[order], first, axis=0) + reg * counts[:, None] * self.v[rows]
        self.g[rows] += (g * g).mean(axis=1)
        self.v[rows] -= rate * g / np.sqrt(self.g[rows])[:, None]
        self.n[rows] += counts


def _start(prefix: str, keys, size: int, scale: float) -> np.ndarray:
    return hashed_vectors([f"{prefix}:{k}" for k in keys], size) * scale


def _blocks(n: int, epoch: int, size: int = 1024) -> Iterator[np.ndarray]:
    """The numbers up to n in an order of the epoch's own, in blocks."""
    order = np.random.default_rng(epoch).permutation(n)
    return (order[i : i + size] for i in range(0, n, size))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pairwise_factors(triples: DataFrame, *, size: int = 32, epochs: int = 8, rate: float = 0.1, reg: float = 1e-3, tokens: DataFrame | None = None, unit: bool = False):
    """Pairwise (BPR) factors of (user, pos, neg) triples: (user vectors, song vectors), by Adagrad in blocks.

    With tokens (song_id, token), a song is the sum of its tokens' vectors and its own, so a song never met still
    scores by what is known of it, and a user has the side tokens of ``content.user_tokens``. unit: vectors of length 1,
    so that their products are cosines.
    """
    if tokens is not None:
        of = tokens.groupBy("song_id").agg(F.sort_array(F.collect_set("token")).alias("t"))
        for side in ("pos", "neg"):
            triples = triples.join(of.select(F.col("song_id").alias(side), F.col("t").alias(f"t_{side}")), side, "left")

    sided = tokens is not None  # the function must not hold the table itself

    def local(pdf: pd.DataFrame) -> Parts:
        u, users = pd.factorize(pdf["user_id"])
        both, songs = pd.factorize(pd.concat([pdf["pos"], pdf["neg"]], ignore_index=True))
        p, q = both[: len(pdf)], both[len(pdf) :]
        tu = _Table(users, _start("u", users, size, 0.2))
        ts = _Table(songs, _start("song", songs, size, 0.2))
        tt, of_song, of_user = None, None, None
        if sided:
            listed = [[] for _ in songs]
            for codes, column in ((p, "t_pos"), (q, "t_neg")):
                for i in np.unique(codes, return_index=True)[1]:
                    t = pdf[column].iloc[i]
                    listed[codes[i]] = [] if t is None else list(t)
            sides = [[f"u:{int(x) % 97}", "tod:3", "dow:2"] for x in users]
            names = sorted({t for row in (*listed, *sides) for t in row})
            tt, number = _Table(names, _start("t", names, size, 0.1)), {t: i for i, t in enumerate(names)}
            width = max(1, max(map(len, listed), default=1))
            of_song = np.full((len(songs), width), -1)
            for i, row in enumerate(listed):
                of_song[i, : len(row)] = [number[t] for t in row]
            of_user = np.array([[number[t] for t in row] for row in sides])

        def vector(table: _Table, own: np.ndarray, side: np.ndarray | None) -> np.ndarray:
            if side is None:
                return table.v[own]
            t = side[own]
            return table.v[own] + np.where((t >= 0)[:, :, None], tt.v[t], 0.0).sum(axis=1)

        for epoch in range(epochs):
            for b in _blocks(len(pdf), epoch):
                x, y, z = vector(tu, u[b], of_user), vector(ts, p[b], of_song), vector(ts, q[b], of_song)
                e = _sigmoid(-(x * (y - z)).sum(axis=1))[:, None]
                gx, gy = -e * (y - z), -e * x
                tu.step(u[b], gx, rate, reg)
                ts.step(np.r_[p[b], q[b]], np.vstack([gy, -gy]), rate, reg)
                if tt is not None:
                    at = np.hstack([np.r_[of_song[p[b]], of_song[q[b]]].ravel(), of_user[u[b]].ravel()])
                    g = np.vstack([np.repeat(np.vstack([gy, -gy]), of_song.shape[1], axis=0), np.repeat(gx, 3, axis=0)])
                    tt.step(at[at >= 0], g[at >= 0], rate, reg)
        yield "u", tu.keys, tu.n, tu.v
        yield "s", ts.keys, ts.n, ts.v
        if tt is not None:
            yield "t", tt.keys, tt.n, tt.v

    fitted = averaged(triples, ["pos", "neg"], local)
    users, songs = of_kind(fitted, "u", "user_id"), of_kind(fitted, "s", "song_id")
    if tokens is not None:
        t = of_kind(fitted, "t", "token")
        summed = lambda rows, key: rows.groupBy(key).agg(F.array(*[F.sum(F.col("vector")[i]) for i in range(size)]).alias("vector"))
        songs = summed(tokens.join(t, "token").select("song_id", "vector").unionByName(songs), "song_id")
        own = users.select("user_id", F.explode(F.array(F.concat(F.lit("u:"), (F.col("user_id") % 97).cast("string")), F.lit("tod:3"), F.lit("dow:2"))).alias("token"))
        users = summed(own.join(t, "token").select("user_id", "vector").unionByName(users), "user_id")
    if unit:
        of_length = lambda df: df.withColumn("vector", F.transform("vector", lambda x: x / (F.sqrt(dot("vector", "vector", size)) + 1e-9)))
        users, songs = of_length(users), of_length(songs)
    return users, songs


def svd(frame: DataFrame, *, rank: int = 16, epochs: int = 12, rate: float = 0.1, reg: float = 0.02):
    """Biased factors by gradient steps on squared error, started from damped averages: (mean, users, songs).

    Vectors hold the bias first. mean: one number. See ``svd_score`` for what is not known.
    """
    level, bu, bi = biases(frame)
    mean = level.first()["mean"]
    rows = frame.select("user_id", "song_id", "plan_reward").join(bu, "user_id").join(bi, "song_id")

    def local(pdf: pd.DataFrame) -> Parts:
        u, users = pd.factorize(pdf["user_id"])
        s, songs = pd.factorize(pdf["song_id"])
        r = pdf["plan_reward"].to_numpy(float) - mean
        first = lambda codes, n, column: pdf[column].to_numpy(float)[np.unique(codes, return_index=True)[1]].reshape(n, 1)
        bias_u, bias_s = _Table(users, first(u, len(users), "b_user")), _Table(songs, first(s, len(songs), "b_item"))
        tu, ts = _Table(users, _start("u", users, rank, 0.1)), _Table(songs, _start("s", songs, rank, 0.1))
        for epoch in range(epochs):
            for b in _blocks(len(pdf), epoch):
                x, y = tu.v[u[b]], ts.v[s[b]]
                e = (bias_u.v[u[b], 0] + bias_s.v[s[b], 0] + (x * y).sum(axis=1) - r[b])[:, None]
                for table, at, g in ((bias_u, u[b], e), (bias_s, s[b], e), (tu, u[b], e * y), (ts, s[b], e * x)):
                    table.step(at, g, rate * (0.2 if g is e else 1.0), reg)
        yield "u", tu.keys, tu.n, np.hstack([bias_u.v, tu.v])
        yield "s", ts.keys, ts.n, np.hstack([bias_s.v, ts.v])

    fitted = averaged(rows, ["song_id"], local)
    return float(mean), of_kind(fitted, "u", "user_id"), of_kind(fitted, "s", "song_id")


def svd_score(mean: float, x: str = "x", y: str = "y", rank: int = 16) -> Column:
    """Mean, both biases and the product; without the user (or the song) the mean and the song's bias, if it has one."""
    x, y = F.col(x), F.col(y)
    product = x[1].cast("double") * y[1].cast("double")
    for i in range(2, rank + 1):  # a slice would be made anew for each of its numbers
        product = product + x[i].cast("double") * y[i].cast("double")
    known = x[0] + y[0] + product
    return F.lit(mean) + F.when(x.isNull() | y.isNull(), F.coalesce(y[0], F.lit(0.0))).otherwise(known)


def svd_predict(model, candidates: DataFrame, rank: int = 16) -> DataFrame:
    mean, users, songs = model
    j = candidates.join(users.withColumnRenamed("vector", "__x"), "user_id", "left").join(songs.withColumnRenamed("vector", "__y"), "song_id", "left")
    return j.select(*candidates.columns, svd_score(mean, "__x", "__y", rank).alias("score"))


class NeuralShape:
    """Sizes of the neural scorer: embeddings of both branches, and the layers of its perceptron."""

    EMBEDDING, META, HIDDEN = 8, 12, (32, 16)


def _unpack(flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers (weights, bias) of the perceptron, and last the output over both branches."""
    n = NeuralShape
    sizes, at, out = [2 * n.EMBEDDING + n.META, *n.HIDDEN], 0, []
    for a, b in [*zip(sizes, sizes[1:]), (n.EMBEDDING + n.HIDDEN[-1], 1)]:
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _neural_start() -> np.ndarray:
    """Weights by Xavier's rule, from one seed; biases zero."""
    n, rng, out = NeuralShape, np.random.default_rng(3), []
    sizes = [2 * n.EMBEDDING + n.META, *n.HIDDEN]
    for a, b in [*zip(sizes, sizes[1:]), (n.EMBEDDING + n.HIDDEN[-1], 1)]:
        edge = np.sqrt(6 / (a + b))
        out += [rng.uniform(-edge, edge, a * b), np.zeros(b)]
    return np.concatenate(out)


def neural_forward(x: np.ndarray, y: np.ndarray, meta: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Affinity in (0, 1) of rows of user embeddings, song embeddings and song metadata, and the layers' outputs."""
    k = NeuralShape.EMBEDDING
    *layers, (w, b) = _unpack(flat)
    h = [np.hstack([x[:, k:], y[:, k:], meta])]
    for weights, bias in layers:
        h.append(np.maximum(h[-1] @ weights + bias, 0.0))
    joined = np.hstack([x[:, :k] * y[:, :k], h[-1]])
    return _sigmoid(joined @ w + b)[:, 0], [*h, joined]


def neural(frame: DataFrame, meta: DataFrame, *, epochs: int = 6, rate: float = 0.05):
    """A matrix branch (products of embeddings) and a perceptron branch (embeddings and metadata) under one logistic
    output, by cross-entropy with rewards mapped to [0, 1]: (user embeddings, song embeddings, weights).

    meta: (song_id, features), twelve numbers a song; a song without them has zeros.
    """
    n = NeuralShape
    # the whole catalog is small on disk and large as rows: only songs of the frame are sent to its tasks
    meta = store(meta.join(frame.select("song_id").distinct(), "song_id", "left_semi"), "frame-metadata")
    rows = frame.select("user_id", "song_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("plan_reward") + 1) / 2)).alias("y")).join(meta, "song_id", "left")

    def local(pdf: pd.DataFrame) -> Parts:
        u, users = pd.factorize(pdf["user_id"])
        s, songs = pd.factorize(pdf["song_id"])
        target, k = pdf["y"].to_numpy(float), n.EMBEDDING
        facts = np.stack([np.zeros(n.META) if f is None else np.asarray(f, float) for f in pdf["features"].iloc[np.unique(s, return_index=True)[1]]])
        tu, ts = _Table(users, _start("u", users, 2 * k, 0.1)), _Table(songs, _start("s", songs, 2 * k, 0.1))
        flat = _neural_start()
        squares = np.full(len(flat), 1e-8)
        for epoch in range(epochs):
            for b in _blocks(len(pdf), epoch, 512):
                x, y = tu.v[u[b]], ts.v[s[b]]
                p, (*h, joined) = neural_forward(x, y, facts[s[b]], flat)
                *layers, (w, _) = _unpack(flat)
                d = (p - target[b])[:, None] / len(b)
                grads = [(joined.T @ d).ravel(), d.sum(axis=0)]
                back = d @ w.T
                product, back = back[:, :k], back[:, k:]
                for (weights, _), before, after in zip(layers[::-1], h[-2::-1], h[:0:-1]):
                    back = back * (after > 0)
                    grads = [(before.T @ back).ravel(), back.sum(axis=0), *grads]
                    back = back @ weights.T
                g = np.concatenate(grads)
                squares += g * g
                flat -= rate * g / np.sqrt(squares)
                tu.step(u[b], np.hstack([product * y[:, :k], back[:, :k]]) * len(b), rate)
                ts.step(s[b], np.hstack([product * x[:, :k], back[:, k : 2 * k]]) * len(b), rate)
        yield "u", tu.keys, tu.n, tu.v
        yield "s", ts.keys, ts.n, ts.v
        yield "w", ["all"], np.array([len(pdf)]), flat[None]

    fitted = averaged(rows, ["song_id"], local)
    weights = fitted.where("kind = 'w'").select("vector").first()  # one row: the perceptron's numbers
    return of_kind(fitted, "u", "user_id"), of_kind(fitted, "s", "song_id"), _neural_start() if weights is None else np.array(weights["vector"])


def neural_score(weights: np.ndarray) -> Callable[..., Column]:
    """udf(user embedding, song embedding, metadata) -> score in [-1, 1]; 0.5 for a song without an embedding, and for a
    user without one the score of a zero embedding."""
    size = 2 * NeuralShape.EMBEDDING

    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series, meta: pd.Series) -> pd.Series:
        out, known = np.full(len(y), 0.5), np.flatnonzero(y.notna().to_numpy())
        if len(known):
            stacked = lambda c, width: np.stack([np.zeros(width) if v is None else np.asarray(v, float) for v in c.iloc[known]])
            out[known] = neural_forward(stacked(x, size), stacked(y, size), stacked(meta, NeuralShape.META), weights)[0] * 2 - 1
        return pd.Series(out)

    return scored


#: Songs of a history that attention sees, and of a training prefix.
SEEN, CONTEXT = 20, 9


def attention_state(vectors: np.ndarray, wq: np.ndarray, wk: np.ndarray, wv: np.ndarray, present: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """State of the last place of each row of histories [rows, places, size]: one head, the last place asks.

    present: which places are not padding (at the front). Returns (state, attention, query, keys, values).
    """
    q, k, v = vectors[:, -1] @ wq, vectors @ wk, vectors @ wv
    z = np.einsum("nd,nld->nl", q, k) / np.sqrt(wq.shape[1])
    if present is not None:
        z = np.where(present, z, -1e9)
    a = np.exp(z - z.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    return np.einsum("nl,nld->nd", a, v), a, q, k, v


def attention(frame: DataFrame, *, size: int = 32, epochs: int = 3, rate: float = 0.05):
    """Causal attention over each user's last SEEN positives, trained to prefer each next song to another of the same
    history: (song vectors, query, key and value matrices)."""
    rows = R.last(frame, SEEN).select("user_id", "song_id", (-F.col("back")).alias("at"))

    def local(pdf: pd.DataFrame) -> Parts:
        s, songs = pd.factorize(pdf["song_id"])
        table = _Table(songs, _start("s", songs, size, 0.3))
        rng = np.random.default_rng(9)
        w = [np.eye(size) + rng.normal(0, 0.05, (size, size)) for _ in range(3)]
        squares = [np.full((size, size), 1e-4) for _ in range(3)]
        contexts, nexts, others = [], [], []
        user = pdf["user_id"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(user)) + 1, len(user)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            own = s[i:j]
            for t in range(len(own) - 1):
                other = own[rng.integers(0, len(own))]
                if len(own) >= 3 and other != own[t + 1]:
                    seen = own[max(0, t - CONTEXT + 1) : t + 1]
                    contexts.append(np.r_[np.full(CONTEXT - len(seen), -1), seen])
                    nexts.append(own[t + 1])
                    others.append(other)
        if contexts:
            c, p, q = np.array(contexts), np.array(nexts), np.array(others)
            for epoch in range(epochs):
                for b in _blocks(len(c), epoch, 256):
                    present = c[b] >= 0
                    x = np.where(present[:, :, None], table.v[c[b]], 0.0)
                    h, a, query, keys, values = attention_state(x, *w, present)
                    y, z = table.v[p[b]], table.v[q[b]]
                    e = _sigmoid(-(h * (y - z)).sum(axis=1))[:, None]
                    dh = -e * (y - z)
                    dv = a[:, :, None] * dh[:, None, :]
                    da = np.einsum("nd,nld->nl", dh, values)
                    dz = a * (da - (a * da).sum(axis=1, keepdims=True)) / np.sqrt(size)
                    dq, dk = np.einsum("nl,nld->nd", dz, keys), dz[:, :, None] * query[:, None, :]
                    flat = x.reshape(-1, size)
                    grads = [x[:, -1].T @ dq, flat.T @ dk.reshape(-1, size), flat.T @ dv.reshape(-1, size)]
                    dx = dk @ w[1].T + dv @ w[2].T
                    dx[:, -1] += dq @ w[0].T
                    for i, g in enumerate(grads):
                        squares[i] += (g / len(b)) ** 2
                        w[i] -= 0.1 * rate * (g / len(b)) / np.sqrt(squares[i])
                    at = np.r_[p[b], q[b], c[b][present]]
                    table.step(at, np.vstack([-e * h, e * h, dx[present]]), rate, 1e-3)
        yield "s", table.keys, np.maximum(table.n, 1), table.v
        yield "w", ["all"], np.array([max(len(contexts), 1)]), np.concatenate([m.ravel() for m in w])[None]

    fitted = averaged(rows, ["at"], local)
    weights = fitted.where("kind = 'w'").select("vector").first()  # one row: three matrices
    return of_kind(fitted, "s", "song_id"), np.tile(np.eye(size).ravel(), 3) if weights is None else np.array(weights["vector"])


def session_vectors(frame: DataFrame, model) -> DataFrame:
    """(user_id, vector): what attention makes of each user's last SEEN positives that have a vector."""
    songs, weights = model
    size = int(round((len(weights) / 3) ** 0.5))
    w = weights.reshape(3, size, size)
    h = R.last(frame, SEEN).join(songs, "song_id").select("user_id", "back", "vector")

    def one(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(-group.column("back").to_numpy())  # the latest comes last
        x = _rows(group.column("vector").combine_chunks())[order]
        return pa.table({"user_id": pa.array([key[0].as_py()], pa.int64()), "vector": _lists(attention_state(x[None], *w)[0])})

    return h.groupBy("user_id").applyInArrow(one, "user_id long, vector array<double>")


def sequence_score(x: Column, y: Column, p: Column, size: int = 32) -> Column:
    """(.6 sigma(h . e) + .4 min(5 p, 1)) * 2 - 1: x the session's vector, y the song's (without either its part is 0),
    p the chance of the song after the latest one."""
    part = F.when(x.isNull() | y.isNull(), 0.0).otherwise(1 / (1 + F.exp(-dot(x, y, size))))
    return (0.6 * part + 0.4 * F.least(5 * F.coalesce(p, F.lit(0.0)), F.lit(1.0))) * 2 - 1


def next_songs(frame: DataFrame) -> DataFrame:
    """(user_id, song_id, p): songs that followed the user's latest one, and how often."""
    latest = R.last(frame, 1).select("user_id", F.col("song_id").alias("src"))
    return latest.join(R.markov(frame), "src").select("user_id", F.col("dst").alias("song_id"), "p")


def attention_score(frame: DataFrame, candidates: DataFrame, model, size: int = 32) -> DataFrame:
    songs, _ = model
    j = (
        candidates.join(session_vectors(frame, model).withColumnRenamed("vector", "__x"), "user_id", "left").join(songs.withColumnRenamed("vector", "__y"), "song_id", "left")
        .join(next_songs(frame).withColumnRenamed("p", "__p"), ["user_id", "song_id"], "left")
    )
    return j.select(*candidates.columns, sequence_score(F.col("__x"), F.col("__y"), F.col("__p"), size).alias("score"))


def pairwise_accuracy(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: the share of pairs (p_<f>, q_<f>) whose liked side scores higher."""
    margin = sum(((F.coalesce(f"p_{f}", F.lit(0.0)) - F.coalesce(f"q_{f}", F.lit(0.0))) * w for f, w in weights.items()), F.lit(0.0))
    return pairs.agg(F.coalesce(F.avg(F.when(margin > 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


#: Pairs of a user that are fitted in one place.
BLEND_BLOCK = 4096


def blender(pairs: DataFrame, start: dict[str, float], *, rate: float = 0.05, epochs: int = 40, l2: float = 1e-4, least: int = 5, mood: str = "") -> DataFrame:
    """(user_id, mood, weights, n_pairs, accuracy): pairwise logistic weights from liked (p_<f>) and not liked (q_<f>)
    feature values, one row for all users (user_id -1), and one for each user of at least ``least`` pairs.

    All users' weights start from ``start`` and are averaged over chunks; a user's own start from those, with five times
    the penalty, and are averaged over blocks of pairs, so no task holds more than one block of a user.
    """
    features = list(start)
    diff = F.array(*[F.coalesce(f"p_{f}", F.lit(0.0)) - F.coalesce(f"q_{f}", F.lit(0.0)) for f in features])
    rows = store(pairs.select("user_id", diff.alias("d")), "judged")

    def descend(w: np.ndarray, d: np.ndarray, times: int, penalty: float) -> np.ndarray:
        for _ in range(times):
            w = w - rate * (penalty * w - (d * _sigmoid(-(d @ w))[:, None]).mean(axis=0))
        return w

    first = np.array([start[f] for f in features])

    def local(pdf: pd.DataFrame) -> Parts:
        yield "w", ["all"], np.array([len(pdf)]), descend(first, np.stack(pdf["d"].to_numpy()), epochs, l2)[None]

    got = averaged(rows, ["d"], local).select("vector").first()  # one row
    overall = first if got is None else np.array(got["vector"])
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    dealt = rows.join(sizes.hint("merge"), "user_id").withColumn("block", F.pmod(F.xxhash64("d"), F.ceil(F.col("n") / BLEND_BLOCK)))

    def own(key: tuple, group: pa.Table) -> pa.Table:
        d = _rows(group.column("d").combine_chunks())
        w = descend(overall, d, min(epochs, 80), 5 * l2)
        return pa.table({"user_id": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(d)], pa.int64()), "w": _lists(w[None] * len(d))})

    parts = dealt.groupBy("user_id", "block").applyInArrow(own, "user_id long, n long, w array<double>")
    mean = parts.groupBy("user_id").agg(F.array(*[F.sum(F.col("w")[i]) / F.sum("n") for i in range(len(features))]).alias("weights"), F.sum("n").alias("n_pairs"))
    everyone = rows.agg(F.lit(-1).cast("long").alias("user_id"), F.array(*map(F.lit, map(float, overall))).alias("weights"), F.count(F.lit(1)).alias("n_pairs"))
    fitted = store(everyone.select("user_id", "weights", "n_pairs").unionByName(mean.select("user_id", "weights", "n_pairs")), "blender")
    right = lambda w: F.when(dot(F.col("d"), w, len(features)) > 0, 1.0).otherwise(0.0)
    of_users = rows.join(fitted.hint("merge"), "user_id").groupBy("user_id").agg(F.avg(right(F.col("weights"))).alias("accuracy"))
    of_all = rows.agg(F.lit(-1).cast("long").alias("user_id"), F.coalesce(F.avg(right(F.array(*map(F.lit, map(float, overall))))), F.lit(0.0)).alias("accuracy"))
    return fitted.join(of_users.unionByName(of_all).hint("merge"), "user_id").withColumn("mood", F.lit(mood)).select("user_id", "mood", "weights", "n_pairs", "accuracy")


#: Weight of what a mood's weights start from, in curvature; and the hash share of pairs that only measures.
SHRINK, HELD_OUT = 2.0, 4


def mood_blender(pairs: DataFrame, weights: DataFrame, features: list[str], *, shrink: float = SHRINK) -> DataFrame:
    """(user_id, mood, weights, n_pairs, held_out, accuracy, user_accuracy): weights of each user's moods, and of all users' (-1).

    pairs: (user_id, mood, p_<f>, q_<f>), a row for each mood that a judged pair belongs to; weights: (user_id, weights)
    of ``blender``. A mood's weights are the most likely ones around its user's (those of all, for a user without): one
    step of the loss's gradient by its curvature plus ``shrink``, both sums over the mood's pairs, so a mood of few pairs
    stays near its user and one of many is its own. All sums, of users and of all users alike, come from one pass over
    the pairs and are combined before they are shuffled. A quarter of the pairs, by hash, only measures: accuracy on it of the mood's weights and of the user's.
    """
    size = len(features)
    upper = np.triu_indices(size)
    diff = F.array(*[F.coalesce(f"p_{f}", F.lit(0.0)) - F.coalesce(f"q_{f}", F.lit(0.0)) for f in features])
    every = pairs.where(F.col("user_id").isNotNull() & F.col("mood").isNotNull()).select("user_id", "mood", diff.alias("d"))
    everyone = weights.where("user_id = -1").select("weights").first()  # one row
    overall = np.array(everyone["weights"], float) if everyone else np.zeros(size)
    start = weights.where("user_id <> -1").select("user_id", F.col("weights").alias("w"))
    of_all = F.array(*map(F.lit, overall.tolist()))
    rows = every.where(F.lit(everyone is not None)).join(start.hint("merge"), "user_id", "left").select("user_id", "mood", "d", F.coalesce("w", of_all).alias("w"))
    drawn = lambda user: F.pmod(F.xxhash64(user, F.col("d")), F.lit(HELD_OUT)) == 0
    rows = store(rows.withColumn("held", drawn("user_id")).withColumn("held_by_all", drawn(F.lit(-1).cast("long"))), "mood-pairs")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch a row for each user's mood, and one for each mood of all users."""
        for batch in batches:
            if not batch.num_rows:
                continue
            d, own = _rows(batch.column("d")), _rows(batch.column("w"))
            users, moods = np.array(batch.column("user_id").to_pylist(), np.int64), np.array(batch.column("mood").to_pylist(), object)
            for ids, w, held in ((users, own, "held"), (np.full(len(d), -1), np.tile(overall, (len(d), 1)), "held_by_all")):
                use = ~batch.column(held).to_numpy(zero_copy_only=False).astype(bool)
                if not use.any():
                    continue
                x, v = d[use], w[use]
                key, of = pd.factorize(pd.Series(list(zip(ids[use].tolist(), moods[use].tolist()))))
                p = _sigmoid((x * v).sum(axis=1))
                each = np.hstack([np.ones((len(x), 1)), x * (1 - p)[:, None], (x[:, upper[0]] * x[:, upper[1]]) * (p * (1 - p))[:, None]])
                total, first = np.zeros((len(of), each.shape[1])), np.unique(key, return_index=True)[1]
                np.add.at(total, key, each)
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in of], pa.int64()), pa.array([m for _, m in of], pa.string()), _lists(v[first]), _lists(total)], names=["user_id", "mood", "w", "s"])

    n = 1 + size + len(upper[0])
    summed = rows.mapInArrow(sums, "user_id long, mood string, w array<double>, s array<double>")
    summed = summed.groupBy("user_id", "mood").agg(F.first("w").alias("w"), F.array(*[F.sum(F.col("s")[i]) for i in range(n)]).alias("s"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, h = _rows(batch.column("s")), np.zeros((batch.num_rows, size, size))
                h[:, upper[0], upper[1]] = s[:, 1 + size :]
                h = h + np.triu(h, 1).transpose(0, 2, 1) + shrink * np.eye(size)
                w = _rows(batch.column("w")) + np.linalg.solve(h, s[:, 1 : 1 + size, None])[:, :, 0]
                yield pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("mood"), _lists(w), pa.array(s[:, 0].astype(np.int64))], names=["user_id", "mood", "weights", "n_pairs"])

    fitted = store(summed.mapInArrow(solved, "user_id long, mood string, weights array<double>, n_pairs long"), "mood-weights")
    right = lambda w: F.when(dot("d", w, size) > 0, 1.0).otherwise(0.0)
    accuracy = [F.count(F.lit(1)).alias("held_out"), F.avg(right("weights")).alias("accuracy"), F.avg(right("w")).alias("user_accuracy")]
    own = rows.where("held").join(fitted.select("user_id", "mood", "weights").hint("merge"), ["user_id", "mood"]).groupBy("user_id", "mood").agg(*accuracy)
    by_mood = fitted.where("user_id = -1").select("mood", "weights")  # a row a mood
    of_moods = rows.where("held_by_all").select("mood", "d", of_all.alias("w")).join(F.broadcast(by_mood), "mood").groupBy("mood").agg(*accuracy)
    measured = own.unionByName(of_moods.withColumn("user_id", F.lit(-1).cast("long")))
    return fitted.join(measured.hint("merge"), ["user_id", "mood"], "left").select("user_id", "mood", "weights", "n_pairs", F.coalesce("held_out", F.lit(0)).alias("held_out"), "accuracy", "user_accuracy")


def save(model: dict[str, DataFrame], path: str) -> None:
    """Write a model's tables, one folder each."""
    for name, table in model.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
