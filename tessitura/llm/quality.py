"""Document quality by positive-unlabelled learning.

Trusted positives are documents labelled good; all documents are unlabelled web text. A linear model over binned text
statistics minimises the non-negative unbiased risk

    pi * E_pos[l(+)] + max(0, E_unl[l(-)] - pi * E_pos[l(-)])

with the logistic loss l. The class prior pi is estimated first: of a positive-against-unlabelled model, the least ratio
of unlabelled to positive rows above any of its thresholds.

Only the labelled sample is bounded. What is taken from unlabelled documents is summed over all of them, on the
executors: quantiles of the statistics (counts on a grid of floating-point values), then, of every document's fourteen
bin numbers, stored once, the loss, gradient and curvature of each Newton step (sums of a fixed size), and the counts
above the prior's thresholds. Every whole text is scored, in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm._linear import sigmoid
from tessitura.llm._shared import arrow_limits, col, discard, materialize

#: Labelled rows that are fitted on at most, the first by a hash of the id.
POSITIVES = 6000
BINS = 12
#: Newton steps at most, and the gradient's largest part at which they end.
STEPS, FLAT = 25, 1e-7
L2 = 1e-3
#: Steps in search of the weight of the second part of the risk, and what of it counts as zero.
SPLITS, NEGLIGIBLE = 16, 1e-4
#: Bits of a single-precision number that the grid of quantiles leaves out.
COARSE = 14
#: Share of the positives that a threshold must still pass for its ratio to count in the prior.
PRIOR_REACH = 0.8

STATS = ("log_words", "variety", "word_length", "symbols", "upper", "digits", "punctuation", "duplicate_lines", "top_word", "stutter", "exclamations", "bars", "line_words", "letters")
_UPPER, _DIGITS, _PUNCT, _SYMBOLS = bytes(range(65, 91)), b"0123456789", b".,;:!?", b"#*$%&<>@^~=_{}[]"
_NOT_LETTERS = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))


def stats(text: bytes | None) -> list[float]:
    """The statistics of one whole text; an empty one has zeros."""
    w = text.split() if text else []
    n = len(w)
    if not n:
        return [0.0] * len(STATS)
    size = len(text)
    of = lambda chars: size - len(text.translate(None, chars))
    counts = Counter(w)
    lines = [x for x in text.split(b"\n") if x.strip()]
    inside = sum(map(len, w))
    return [
        float(np.log(n)), float(np.log(len(counts)) / np.log(n)) if n > 1 else 1.0, inside / n, of(_SYMBOLS) / n, of(_UPPER) / inside, of(_DIGITS) / inside,
        of(_PUNCT) / n, 1 - len(set(lines)) / len(lines), max(counts.values()) / n, sum(map(bytes.__eq__, w[1:], w)) / n, text.count(b"!") / n, text.count(b"|") / n,
        n / len(lines), 1 - of(_NOT_LETTERS) / size,
    ]


class Model(NamedTuple):
    edges: np.ndarray  # statistics x (BINS - 1)
    weights: np.ndarray  # statistics * BINS, and the intercept
    prior: float


def _codes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin numbers: rows x statistics."""
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def _one_hot(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] * BINS), np.float32)
    out[np.arange(len(codes))[:, None], codes + np.arange(codes.shape[1]) * BINS] = 1
    return out


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins: rows x (statistics * BINS)."""
    return _one_hot(_codes(x, edges))


def _grid(x: np.ndarray) -> np.ndarray:
    """Numbers whose order is that of x's values, coarser than they are."""
    bits = (x.astype(np.float32) + np.float32(0)).view(np.uint32)  # -0 is 0
    return (np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)) >> COARSE).astype(np.int64)


def _value(grid: np.ndarray) -> np.ndarray:
    """The least value of each number of the grid."""
    bits = (grid.astype(np.uint64) << COARSE).astype(np.uint32)
    return np.where(bits >> 31, bits & np.uint32(0x7FFFFFFF), ~bits).astype(np.uint32).view(np.float32).astype(float)


def _grid_counts(x: np.ndarray) -> dict[tuple[int, int], int]:
    out = {}
    for i in range(x.shape[1]):
        values, n = np.unique(_grid(x[:, i]), return_counts=True)
        out |= {(i, int(v)): int(k) for v, k in zip(values, n)}
    return out


def _quantiles(counts: dict[tuple[int, int], int], shares: np.ndarray) -> np.ndarray:
    """Statistics x shares, from counts of (statistic, grid number)."""
    out = []
    for i in range(len(STATS)):
        grid = np.array(sorted((g, n) for (k, g), n in counts.items() if k == i))
        upto = np.cumsum(grid[:, 1])
        out.append(_value(grid[np.searchsorted(upto, shares * (upto[-1] - 1), "right"), 0]))
    return np.array(out)


def _sums(codes: np.ndarray, half: np.ndarray, models: list[tuple[int | None, np.ndarray]]) -> np.ndarray:
    """For each model (half that it sees, None: both; weights): rows, loss of "negative", gradient, and the upper half of the curvature, in one array."""
    size = len(STATS) * BINS + 1
    upper = np.triu_indices(size)
    out = np.zeros((len(models), 2 + size + len(upper[0])))
    for at in range(0, len(codes), 4096):
        x = np.hstack([_one_hot(codes[at : at + 4096]), np.ones((len(codes[at : at + 4096]), 1), np.float32)])
        for k, (own, w) in enumerate(models):
            rows = x if own is None else x[half[at : at + 4096] == own]
            z = rows @ w
            p = sigmoid(z)
            out[k, 0] += len(rows)
            out[k, 1] += np.logaddexp(0, z).sum()
            out[k, 2 : 2 + size] += rows.T @ p
            out[k, 2 + size :] += (rows.T @ (rows * (p * (1 - p)).astype(np.float32)[:, None]))[upper]
    return out


def _above(codes: np.ndarray, half: np.ndarray, models: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each (half, weights, cuts): rows with at least each cut, and last all rows."""
    x = _one_hot(codes)
    return np.array([[*((x[half == own] @ w[:-1])[:, None] >= cuts[None]).sum(0), (half == own).sum()] for own, w, cuts in models], float)


class Rows:
    """Unlabelled statistics at hand, as ``_fit`` reads them."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.half = np.arange(len(x)) % 2

    def quantiles(self, shares: np.ndarray) -> np.ndarray:
        return _quantiles(_grid_counts(self.x), shares)

    def bin(self, edges: np.ndarray) -> None:
        self.codes = _codes(self.x, edges)

    def sums(self, models: list) -> np.ndarray:
        return _sums(self.codes, self.half, models)

    def above(self, models: list) -> np.ndarray:
        return _above(self.codes, self.half, models)


class Stored:
    """Unlabelled statistics of all documents (``half, x``), stored; sums are made where the rows are."""

    def __init__(self, table: DataFrame):
        self.table, self.n, self.codes = table, table.count(), None

    def quantiles(self, shares: np.ndarray) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                if batch.num_rows:
                    total.update(_grid_counts(_matrix(batch.column("x"))))
            rows = [(i, g, n) for (i, g), n in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["i", "g", "n"])

        counted = self.table.select("x").mapInArrow(count, "i long, g long, n long").groupBy("i", "g").agg(F.sum("n").alias("n")).collect()  # of a grid
        return _quantiles({(r["i"], r["g"]): r["n"] for r in counted}, shares)

    def bin(self, edges: np.ndarray) -> None:
        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes = _codes(_matrix(batch.column("x")), edges)
                    yield pa.RecordBatch.from_arrays([batch.column("half"), pa.array([c.tobytes() for c in codes], pa.binary())], ["half", "codes"])

        self.codes = materialize(self.table.select("half", "x").mapInArrow(binned, "half int, codes binary"), "quality-bins")

    def _total(self, f, models: list) -> np.ndarray:
        """f(codes, half, models) summed over all rows: a row a partition, then a row for each of a few tasks, then here."""
        empty = f(np.zeros((0, len(STATS)), np.uint8), np.zeros(0, int), models)

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(empty.shape)
            for batch in batches:
                if batch.num_rows:
                    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, len(STATS))
                    total += f(codes, batch.column("half").to_numpy(), models)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(empty.size)
            for batch in batches:
                for part in batch.column("total"):
                    total += np.frombuffer(part.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        parts = self.codes.mapInArrow(own, "total binary").repartition(8).mapInArrow(added, "total binary").collect()
        return np.sum([np.frombuffer(r["total"]) for r in parts], axis=0).reshape(empty.shape)

    def sums(self, models: list) -> np.ndarray:
        return self._total(_sums, models)

    def above(self, models: list) -> np.ndarray:
        return self._total(_above, models)

    def close(self) -> None:
        for t in (self.table, self.codes):
            if t is not None:
                discard(t)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _least_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    return float(np.clip((unlabelled / positive).min(), 0.05, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least share of unlabelled over positive scores at or above a threshold that passes PRIOR_REACH of the positives."""
    cuts = np.quantile(positive, np.linspace(0.0, 1 - PRIOR_REACH, 101))
    return _least_ratio(np.array([(positive >= c).mean() for c in cuts]), np.array([(unlabelled >= c).mean() for c in cuts]))


def _newton(source, starts: list[np.ndarray], seen: list[int | None], objective, steps: int = STEPS, flat: float = FLAT) -> list[np.ndarray]:
    """Minimise several convex objectives at once; each sees its half. objective(k, w, sums) -> (value, gradient, curvature).

    A step that does not lower the value is halved.
    """
    now, step, size = list(starts), [np.zeros_like(w) for w in starts], len(starts[0])
    held: list = [None] * len(starts)  # value at the last point taken
    open_ = set(range(len(starts)))
    for _ in range(steps):
        order = sorted(open_)
        for k, u in zip(order, _parts(source, [(seen[k], now[k] + step[k]) for k in order], size)):
            value, g, h = objective(k, now[k] + step[k], u)
            if held[k] is not None and value > held[k] + 1e-12:
                step[k] = step[k] / 2
                if np.abs(step[k]).max() < 1e-6:
                    open_.discard(k)
                continue
            now[k], held[k] = now[k] + step[k], value
            if np.abs(g).max() < flat:
                open_.discard(k)
            else:
                step[k] = -np.linalg.solve(h, g)
        if not open_:
            break
    return now


def _parts(source, models: list, size: int) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """Of unlabelled rows, by model: loss of "negative", gradient and curvature, as means."""
    out = []
    for row in source.sums(models):
        n, h = max(row[0], 1), np.zeros((size, size))
        h[np.triu_indices(size)] = row[2 + size :] / n
        out.append((row[1] / n, row[2 : 2 + size] / n, h + np.triu(h, 1).T))
    return out


def _fit(positive: np.ndarray, source) -> Model:
    size, keep = len(STATS) * BINS + 1, np.r_[np.ones(len(STATS) * BINS), 0.0]
    if not len(positive) or not source.n:
        return Model(np.zeros((len(STATS), BINS - 1)), np.zeros(size), 0.5)
    edges = source.quantiles(np.linspace(0, 1, BINS + 1)[1:-1])
    # extremes matter most for junk: the outer cuts are the positives' own tails
    tails = np.quantile(positive, [0.004, 0.02, 0.98, 0.996], axis=0).T
    edges = np.sort(np.hstack([edges[:, 2:-2], tails]), axis=1)
    source.bin(edges)
    xp = np.hstack([_binned(positive, edges), np.ones((len(positive), 1), np.float32)]).astype(float)
    ridge = L2 * np.diag(keep) + 1e-9 * np.eye(size)
    halved = min(len(positive), source.n) > 1
    own = [xp[k::2] if halved else xp for k in (0, 1)]

    def apart(k: int, w: np.ndarray, u: tuple) -> tuple:
        """Positives against unlabelled rows, each side with half the weight."""
        loss, g, h = u
        p = sigmoid(own[k] @ w)
        value = (np.logaddexp(0, -(own[k] @ w)).mean() + loss + L2 * (keep * w) @ w) / 2
        curve = (own[k].T * (p * (1 - p))) @ own[k] / len(p)
        return value, (own[k].T @ (p - 1) / len(p) + g) / 2 + L2 * keep * w, (curve + h) / 2 + ridge

    # fitted on one half, read off the other: scores of fitted rows would flatter the positives
    fitted = _newton(source, [np.zeros(size)] * 2, [0, 1] if halved else [None, None], apart)
    others = [own[1 - k] @ fitted[k] - fitted[k][-1] for k in (0, 1)]
    cuts = [np.quantile(o, np.linspace(0.0, 1 - PRIOR_REACH, 101)) for o in others]
    counts = source.above([(1 - k if halved else 0, fitted[k], cuts[k]) for k in (0, 1)])
    prior = np.mean([_least_ratio(np.array([(o >= c).mean() for c in cut]), row[:-1] / max(row[-1], 1)) for o, cut, row in zip(others, cuts, counts)])
    return Model(edges, np.round(_non_negative(xp, source, prior, ridge, keep), 9), float(prior))


def _non_negative(xp: np.ndarray, source, prior: float, ridge: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The weights of the least non-negative risk, P + max(0, R) with P = pi E_pos[l(+)] and R = E_unl[l(-)] - pi E_pos[l(-)].

    P + R is convex, as l(+) and l(-) of a row differ by its score, and so is the larger of P and P + R. Its minimum is
    that of P + lam R for some lam from 0 to 1, where R is zero unless lam is an end. R falls as lam grows.
    """
    w, last = np.zeros(xp.shape[1]), {}

    def weighted(lam: float):
        def risk(k: int, w: np.ndarray, u: tuple) -> tuple:
            loss, g, h = u
            z = xp @ w
            p = sigmoid(z)
            plus, minus = np.logaddexp(0, -z).mean(), np.logaddexp(0, z).mean()
            last[w.tobytes()] = loss - prior * minus
            curve = prior * (xp.T * (p * (1 - p))) @ xp / len(p)
            value = prior * plus + lam * (loss - prior * minus) + L2 / 2 * (keep * w) @ w
            return value, prior * xp.T @ (p - 1) / len(p) + lam * (g - prior * xp.T @ p / len(p)) + L2 * keep * w, lam * h + (1 - lam) * curve + ridge

        return risk

    def solved(lam: float, start: np.ndarray) -> tuple[np.ndarray, float]:
        last.clear()
        (w,) = _newton(source, [start], [None], weighted(lam))
        return w, last[w.tobytes()]

    w, part = solved(1.0, w)
    low, high, low_part, high_part = 0.0, 1.0, None, part
    for k in range(SPLITS):
        if high_part >= -NEGLIGIBLE:
            break
        # between two known ends by their line, and every third time, or before there are two, in the middle
        lam = (low + high) / 2 if low_part is None or k % 3 == 2 else low + (high - low) * low_part / (low_part - high_part)
        w, part = solved(lam, w)
        if abs(part) <= NEGLIGIBLE:
            break
        if part > 0:
            low, low_part = lam, part
        else:
            high, high_part = lam, part
    return w


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Fit on statistics of trusted positives and of unlabelled rows. Without either, every score is a half."""
    return _fit(positive, Rows(unlabelled))


def predict(x: np.ndarray, model: Model) -> np.ndarray:
    return sigmoid(_binned(x, model.edges) @ model.weights[:-1] + model.weights[-1]) if len(x) else np.zeros(0)


def _raw(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def train(docs: DataFrame, labels: DataFrame, trusted: Column, *, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES) -> Model:
    """Fit on labels rows where ``trusted`` holds, and on all documents whatever their labels.

    Of the trusted rows those of the smallest id hashes are taken, at most ``positives``; rows without an id can't be
    trusted. Every document counts as unlabelled, empty ones and repeated ones too.
    """
    arrow_limits(docs.sparkSession)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("half"), pa.array([stats(t) for t in _raw(batch.column("text"))], pa.list_(pa.float32()))], ["__id", "half", "x"])

    rows = docs.select(col(id_col).alias("__id"), F.pmod(F.xxhash64(col(id_col), F.length(col(text_col))), F.lit(2)).cast("int").alias("half"), col(text_col).alias("text"))
    source = Stored(materialize(rows.mapInArrow(measured, T.StructType([rows.schema["__id"], T.StructField("half", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType(), False))])), "quality-stats"))
    first = labels.where(trusted).select(col(id_col).alias("__id")).where("__id is not null").distinct().orderBy(F.xxhash64("__id")).limit(positives)
    picked = source.table.join(F.broadcast(first), "__id", "left_semi").select(F.xxhash64("__id").alias("__order"), "x").orderBy("__order", "x").limit(positives).collect()
    model = _fit(np.array([r["x"] for r in picked], float).reshape(len(picked), len(STATS)), source)
    source.close()
    return model


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Return docs with ``score`` (0 to 1), a row for each input row; null and empty texts are scored as of no words.

    Nothing but the text enters a score. A column of that name is replaced.
    """
    arrow_limits(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(predict(np.array([stats(t) for t in _raw(texts)], float).reshape(len(texts), len(STATS)), model), pa.float64())

    return docs.withColumn("score", scored(col(text_col)))
