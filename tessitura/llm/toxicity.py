"""Toxicity by a classifier chain: one linear model a category, each fed the earlier categories' probabilities.

Labels say only whether a text is toxic. The categories are found in the toxic rows themselves: spherical k-means
of their feature vectors groups toxic texts that use alike words, whatever the language, and each group, the
largest first, is a link of the chain. The last link is toxicity, from the labels alone. Later links are trained on
out-of-fold probabilities of the earlier ones, as they meet unseen texts when scoring. Features are the presence
of words and of word beginnings that are much more frequent in the link's positive rows than in the rest.

Fitting uses a bounded sample of labelled rows. Their features are counted on the executors; the driver receives
the CANDIDATES that tell the classes apart best, and of each row the numbers of those it has, however long its text.
Every whole text is scored, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm._linear import logistic, sigmoid
from tessitura.llm._shared import arrow_limits, col, discard, materialize
from tessitura.llm.decontamination import words

CATEGORIES = ("category_1", "category_2", "category_3")
LINKS = (*CATEGORIES, "toxic")
#: At most so many labelled ids of each class are fitted on, the first by a hash of the id.
ROWS_PER_CLASS = 3000
FOLDS = 3
CANDIDATES = 3000  # features that reach the driver, at most
FEATURES = 1500  # at most, a link
LEAST_DF = 3  # positive rows that must have a feature
ODDS = 12.0  # times as frequent in positive rows as in others
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5


class Sample(NamedTuple):
    names: list[bytes]  # of the candidate features
    has: np.ndarray  # rows x candidates, bool
    toxic: np.ndarray  # bool


class Link(NamedTuple):
    name: str
    words: dict[bytes, float]
    weights_before: list[float]
    intercept: float


def features(found: set[bytes]) -> set[bytes]:
    """Presence features: the words, and the beginnings of longer words, marked by a slash."""
    out = set(found)
    for n in PREFIXES:
        out |= {w[:n] + b"/" for w in found if len(w) > n}
    return out


def _select(has: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns over ODDS times as frequent in the positive rows as in the others, the most telling first by number."""
    hot, cold = has[y].sum(axis=0), has[~y].sum(axis=0)
    odds = ((hot + 0.5) / (y.sum() + 1)) / ((cold + 0.5) / ((~y).sum() + 1))
    use = np.flatnonzero((hot >= LEAST_DF) & (odds >= ODDS))
    return np.sort(use[np.lexsort((use, -hot[use] * np.log(odds[use])))][:FEATURES])


def _fit_link(has: np.ndarray, y: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen columns, and weights of those, of the earlier probabilities and of the intercept, in this order."""
    chosen = _select(has, y)
    return chosen, logistic(np.hstack([has[:, chosen].astype(np.float32), before]), y.astype(float))


def _predict(has: np.ndarray, before: np.ndarray, chosen: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(np.hstack([has[:, chosen].astype(np.float32), before]) @ w[:-1] + w[-1])


def groups(has: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means of the rows, the largest group numbered 0; rows without a feature are in none (-1).

    It starts from the row nearest to the mean and then from those farthest from all chosen; the same rows in the same
    order give the same groups.
    """
    out = np.full(len(has), -1)
    some = np.flatnonzero(has.any(axis=1))
    if not len(some):
        return out
    x = has[some].astype(np.float32)
    x *= np.log(len(some) / x.sum(axis=0).clip(1)) + 0.1  # what all have says little
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centres = [x[int((x @ x.mean(axis=0)).argmax())]]
    while len(centres) < min(k, len(some)):
        centres.append(x[int((x @ np.stack(centres).T).max(axis=1).argmin())])
    centre = np.stack(centres)
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        sums = np.stack([x[near == g].sum(axis=0) if (near == g).any() else centre[g] for g in range(len(centre))])
        centre = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9)
    near = (x @ centre.T).argmax(axis=1)
    order = np.argsort(-np.bincount(near, minlength=len(centre)), kind="stable")
    out[some] = np.argsort(order)[near]
    return out


def fit(sample: Sample) -> list[Link]:
    """Fit the chain. A link without a positive row, or without another, gives all rows its only class."""
    has, toxic = sample.has, sample.toxic
    n, fold = len(has), np.arange(len(has)) % FOLDS
    group = np.full(n, -1)
    group[toxic] = groups(has[toxic], len(CATEGORIES))
    links, before = [], np.zeros((n, 0), np.float32)
    for number, name in enumerate(LINKS):
        y = toxic if name == LINKS[-1] else group == number
        if not n or not y.any() or y.all():
            only = float(bool(n) and bool(y.all()))
            links.append(Link(name, {}, [0.0] * before.shape[1], 30.0 if only else -30.0))
            before = np.hstack([before, np.full((n, 1), only, np.float32)])
            continue
        chosen, w = _fit_link(has, y, before)
        links.append(Link(name, {sample.names[c]: float(v) for c, v in zip(chosen.tolist(), w)}, w[len(chosen) : -1].tolist(), float(w[-1])))
        held = np.zeros(n)
        for k in range(FOLDS):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(train) and len(test):
                held[test] = _predict(has[test], before[test], *_fit_link(has[train], y[train], before[train]))
        before = np.hstack([before, held[:, None].astype(np.float32)])
    return links


def score(text: bytes | None, links: list[Link], known: set[bytes], marked: list[set[bytes]]) -> list[float]:
    found = set(words(text))
    present = found & known
    for n, some in zip(PREFIXES, marked):
        present |= {p + b"/" for p in {w[:n] for w in found if len(w) > n} & some}
    listed = sorted(present)
    out: list[float] = []
    for link in links:
        z = link.intercept + sum(link.words.get(f, 0.0) for f in listed) + sum(a * b for a, b in zip(link.weights_before, out))
        out.append(float(sigmoid(z)))
    return out


def _raw(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def sample_labelled(docs: DataFrame, labels: DataFrame, *, rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Sample:
    """The labelled sample: at most rows_per_class ids of either class, one text an id (the one whose hash is lowest)."""
    spark = docs.sparkSession
    arrow_limits(spark)
    label = col(label_col).cast("int")
    usable = labels.select(col(id_col).alias("__id"), label.alias("__label")).where("__id is not null and __label in (0, 1)").distinct()
    first = lambda value: usable.where(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(rows_per_class)
    ids = first(1).unionByName(first(0))
    # the lowest text hash of each id, at most 2 * rows_per_class rows, and then those texts
    hashed = docs.select(col(id_col).alias("__id"), F.xxhash64(col(text_col)).alias("__hash"))
    picked = materialize(hashed.join(F.broadcast(ids), "__id").groupBy("__id", "__label").agg(F.min("__hash").alias("__hash")), "toxicity-ids")
    texts = docs.select(col(id_col).alias("__id"), F.xxhash64(col(text_col)).alias("__hash"), col(text_col).alias("__text")).join(F.broadcast(picked), ["__id", "__hash"])

    @F.arrow_udf("array<binary>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(features(set(words(t)))) for t in _raw(texts)], pa.list_(pa.binary()))

    rows = materialize(texts.dropDuplicates(["__id", "__label"]).select("__id", "__label", found("__text").alias("__features")), "toxicity-features")
    sizes = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot, cold = F.sum("__label"), F.sum(1 - F.col("__label"))
    counts = rows.select("__label", F.explode("__features").alias("f")).groupBy("f").agg(hot.alias("hot"), cold.alias("cold"))
    odds = ((F.col("hot") + 0.5) / (sizes.get(1, 0) + 1)) / ((F.col("cold") + 0.5) / (sizes.get(0, 0) + 1))
    best = counts.where((F.col("hot") >= LEAST_DF) & (odds >= ODDS)).orderBy(F.desc(F.col("hot") * F.log(odds)), "f").limit(CANDIDATES)
    names = [bytes(r["f"]) for r in best.select("f").collect()]
    number = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = number.value
        for batch in batches:
            listed = [[of[f] for f in row if f in of] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(listed, pa.list_(pa.int32()))], names=["order", "label", "has"])

    got = rows.select(F.xxhash64("__id", "__label"), "__label", "__features").mapInArrow(numbered, "order long, label int, has array<int>").collect()
    got.sort(key=lambda r: (r["order"], r["has"]))
    for stored in (picked, rows):
        discard(stored)
    has = np.zeros((len(got), len(names)), bool)
    for i, r in enumerate(got):
        has[i, r["has"]] = True
    return Sample(names, has, np.array([r["label"] == 1 for r in got], bool))


def score_documents(docs: DataFrame, links: list[Link], *, text_col: str = "text") -> DataFrame:
    """Return docs with ``toxicity``: a struct of the categories' probabilities, in chain order, toxic last.

    A null or empty text has no features and gets the intercepts' probabilities. A column of that name is replaced.
    """
    arrow_limits(docs.sparkSession)
    known = {w for link in links for w in link.words}
    marked = [{w[:-1] for w in known if w.endswith(b"/") and len(w) == n + 1} for n in PREFIXES]
    fields = [(link.name, pa.float64()) for link in links]

    @F.arrow_udf(", ".join(f"{link.name} double" for link in links))
    def scored(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
        rows = [score(t, links, known, marked) for t in raw]
        return pa.array([dict(zip((n for n, _ in fields), r)) for r in rows], pa.struct(fields))

    return docs.withColumn("toxicity", scored(col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """Fit on the labels and return docs with ``toxicity`` and ``is_toxic`` (boolean), a row for each input row.

    Empty labels, or labels of one class only, give that class to all. Labels with a null id or class are not used.
    """
    links = fit(sample_labelled(docs, labels, rows_per_class=rows_per_class, id_col=id_col, text_col=text_col))
    return score_documents(docs, links, text_col=text_col).withColumn("is_toxic", F.col("toxicity.toxic") >= THRESHOLD)
