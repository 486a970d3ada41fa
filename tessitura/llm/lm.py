"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

    P(word | history) = P(class | history) * P(slot | class, history) * P(word | slot)

Both softmaxes are log-linear in the same hashed features of the history: the last word, the last two, and the words
two and three back (skips). The first has a weight row a feature; the second a row for each feature and class. Classes
group frequent words that follow alike words and are spelled alike. A class has SLOTS - 1 slots of one word each, its
most frequent ones, and one of all its others, which share it by their counts. One class stands for all words outside
the vocabulary, which are spelled byte by byte, so every text has a probability.

Word counts cover all training documents. The feature weights are trained in synchronous rounds: each round reads
another part of the texts, every partition of it makes gradient updates from the same start, and the weights are
averaged by the tokens they saw and start the next round. Scoring adds weight rows picked by feature number (sparse)
in blocks of numpy. Texts are cut into words once and stored as word numbers, which the passes for classes, training
and scoring read.

The base score is add-one unigram. The counts of the ``TOP`` most frequent words go to the tasks; the words of a
text that are not among these are joined with the full count table, so it is exact at any vocabulary size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm._shared import arrow_limits, col, materialize

END = b""  # the token after a text's last word; no word is empty
TOP = 200_000
VOCABULARY = 20_000  # of the top words, those that have a class of their own kind
CLUSTERED, ANCHORS, REACH = 8_000, 32, 3  # words whose neighbours are counted: the ANCHORS most frequent words up to REACH before them
BY_NAME = 2_000  # of these, those that are features by name; others are features by their last 3 bytes
CLASSES, OTHER, CLOSING = 32, 0, 1
SLOTS = 32
BUCKETS_LOG2, FEATURES = 13, 4  # of both tables, unless the call says otherwise
BLOCK = 8192  # tokens of a gradient update, and of a scoring step
RATE, ROUNDS, LIMIT = 0.1, 3, 15.0  # LIMIT: of a weight, so that no exponential overflows
NEVER = -30.0  # log share of a slot that has no word
SPELL_LOG2, SYMBOLS, ORDERS = 14, 64, (5, 3, 1)
FLUSH = 400_000
_PARTS = 8  # a weight table travels in so many pieces


def words(text: bytes | None) -> list[bytes]:
    """A-Z lowered, split on 0x20 and 0x09-0x0D, then the end."""
    return (text.lower().split() if text else []) + [END]


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _strings(found: list[bytes]) -> pa.Array:
    """Words as strings, unchecked: what comes from Spark goes back as it was, be it UTF-8 or not."""
    return pa.array(found, pa.binary()).view(pa.string())


def count_words(texts: DataFrame) -> DataFrame:
    """Store and return ``word, n`` of a one-column table of texts: counted in the tasks, then summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = list(counts), list(counts.values())
            for i in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([_strings(found[i : i + 50_000]), pa.array(n[i : i + 50_000], pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for text in _raw(batch.column(0)):
                counts.update(words(text))
            if len(counts) > FLUSH:
                yield from flush()
        yield from flush()

    return materialize(texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


def _summed(partial: DataFrame, label: str) -> dict[int, np.ndarray]:
    """Sum float32 pieces (part int, payload binary) by part, streaming; the pieces of one table reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(payload, np.float32).astype(np.float64)
                sums[part] = sums[part] + piece if part in sums else piece
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "payload"])

    # two steps, so that no task receives a piece from every other: with lanes by the root of their number, each
    # task sums as many as a lane has, and then as many as there are lanes
    laned = partial.repartition("lane", "part").mapInArrow(_narrowed(run), "part int, payload binary")
    rows = materialize(laned, label).repartition("part").mapInArrow(_doubles, "part int, payload binary").collect()
    return {r["part"]: np.frombuffer(r["payload"], np.float64) for r in rows}


def _narrowed(run):
    def inner(batches):
        return run(b.select(["part", "payload"]) for b in batches)

    return inner


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            piece = np.frombuffer(payload, np.float64)
            sums[part] = sums[part] + piece if part in sums else piece
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "payload"])


def _pieces(table: np.ndarray, parts: int, extra: float, lanes: int) -> pa.RecordBatch:
    """A table cut in parts, and one part more that holds a single number; the lane spreads the first sums."""
    cut = [p.astype(np.float32).tobytes() for p in np.array_split(table.ravel(), parts)] + [np.array([extra], np.float32).tobytes()]
    lane = (TaskContext.get().partitionId() if TaskContext.get() else 0) % lanes
    return pa.RecordBatch.from_arrays([pa.array([lane] * (parts + 1), pa.int32()), pa.array(range(parts + 1), pa.int32()), pa.array(cut, pa.binary())], names=["lane", "part", "payload"])


class Spelling(NamedTuple):
    """Byte model of words: hashed orders, each backed off to the next by its number of distinct continuations."""

    symbol: np.ndarray  # of each byte; digits share one, and so do rare bytes
    share: np.ndarray  # log10 probability of each byte given its symbol
    own: list[np.ndarray]  # by order, [context, symbol]: probability that isn't backed off
    back: list[np.ndarray]  # by order, [context]: weight of the next order
    overall: np.ndarray  # of the symbols, what the last order backs off to


def _contexts(found: list[bytes], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all bytes of the words and their closings: byte, symbol, contexts by order; and where each word begins."""
    flat = np.frombuffer(b" ".join(found) + b" ", np.uint8)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    begins = np.cumsum(size) - size
    at = np.arange(len(flat)) - np.repeat(begins, size)
    s = symbol[flat].astype(np.uint64)
    number, by_order = np.zeros(len(flat), np.uint64), {}
    for k in range(1, max(ORDERS) + 1):
        number = number << np.uint64(6) | np.where(at >= k, np.roll(s, k), np.uint64(SYMBOLS - 1))
        by_order[k] = ((number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SPELL_LOG2)).astype(np.int64)
    return flat, s.astype(np.int64), [by_order[k] for k in ORDERS], begins


def alphabet(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the most frequent bytes, one for digits, one for all others, and the last for 0x20, which closes a word."""
    seen = np.bincount(np.frombuffer(b"".join(found), np.uint8), minlength=256)
    seen[32] = -1
    ranked = np.argsort(-seen, kind="stable")
    digits = list(b"0123456789")
    seen[digits] = -1
    ranked = np.argsort(-seen, kind="stable")[: SYMBOLS - 3]
    symbol, share = np.full(256, SYMBOLS - 2), np.full(256, -np.log10(256 - (SYMBOLS - 3) - 11))
    symbol[ranked], share[ranked] = np.arange(len(ranked)), 0.0
    symbol[digits], share[digits] = SYMBOLS - 3, -1.0
    symbol[32], share[32] = SYMBOLS - 1, 0.0
    return symbol, share


def train_spelling(counts: DataFrame, known: set[bytes], symbol: np.ndarray, share: np.ndarray) -> Spelling:
    """From each distinct training word outside the vocabulary, once. Only the tables' filled cells are shuffled."""
    shipped = counts.sparkSession.sparkContext.broadcast((known, symbol))
    cells = SYMBOLS << SPELL_LOG2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, symbol = shipped.value
        seen = np.zeros(len(ORDERS) * cells, np.int32)
        for batch in batches:
            if found := [w for w in _raw(batch.column(0)) if w not in known]:
                _, s, contexts, _ = _contexts(found, symbol)
                for at, context in zip(range(0, len(seen), cells), contexts):
                    seen[at : at + cells] += np.bincount(context * SYMBOLS + s, minlength=cells).astype(np.int32)
        filled = np.flatnonzero(seen)
        for i in range(0, len(filled), 100_000):
            some = filled[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some].astype(np.int64))], names=["cell", "n"])

    found = counts.select("word").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(ORDERS) * cells)
    seen[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return spelling_model(seen.reshape(len(ORDERS), -1, SYMBOLS), symbol, share)


def spelling_model(seen: np.ndarray, symbol: np.ndarray, share: np.ndarray) -> Spelling:
    """From counts [order, context, symbol]."""
    overall = 0.9 * (seen[-1].sum(axis=0) + 1) / (seen[-1].sum() + SYMBOLS) + 0.1 / SYMBOLS
    own, back = [], []
    for order in seen:
        kinds = np.maximum((order > 0).sum(axis=1), 1)
        total = order.sum(axis=1) + kinds
        own.append((order / total[:, None]).astype(np.float32))
        back.append((kinds / total).astype(np.float32))
    return Spelling(symbol, share, own, back, overall)


def spell(found: list[bytes], model: Spelling) -> np.ndarray:
    """log10 probability of each word's bytes and its closing."""
    if not found:
        return np.zeros(0)
    flat, s, contexts, begins = _contexts(found, model.symbol)
    p = model.overall[s]
    for own, back, context in list(zip(model.own, model.back, contexts))[::-1]:
        p = own[context, s] + back[context] * p
    return np.add.reduceat(np.log10(p) + model.share[flat], begins)


class Lexicon(NamedTuple):
    total: int  # N: training tokens
    distinct: int  # V: distinct training tokens
    top: list[bytes]  # END, then the most frequent words
    counts: np.ndarray  # theirs


class Model(NamedTuple):
    total: int
    distinct: int
    counts: np.ndarray
    classes: np.ndarray  # class of each top word
    slots: np.ndarray  # slot of each top word in its class; -1 in the classes that have none
    within: np.ndarray  # log10 P(word | slot) of each top word; without slots, P(word | class)
    feature: np.ndarray  # history number of each top word
    bias: np.ndarray  # log P(class) before training
    weights: np.ndarray  # buckets x classes
    slot_bias: np.ndarray  # classes x slots: log P(slot | class) before training
    slot_weights: np.ndarray  # buckets x slots, a bucket for each feature and class
    spelling: Spelling
    seen: float  # P(a word | class OTHER) of a word counted once, not counting its spelling
    novel: float  # share of class OTHER that is spelled


def lexicon(counts: DataFrame, top: int = TOP) -> Lexicon:
    """The driver receives the ``top`` most frequent words."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rows = counts.where("word <> ''").orderBy(F.desc("n"), "word").limit(top).toArrow()
    end = counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = [END] + rows.column("word").cast(pa.binary()).to_pylist()
    return Lexicon(total, distinct, found, np.r_[float(end), rows.column("n").to_numpy().astype(float)])


def encode(docs: DataFrame, words_of: Lexicon, learn_from: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store and return ``row, __id, learn, ids, rare``, a row a text.

    ids: the numbers of its words in the lexicon as int32 bytes, -1 for others; rare: those others, in order. row: a
    number of the row, unique in this table.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(words_of.top)
    source = docs.select(col(id_col).alias("__id"), col(text_col).alias("__text"), F.coalesce(learn_from, F.lit(False)).alias("learn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, row = {w: i for i, w in enumerate(shipped.value)}, TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            found, ends = [], [0]
            for text in _raw(batch.column(1)):
                found += words(text)
                ends.append(len(found))
            ids = np.fromiter(map(index.get, found, repeat(-1)), np.int32, len(found))
            new = np.flatnonzero(ids < 0)
            rare = _strings([found[i] for i in new.tolist()])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(new, ends).astype(np.int32)), rare)
            raw = ids.tobytes()
            pieces = pa.array([raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], pa.binary())
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(2), pieces, rare], names=["row", "__id", "learn", "ids", "rare"])

    kind = source.schema["__id"].dataType.simpleString()
    return materialize(source.mapInArrow(run, f"row long, __id {kind}, learn boolean, ids binary, rare array<string>"), "lm-tokens")


def _flat(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All word numbers of a column of ids, and the lengths of its texts."""
    raw = pieces.to_pylist()
    return np.frombuffer(b"".join(raw), np.int32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4


def _before(at: np.ndarray, values: np.ndarray, k: int, none) -> np.ndarray:
    """The value k places back in the same text."""
    return np.where(at >= k, np.roll(values, k), none)


def _places(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def neighbour_counts(tokens: DataFrame, rows: int) -> np.ndarray:
    """[word, anchor]: how often each of the first CLUSTERED words has each anchor up to REACH places before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLUSTERED * ANCHORS, np.int64)
        for batch in batches:
            ids, lengths = _flat(batch.column(0))
            at = _places(lengths)
            for k in range(1, REACH + 1):
                before = _before(at, ids, k, -1)
                use = (ids > 0) & (ids <= CLUSTERED) & (before > 0) & (before <= ANCHORS)
                seen += np.bincount((ids[use] - 1) * ANCHORS + before[use] - 1, minlength=len(seen))
        filled = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(seen[filled])], names=["cell", "n"])

    found = tokens.where("learn").select("ids").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(CLUSTERED * ANCHORS)
    seen[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return seen.reshape(CLUSTERED, ANCHORS)[:rows]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def _group(found: list[bytes], counts: np.ndarray, neighbours: np.ndarray, groups: int) -> np.ndarray:
    """Spherical k-means by neighbours and hashed byte pairs, from evenly spaced ranks; the same input, the same groups.

    Words after the counted ones join the group whose spelling is nearest.
    """
    if len(found) <= groups:
        return np.arange(len(found))
    spelled = np.zeros((len(found), 128), np.float32)
    for i, w in enumerate(found):
        padded = b"^" + w + b"$"
        for a, b in zip(padded, padded[1:]):
            spelled[i, (a * 31 + b * 17) % 128] += 1
    spelled = _unit(spelled)
    m = len(neighbours)
    share = neighbours / np.sqrt(neighbours.sum(axis=0) + 1)
    x = _unit(np.hstack([0.5 * spelled[:m], _unit(share.astype(np.float32))]))
    if m <= groups:
        x, m = spelled, len(found)
    weight = np.sqrt(counts[:m])[:, None].astype(np.float32)
    centre = x[np.linspace(0, m - 1, groups).astype(int)]
    near = None
    for _ in range(12):
        near = (x @ centre.T).argmax(axis=1)
        centre = _unit(np.stack([(x * weight)[near == g].sum(axis=0) if (near == g).any() else centre[g] for g in range(groups)]))
    near = (x @ centre.T).argmax(axis=1)
    alike = _unit(np.stack([(spelled[:m] * weight)[near == g].sum(axis=0) for g in range(groups)]))
    return np.r_[near, (spelled[m:] @ alike.T).argmax(axis=1)]


def _history(found: list[bytes], named: bool) -> np.ndarray:
    return np.array([zlib.crc32(w if named else b"~" + w[-3:]) for w in found], np.uint64).reshape(-1)


def start_model(counts: DataFrame, known: Lexicon, tokens: DataFrame, *, vocabulary: int = VOCABULARY, buckets_log2: int = BUCKETS_LOG2) -> Model:
    """The untrained model: classes, counts within them, and spelling."""
    found, n = known.top, known.counts
    v = min(vocabulary, len(found))
    classes = np.full(len(found), OTHER)
    classes[0] = CLOSING
    if v > 1:
        classes[1:v] = 2 + _group(found[1:v], n[1:v], neighbour_counts(tokens, min(CLUSTERED, v - 1)), CLASSES - 2)
    mass = np.bincount(classes[:v], weights=n[:v], minlength=CLASSES)
    mass[OTHER] = known.total - n[:v].sum()
    # of class OTHER, the share of words met once is that of words not met before (Good and Turing)
    once = counts.where("n = 1 and word <> ''").count() - int((n[1:v] == 1).sum())
    novel = float(np.clip(once / mass[OTHER], 0.01, 0.99)) if mass[OTHER] > 0 else 1.0
    seen = (1 - novel) / mass[OTHER] if mass[OTHER] > 0 else 0.0
    spelling = train_spelling(counts, set(found[:v]), *alphabet(found))
    slots, within, slot_bias = np.full(len(found), -1), np.zeros(len(found)), np.zeros((CLASSES, SLOTS))
    for c in range(2, CLASSES):
        members = np.flatnonzero(classes == c)  # in order of count
        slots[members] = np.minimum(np.arange(len(members)), SLOTS - 1)
        sums = np.bincount(slots[members], weights=n[members], minlength=SLOTS)
        within[members] = np.log10(n[members] / sums[slots[members]])
        slot_bias[c] = np.where(sums > 0, np.log(np.maximum(sums, 1) / max(sums.sum(), 1)), NEVER)
    for i in range(v, len(found), 20_000):
        j = min(i + 20_000, len(found))
        within[i:j] = np.log10(seen * n[i:j] + novel * 10.0 ** spell(found[i:j], spelling))
    named = min(BY_NAME, v)
    feature = np.r_[_history(found[:named], True), _history(found[named:], False)]
    bias = np.log((mass + 1) / (known.total + CLASSES))
    empty = lambda width: np.zeros((1 << buckets_log2, width), np.float32)
    return Model(known.total, known.distinct, n, classes, slots, within, feature, bias, empty(CLASSES), slot_bias.astype(np.float32), empty(SLOTS), spelling, seen, novel)


def _histories(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit numbers of the features of each token's history, FEATURES rows."""
    at = _places(lengths)
    one, two, three = (_before(at, numbers, k, np.uint64(0)) for k in (1, 2, 3))
    mixed = np.stack([one + np.uint64(1) << np.uint64(34), (one << np.uint64(31)) + two + (np.uint64(1) << np.uint64(63)), two + (np.uint64(5) << np.uint64(40)), three + (np.uint64(9) << np.uint64(40))])
    return (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _buckets(histories: np.ndarray, buckets: int, classes: np.ndarray | None = None) -> np.ndarray:
    """Weight rows of features, or of features in a class."""
    if classes is not None:
        histories = (histories ^ (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0x94D049BB133111EB)
    return (histories >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.intp)


def _exponentials(w: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """exp of bias plus the weights of each token's features; weights stay within LIMIT, so it can't overflow."""
    z = w.take(features[0], axis=0)
    for f in features[1:]:
        z += w.take(f, axis=0)
    z += bias
    return np.exp(z, out=z)


def log_softmax(w: np.ndarray, bias: np.ndarray, features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of outcome y of each token; bias is a row for all tokens or one for each."""
    out = np.empty(len(y))
    for i in range(0, len(y), BLOCK):
        j = min(i + BLOCK, len(y))
        z = _exponentials(w, bias[i:j] if bias.ndim == 2 else bias, features[:, i:j])
        out[i:j] = np.log(z[np.arange(j - i), y[i:j]] / z.sum(axis=1))
    return out


def gradient_step(w: np.ndarray, squares: np.ndarray, bias: np.ndarray, features: np.ndarray, y: np.ndarray) -> None:
    """One Adagrad update of w, in place, by the summed gradient of -log P(y) over the tokens."""
    z = _exponentials(w, bias, features)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(y)), y] -= 1
    sums = np.empty((w.shape[1], len(w)))
    for k, column in enumerate(z.T.astype(np.float64, order="C")):  # by weight row, an outcome at a time
        sums[k] = np.bincount(features[0], weights=column, minlength=len(w))
        for f in features[1:]:
            sums[k] += np.bincount(f, weights=column, minlength=len(w))
    g = sums.T.astype(np.float32, order="C")
    squares += g * g
    w -= RATE * g / np.sqrt(squares)
    np.clip(w, -LIMIT, LIMIT, out=w)


class Scorer:
    """A model in a task."""

    def __init__(self, model: Model):
        self.model = model
        self.log_count = np.log10((model.counts + 1) / (model.total + model.distinct + 1))

    def flat(self, pieces: pa.Array, rare: list[bytes]):
        """Word numbers, text lengths, histories, classes and slots of a batch; rare: its words that have no number."""
        ids, lengths = _flat(pieces)
        numbers = self.model.feature.take(ids, mode="wrap")  # -1 picks some number; mended next
        new = ids < 0
        numbers[new] = _history(rare, False)
        return ids, lengths, _histories(numbers, lengths), np.where(new, OTHER, self.model.classes.take(ids, mode="wrap")), np.where(new, -1, self.model.slots.take(ids, mode="wrap"))

    def log_class(self, histories: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural log P(class | history) of each token's class."""
        m = self.model
        return log_softmax(m.weights, m.bias.astype(np.float32), _buckets(histories, len(m.weights)), classes)

    def log_slot(self, histories: np.ndarray, classes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Natural log P(slot | class, history) of each token's slot; 0 in classes without slots."""
        m, out = self.model, np.zeros(len(slots))
        some = np.flatnonzero(slots >= 0)
        of = classes[some]
        out[some] = log_softmax(m.slot_weights, m.slot_bias.take(of, axis=0), _buckets(histories[:, some], len(m.slot_weights), of), slots[some])
        return out

    def score(self, pieces: pa.Array, rare: list[bytes]):
        """Per text: tokens, known top tokens, base score of top tokens, model score without P(word | class) of the
        rare tokens; and the rare words' log10 probabilities of spelling."""
        ids, lengths, histories, classes, slots = self.flat(pieces, rare)
        begins = np.cumsum(lengths) - lengths
        logs = self.log_class(histories, classes) + self.log_slot(histories, classes, slots)
        scores = np.add.reduceat(logs / np.log(10) + np.where(ids < 0, 0.0, self.model.within[ids]), begins)
        base = np.where(ids < 0, 0.0, self.log_count[ids])
        known = (ids >= 0) & (self.model.counts[ids] > 0)
        distinct = sorted(set(rare))
        spelled = dict(zip(distinct, spell(distinct, self.model.spelling).tolist()))
        return lengths, np.add.reduceat(known.astype(np.int64), begins), np.add.reduceat(base, begins), scores, [spelled[w] for w in rare]


def _rare(column: pa.Array) -> list[bytes]:
    return column.flatten().cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def learn(model: Model, batches: Iterator[tuple[pa.Array, list[bytes]]]) -> tuple[Model, int]:
    """Gradient updates over batches of (word numbers, rare words): a model of own weights, and the tokens seen."""
    own = model._replace(weights=model.weights.copy(), slot_weights=model.slot_weights.copy())
    scorer, bias, seen = Scorer(own), model.bias.astype(np.float32), 0
    squares, slot_squares = np.full(own.weights.shape, 1e-2, np.float32), np.full(own.slot_weights.shape, 1e-2, np.float32)
    for pieces, rare in batches:
        *_, histories, classes, slots = scorer.flat(pieces, rare)
        for i in range(0, len(classes), BLOCK):
            h, c, s = histories[:, i : i + BLOCK], classes[i : i + BLOCK], slots[i : i + BLOCK]
            gradient_step(own.weights, squares, bias, _buckets(h, len(own.weights)), c)
            some = np.flatnonzero(s >= 0)
            of = c[some]
            if len(some):
                gradient_step(own.slot_weights, slot_squares, own.slot_bias.take(of, axis=0), _buckets(h[:, some], len(own.slot_weights), of), s[some])
            seen += len(c)
    return own, seen


def train(tokens: DataFrame, model: Model, *, rounds: int = ROUNDS) -> Model:
    """Rounds of Adagrad in every partition at once, each over other files of the stored tokens and from the average
    of the round before; together they read every text to learn from once."""
    spark, files = tokens.sparkSession, sorted(tokens.inputFiles())
    for k in range(min(rounds, len(files))):
        texts = spark.read.schema(tokens.schema).parquet(*files[k::rounds]).where("learn").select("ids", "rare")
        lanes = max(1, math.isqrt(texts.rdd.getNumPartitions()))
        shipped = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, lanes=lanes) -> Iterator[pa.RecordBatch]:
            own, seen = learn(shipped.value, ((b.column(0), _rare(b.column(1))) for b in batches))
            if seen:
                yield _pieces(np.concatenate([own.weights.ravel(), own.slot_weights.ravel()]) * seen, _PARTS, seen, lanes)

        sums = _summed(texts.mapInArrow(run, "lane int, part int, payload binary"), "lm-weights")
        shipped.destroy()
        if not sums or sums[_PARTS][0] == 0:
            continue
        both = (np.concatenate([sums[i] for i in range(_PARTS)]) / sums[_PARTS][0]).astype(np.float32)
        cut = model.weights.size
        model = model._replace(weights=both[:cut].reshape(model.weights.shape), slot_weights=both[cut:].reshape(model.slot_weights.shape))
    return model


def score_documents(docs: DataFrame, learn_from: Column, *, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, vocabulary: int = VOCABULARY, buckets_log2: int = BUCKETS_LOG2, rounds: int = ROUNDS) -> DataFrame:
    """Return ``id_col, n_tokens, n_known, train_tokens, base_score, score``, a row for each input row.

    The model learns from the rows where learn_from holds (a null counts as false). Null and empty texts are the end
    token alone. n_known: tokens that occur in training texts; scores are log10 probabilities of the whole text.
    Repeated rows are scored alike; an empty table gives an empty result; other columns of docs are ignored. With
    nothing to learn from, the base score of a text is 0 and the model spells all words evenly.
    """
    spark = docs.sparkSession
    arrow_limits(spark, rows=1000, mb=2)
    counts = count_words(docs.where(learn_from).select(col(text_col).alias("__text")))
    known = lexicon(counts, top)
    tokens = encode(docs, known, learn_from, id_col, text_col)
    model = train(tokens, start_model(counts, known, tokens, vocabulary=vocabulary, buckets_log2=buckets_log2), rounds=rounds)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            rare = _rare(batch.column(3))
            n, known, base, score, spelled = scorer.score(batch.column(2), rare)
            pairs = pa.StructArray.from_arrays([_strings(rare), pa.array(spelled, pa.float64())], ["word", "spelled"])
            cuts = np.r_[0, np.cumsum(pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(cuts), pairs)], names=["row", "__id", "n", "known", "base", "score", "rare"])

    kind = tokens.schema["__id"].dataType.simpleString()
    scored = materialize(tokens.select("row", "__id", "ids", "rare").mapInArrow(run, f"row long, __id {kind}, n long, known long, base double, score double, rare array<struct<word:string,spelled:double>>"), "lm-scores")
    # the words that the tasks had no count of: joined with all counts, summed by row
    rare = scored.select("row", F.inline("rare"))
    n = F.coalesce("n", F.lit(0))
    met = rare.join(counts, "word", "left").groupBy("row").agg(
        F.count("n").alias("more_known"),
        F.sum(F.log10((n + 1) / F.lit(float(model.total + model.distinct + 1)))).alias("more_base"),
        F.sum(F.log10(n * F.lit(model.seen) + F.lit(model.novel) * F.pow(F.lit(10.0), "spelled"))).alias("more_score"),
    )
    zero = F.lit(0.0)
    return scored.drop("rare").join(met, "row", "left").select(
        F.col("__id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
