"""Benchmark decontamination over a positional inverted index of the training text.

The corpus is indexed once, in segments of about a million words (whole documents): for every term of a segment
the sorted list of its word positions, stored as one row of the index table. A benchmark window is looked up in a
segment by intersecting its terms' lists, each shifted by the term's offset in the window, from the rarest term on;
most windows end at a term the segment lacks. Nothing is shuffled, and the stored index serves later benchmarks.
The benchmark goes to the tasks in chunks of bounded size, each searched in a pass over the index.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm._shared import arrow_limits, col, discard, materialize, whole_row

WINDOW = 10
SEGMENT_WORDS = 1 << 20
#: Words of benchmark text sent to the tasks at once; a larger benchmark takes more passes over the index.
CHUNK_WORDS = 1 << 19

#: A-Z to lower case; every other ASCII character that is no digit or letter to a space; bytes of longer characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Store and return the index, a row a segment: its ids, document lengths, terms, and postings of every term."""
    arrow_limits(docs.sparkSession)
    source = docs.select(col(id_col).alias("__id"), col(text_col).alias("__text"))
    kind = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, parts, size, terms = [], [], [], 0, defaultdict(itertools.count().__next__)
        id_type = None

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            postings = np.argsort(flat, kind="stable").astype(np.int32)
            counts = np.bincount(flat, minlength=len(terms)).astype(np.int32)
            row = [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(id_type))]
            row += [pa.array([x], pa.binary()) for x in (np.array(lengths, np.int32).tobytes(), b" ".join(terms), counts.tobytes(), postings.tobytes())]
            return pa.RecordBatch.from_arrays(row, names=["segment", "ids", "lengths", "terms", "counts", "postings"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for one, text in zip(batch.column(0).to_pylist(), _binary(batch.column(1))):
                found = words(text)
                ids.append(one)
                lengths.append(len(found))
                parts.append(np.fromiter(map(terms.__getitem__, found), np.int32, len(found)))
                size += len(found)
                if size >= segment_words or len(ids) >= segment_words:
                    yield flush()
                    ids, lengths, parts, size, terms = [], [], [], 0, defaultdict(itertools.count().__next__)
        if ids:
            yield flush()

    index = source.mapInArrow(run, f"segment string, ids array<{kind}>, lengths binary, terms binary, counts binary, postings binary")
    return materialize(index, "positional-index")


class Benchmark:
    """Windows of some benchmark items: by length, a matrix of term numbers, and for each window the items it is from."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.items = [i for i, _ in items]
        self.terms: dict[bytes, int] = {}
        of: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, found) in enumerate(items):
            numbered = [self.terms.setdefault(w, len(self.terms)) for w in found]
            length = min(window, len(numbered))
            for i in range(len(numbered) - length + 1 if length else 0):
                owners = of[length][tuple(numbered[i : i + length])]
                if not owners or owners[-1] != n:
                    owners.append(n)
        self.windows = {length: np.array(list(w), np.int32).reshape(len(w), length) for length, w in of.items()}
        self.owners = {length: list(w.values()) for length, w in of.items()}


def _near(postings: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
    """For each position: whether the sorted list has one at most slop away."""
    i = np.searchsorted(postings, at - slop)
    return (i < len(postings)) & (postings[np.minimum(i, len(postings) - 1)] <= at + slop)


def search(lengths: np.ndarray, terms: list[bytes], counts: np.ndarray, postings: np.ndarray, test: Benchmark, slop: int = 0) -> dict[int, list[tuple[int, int, int]]]:
    """Matches in a segment by document ordinal: (start word, words, item number), overlapping windows of an item merged.

    slop 0: exact phrases. slop > 0: proximity; every term lies at most slop words from its place in the phrase.
    """
    begins = np.r_[0, np.cumsum(lengths)]
    ends = np.r_[0, np.cumsum(counts)]
    local = np.full(len(test.terms), -1, np.int32)
    for i, t in enumerate(terms):
        if (n := test.terms.get(t)) is not None:
            local[n] = i
    starts, stops, owners = [], [], []
    for length, windows in test.windows.items():
        here = local[windows]
        alive = np.flatnonzero((here >= 0).all(axis=1))
        here = here[alive]
        rarest = np.argsort(counts[here], axis=1, kind="stable")
        for w, row, order in zip(alive.tolist(), here, rarest):
            at = None
            for k in order.tolist():
                listed = postings[ends[row[k]] : ends[row[k] + 1]]
                if at is None:
                    at = listed.astype(np.int64) - k
                else:
                    at = at[_near(listed, at + k, slop)]
                if not len(at):
                    break
            else:
                at = at[(at >= 0) & (at + length <= begins[-1])]
                doc = np.searchsorted(begins, at, "right") - 1
                at = at[at + length <= begins[doc + 1]]
                if len(at):
                    for n in test.owners[length][w]:
                        starts.append(at)
                        stops.append(at + length)
                        owners.append(np.full(len(at), n))
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    if not starts:
        return found
    start, stop, owner = map(np.concatenate, (starts, stops, owners))
    doc = np.searchsorted(begins, start, "right") - 1
    order = np.lexsort((start, doc, owner))
    start, stop, owner, doc = start[order], stop[order], owner[order], doc[order]
    # windows of one length at most in an item, so stops rise with starts and a run ends where a gap opens
    new = np.r_[True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    for d, s, e, n in zip(doc[first].tolist(), start[first].tolist(), stop[last].tolist(), owner[first].tolist()):
        found[d].append((s - int(begins[d]), e - s, n))
    return found


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, window: int, chunk_words: int) -> Iterator[Benchmark]:
    items, size = [], 0
    rows = benchmark.select(F.coalesce(col(item_col).cast("string"), F.lit("null")), col(text_col).cast("binary"))
    for item, text in rows.toLocalIterator():
        found = words(None if text is None else bytes(text))
        items.append((item, found))
        size += len(found)
        if size >= chunk_words:
            yield Benchmark(items, window)
            items, size = [], 0
    yield Benchmark(items, window)


_MATCH = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", pa.string())]))


def find_matches(index: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slop: int = 0, item_col: str = "item_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Return ``id, n_words, matches``, a row for each indexed document.

    matches: array of (start word, length in words, item id as text), runs of overlapping windows of one item merged.
    A window is ``window`` consecutive words of an item; a shorter item is one window; one of no words has none.
    slop > 0 asks for proximity matches (see search). A null item id is called 'null'.
    """
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    parts: list = []
    for test in _chunks(benchmark, item_col, text_col, window, chunk_words):
        if parts and parts[-1][1] is not None:  # not the only chunk: one at a time is held, and its result stored
            done, held = parts.pop()
            parts.append((materialize(done, "benchmark-matches"), None))
            held.destroy()
        shipped = spark.sparkContext.broadcast(test)  # at most chunk_words and one item more

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            test = shipped.value
            for batch in batches:
                for r in range(batch.num_rows):
                    lengths, counts, postings = (np.frombuffer(batch.column(i)[r].as_py(), np.int32) for i in (2, 4, 5))
                    found = search(lengths, batch.column(3)[r].as_py().split(), counts, postings, test, slop)
                    n = len(lengths)
                    matches = [[(s, size, test.items[i]) for s, size, i in found.get(d, ())] for d in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[r].as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), batch.column(1)[r].values, pa.array(lengths), pa.array([[dict(zip(("start", "length", "item"), m)) for m in x] for x in matches], _MATCH)],
                        names=["segment", "ordinal", "id", "n_words", "matches"],
                    )

        schema = f"segment string, ordinal int, id {kind}, n_words int, matches array<struct<start:int,length:int,item:string>>"
        parts.append((index.mapInArrow(run, schema), shipped))
    if len(parts) == 1:
        return parts[0][0].select("id", F.col("n_words").cast("long").alias("n_words"), "matches")
    rows = parts[0][0]
    for more, _ in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("segment", "ordinal").agg(F.first("id").alias("id"), F.first("n_words").cast("long").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")).select("id", "n_words", "matches")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment_words: int = SEGMENT_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Return ``id_col, n_words, matches, n_hit, items``, a row for each input row.

    n_hit: the document's words inside any match; items: distinct ids of matching items, sorted as strings. Null and
    empty texts have no words; repeated rows and ids give repeated rows; an empty benchmark matches nothing; other
    columns are ignored.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col, segment_words=segment_words)
    return _judged(index, benchmark, window, id_col, item_col, item_text_col, chunk_words)


def _judged(index: DataFrame, benchmark: DataFrame, window: int, id_col: str, item_col: str, item_text_col: str, chunk_words: int) -> DataFrame:
    found = find_matches(index, benchmark, window=window, item_col=item_col, text_col=item_text_col, chunk_words=chunk_words)
    covered = (
        "aggregate(array_sort(matches), named_struct('n', 0L, 'e', 0), (a, m) -> named_struct("
        "'n', a.n + greatest(0, m.start + m.length - greatest(a.e, m.start)), 'e', greatest(a.e, m.start + m.length)), a -> a.n)"
    )
    return found.select(F.col("id").alias(id_col), "n_words", "matches", F.expr(covered).alias("n_hit"), F.expr("array_sort(array_distinct(matches.item))").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment_words: int = SEGMENT_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Return the rows of docs whose own text has no match, whatever their ids: none, or shared with rows that have one.

    The index is deleted once the rows that match are known.
    """
    row = F.concat(F.when(col(id_col).isNull(), "-").otherwise("+"), F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit(":"), F.hex(F.xxhash64(col(text_col)))).alias("__key")
    index = build_index(docs.select(row, col(text_col).alias("__text")), id_col="__key", text_col="__text", segment_words=segment_words)
    found = _judged(index, benchmark, window, "__key", item_col, item_text_col, chunk_words)
    hit = materialize(found.where("n_hit > 0").select("__key").distinct(), "contaminated")
    discard(index)
    return docs.select(row, whole_row(docs)).join(hit, "__key", "left_anti").select("__row.*")
