"""Quality rules as a bitmask ledger.

Every text is measured once (one Arrow pass), every rule is evaluated once over the measurements, and its failure
is a bit of ``failed``. Policies are masks with a version: applying one, or asking what leaving a rule out would
change, is bit arithmetic on the ledger and never touches a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm._shared import arrow_limits, col

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: (name, SQL condition of failure over the measurements). The position is the bit; append only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("shouting", "10 * n_upper > 3 * word_chars"),
    ("exclamations", "2 * n_exclamations > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": sum(BIT.values()),
}

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclamations")
_UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more in the list, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    repeated = set()
    for w in windows:
        if w in seen:
            repeated.add(w)
        seen[w] = 1
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in repeated:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def measure(text: bytes | None, chars: int | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(_MEASURES)
    words = text.split()  # bytes split exactly on 0x20 and 0x09-0x0D
    lines = [x for x in text.split(b"\n") if x.strip()]
    blank = len(text) - sum(map(len, words))
    return (
        len(words), chars - blank, len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
        repeated_words(words), len(text) - len(text.translate(None, _UPPER)), text.count(b"!"),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        chars = pc.utf8_length(texts).to_pylist()
        rows = [measure(t, n) for t, n in zip(texts.cast(pa.large_binary()).to_pylist(), chars)]
        columns = list(zip(*rows)) if rows else [()] * len(_MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["__id", *_MEASURES])


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``id_col``, the measurements and ``failed`` (long, bit i set if rule i fails), a row for each input row.

    A null or empty text has all measurements 0, and so fails few_words. Texts of any length are measured whole.
    Repeated rows give repeated ledger rows; an empty table an empty ledger; other columns of docs are ignored.
    """
    arrow_limits(docs.sparkSession)
    source = docs.select(col(id_col).alias("__id"), col(text_col).alias("__text"))
    schema = f"__id {source.schema['__id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in _MEASURES)
    bits = " + ".join(f"(case when {failure} then {1 << i}L else 0L end)" for i, (_, failure) in enumerate(RULES))
    return source.mapInArrow(_measured, schema).select(F.col("__id").alias(id_col), *_MEASURES, F.expr(bits).alias("failed"))


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """Add ``kept``: no rule of the policy failed. An existing column of that name is replaced."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Return for each rule of the policy: documents it fails, and those kept if only that rule were left out.

    The ledger is first counted by mask (at most 2 ** len(RULES) rows), so this costs one narrow aggregation.
    """
    mask = POLICIES[policy]
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if mask & bit])
    one = masks.select("m", "n", F.explode(rules).alias("r"))
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
    )
