import datetime

import pytest

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
#: Nulls, empty and long texts, ties, repeated rows, text that a tokenizer may trip over.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until the night comes down"),
    (2, "The quick brown fox jumps over the lazy dog again and again until the night comes down"),
    (2, "The quick brown fox jumps over the lazy dog again and again until the night comes down"),
    (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "Zwölf ÄPFEL naïve 日本語   end"), (8, LONG), (9, LONG + " tail"), (None, "no id here at all"), (10, "a\nb\na\nb\n#*$%&|<> !!!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The texts, with columns named like the operators' own outputs."""
    rows = [(i, t, "en", None if n % 4 == 0 else f"s{n % 2}", 1.5, "x", datetime.date(2024, 1, 1)) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, shard string, slot date")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)
