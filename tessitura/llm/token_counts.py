"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The best segmentation of a word's prefix does not depend on what follows it. So the distinct pre-tokens of a task
are inserted in a trie whose nodes keep the forward score (the best log probability of any segmentation up to
there) and its number of tokens: prefixes that words share are computed once, and a word's count is read at its
last node. The terminal counts are kept by word, and a text's count is their sum.

The vocabulary is a public tokenizer's, read on the driver. Its file ranks pieces but has no probabilities, so a
piece's is Zipf's by rank. Characters that no piece covers fall back to one token a UTF-8 byte.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm._shared import arrow_limits, col

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BOUNDARY = "▁"
#: A task's trie and its table of counts start anew beyond so many entries; results don't depend on it.
NODES, WORDS = 300_000, 300_000


ABSENT = object()


class Unigram(NamedTuple):
    ends: dict[str, float | None]  # log probability of each piece; None for other strings that a piece ends with
    unknown: float


def load_vocabulary(path: str = VOCABULARY) -> Unigram:
    """Pieces and Zipf log probabilities of a sentencepiece file; control, unknown and byte pieces aren't matched."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return unigram(pieces)


def unigram(pieces: list[str]) -> Unigram:
    """The model of pieces given in order of rank."""
    total = math.log(sum(1.0 / (r + 2) for r in range(len(pieces))) or 1.0)
    score = {p: -math.log(r + 2) - total for r, p in enumerate(pieces)}
    ends: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(1, len(p))}
    return Unigram(ends | score, min(score.values(), default=0.0) - 10.0)


class Trie:
    """Nodes are numbers; an edge is keyed by its node and character. Node 0 is the empty prefix."""

    def __init__(self, model: Unigram):
        self.model = model
        self.edges: dict[int, int] = {}
        self.score, self.tokens = array("d", [0.0]), array("l", [0])

    def count(self, word: str) -> int:
        """Insert a pre-token and return its number of tokens: of the likeliest segmentation, on ties the shortest."""
        edges, score, tokens = self.edges, self.score, self.tokens
        ends, unknown = self.model
        path, node = [0], 0
        for i, c in enumerate(word, 1):
            key = (node << 21) | ord(c)
            node = edges.get(key, -1)
            if node < 0:
                at = path[-1]
                n = len(c.encode("utf-8", "surrogateescape"))
                best, few = score[at] + unknown * n, tokens[at] + n
                for j in range(i - 1, -1, -1):
                    p = ends.get(word[j:i], ABSENT)
                    if p is ABSENT:  # no piece ends like this, nor so any longer string
                        break
                    if p is not None:
                        at = path[j]
                        s = score[at] + p
                        if s > best or s == best and tokens[at] + 1 < few:
                            best, few = s, tokens[at] + 1
                node = edges[key] = len(score)
                score.append(best)
                tokens.append(few)
            path.append(node)
        return tokens[node]


class Counter:
    """Counts of words seen before, and the trie that counts new ones; both bounded."""

    def __init__(self, model: Unigram):
        self.model, self.known = model, {}
        self.trie = Trie(model)

    def text(self, raw: bytes | None) -> tuple[int, int]:
        words = raw.split() if raw else []
        known = self.known
        for w in sorted(w for w in set(words) if w not in known):  # a set minus a dict's keys would walk all the keys
            if len(self.trie.score) > NODES:
                self.trie = Trie(self.model)
            self.known[w] = self.trie.count(BOUNDARY + w.decode("utf-8", "surrogateescape"))  # bytes that are no UTF-8 count one token each
        total = sum(map(self.known.__getitem__, words))
        if len(self.known) > WORDS:
            self.known = {}
        return len(words), total


def count_tokens(docs: DataFrame, model: Unigram, *, text_col: str = "text") -> DataFrame:
    """Return docs with ``n_pretokens`` and ``n_tokens`` (long), a row for each input row.

    Pre-tokens are runs of characters other than ASCII white space, each with a boundary mark before it. Null and
    empty texts have none of either. Columns of these names are replaced.
    """
    arrow_limits(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary file
    kind = pa.struct([("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    @F.arrow_udf("n_pretokens long, n_tokens long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(shipped.value)
        for texts in batches:
            raw = texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            yield pa.array([dict(zip(("n_pretokens", "n_tokens"), counter.text(t))) for t in raw], kind)

    done = docs.withColumn("__counted", counted(col(text_col)))
    return done.withColumn("n_pretokens", F.col("__counted.n_pretokens")).withColumn("n_tokens", F.col("__counted.n_tokens")).drop("__counted")
