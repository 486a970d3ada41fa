"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two fingerprints within 3
bits, cut into 2 segments of 32 bits, have a segment that differs by at most one bit: both have that segment's
variant with the differing bit wiped. So each distinct fingerprint is indexed under its 64 one-wildcard segment
variants, rows that meet under an equal variant are verified, and only a spanning forest of each meeting group
leaves the task, never its pairs.

A group too large for one task's memory is indexed again by the same rule on the bits still free: the other
segment in 2 halves of 16, then the half still free in 2 of 8. A group that shares 53 bits has at most 2 ** 11
distinct members, so this ends after three levels with nothing dropped. Links are then closed to components by
alternating large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm._shared import ROW_KEY, arrow_limits, col, discard, join_hot, materialize, row_key, whole_row

MAX_BITS = 3
SEED = 42
#: Members of a meeting group that are compared in one task: all that the last level can hold.
GROUP = 2048


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingles' hashes; no words: 0."""
    words = text.lower().split() if text else []  # bytes: lowers A-Z only, splits on 0x20 and 0x09-0x0D only
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    octets = np.frombuffer(b"".join([digest(p, SEED) for p in pieces]), np.uint8).reshape(-1, 8)
    n = len(octets)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # bounded, for very long texts
        ones += np.unpackbits(octets[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What tells rows apart, then the id and the text."""
    return docs.select(*row_key(id_col, text_col), col(id_col).alias("__id"), col(text_col).alias("__text"))


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _with(source: DataFrame, of, schema: str) -> DataFrame:
    """The columns of source but its last, the text, and those that of(texts) returns."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = of(_texts(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more.values()], names=[*batch.schema.names[:-1], *more])

    return source.mapInArrow(run, ", ".join([*fields, schema]))


def _fingerprinted(source: DataFrame, shingle: int) -> DataFrame:
    return _with(source, lambda texts: {"fp": pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))}, "fp long")


def fingerprints(docs: DataFrame, *, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``id_col, fp`` (long, the 64 bits), a row for each input row; a null text has fp 0, like one of no words."""
    arrow_limits(docs.sparkSession)
    return _fingerprinted(docs.select(col(id_col).alias("__id"), col(text_col).alias("__text")), shingle).select(F.col("__id").alias(id_col), "fp")


def _keep_first(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of docs, one row for each root of named (``root``, and ``rep``: the first row of a node): the first in its order."""
    first = named.groupBy("root").agg(F.min("rep").alias("rep")).select(*[F.col(f"rep.{c}").alias(c) for c in ROW_KEY])
    keyed = docs.select(*row_key(id_col, text_col), whole_row(docs))
    # rows equal in id and text: the one whose other columns hash lowest, so a repeated task picks the same
    order = F.xxhash64(*[F.col("__row").getField(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    return keyed.join(first, ROW_KEY, "left_semi").groupBy(*ROW_KEY).agg(F.min_by("__row", order).alias("__row")).select("__row.*")


def forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links values (uint64, distinct) at max_bits or fewer bits apart."""
    edges, left = [], np.arange(len(values))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(values[left] ^ values[u]) <= max_bits
            if near.any():
                hit = left[near]
                edges += [(u, v) for v in hit.tolist()]
                queue += hit.tolist()
                left = left[~near]
    return edges


_LINKS = "a long, b long, hot boolean, k1 long, k2 long"
_LINK_NAMES = ["a", "b", "hot", "k1", "k2"]


def _verify(max_bits: int, group: int):
    """Of rows (k1, k2, fp) sorted in that order: links within each key, or, of a key over ``group`` rows, those rows."""

    def out(a, b, hot, k1, k2) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (a, b)] + [pa.array(np.full(n, hot))] + [pa.array(np.asarray(x, np.int64)) for x in (k1, k2)], names=_LINK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.empty((0, 3), np.int64)
        spilling = None  # the key whose rows are passed on

        def closed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts, sizes = np.r_[0, cut], np.diff(np.r_[0, cut, len(rows)])
            fp = rows[:, 2].view(np.uint64) if rows.flags.c_contiguous and rows.shape[1] == 1 else np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            pair = starts[sizes == 2]
            a, b = fp[pair], fp[pair + 1]
            near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
            links = [(a[near].view(np.int64), b[near].view(np.int64))]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if n > group:
                    yield out(fp[s : s + n].view(np.int64), np.zeros(n), True, rows[s : s + n, 0], rows[s : s + n, 1])
                    continue
                values = np.unique(fp[s : s + n])
                if edges := forest(values, max_bits):
                    e = np.array(edges)
                    links.append((values[e[:, 0]].view(np.int64), values[e[:, 1]].view(np.int64)))
            a, b = (np.concatenate(x) for x in zip(*links))
            if len(a):
                yield out(a, b, False, np.zeros(len(a)), np.zeros(len(a)))

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64, copy=False)
            if spilling is not None:
                same = (rows[:, :2] == spilling).all(axis=1)
                if same.any():
                    yield out(rows[same, 2], np.zeros(same.sum()), True, rows[same, 0], rows[same, 1])
                    rows = rows[~same]
                if len(rows):
                    spilling = None
            rows = np.concatenate([carry, rows])
            carry = rows[:0]
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from closed(rows[:cut])
            carry = rows[cut:]
            if len(carry) > group:
                spilling = carry[0, :2].copy()
                yield out(carry[:, 2], np.zeros(len(carry)), True, carry[:, 0], carry[:, 1])
                carry = carry[:0]
        if len(carry):
            yield from closed(carry)

    return run


def _variants(members: DataFrame, level: int) -> DataFrame:
    """Rows (k1, k2, fp): the one-wildcard variants of each member's segments at this level; keys are exact, not hashes."""
    if level == 1:
        rows = members.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
        segment = "shiftrightunsigned(fp, 32 * (v div 32)) & 4294967295L"
        return rows.selectExpr(f"(cast(v as bigint) << 32) | (({segment}) & ~(1L << (v % 32))) as k1", "0L as k2", "fp")
    if level == 2:  # the segment that k1 isn't about
        rows = members.select("k1", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("v"))
        free = "shiftrightunsigned(fp, if((k1 >> 37) = 0, 32, 0) + 16 * (v div 16)) & 65535L"
        return rows.selectExpr("k1", f"(cast(v as bigint) << 16) | (({free}) & ~(1L << (v % 16))) as k2", "fp")
    rows = members.select("k1", "k2", "fp", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("v"))  # the half that k2 isn't about
    free = "shiftrightunsigned(fp, if((k1 >> 37) = 0, 32, 0) + if((k2 >> 20) = 0, 16, 0) + 8 * (v div 8)) & 255L"
    return rows.selectExpr("k1", f"(k2 << 12) | (cast(v as bigint) << 8) | (({free}) & ~(1L << (v % 8))) as k2", "fp")


def links(distinct: DataFrame, *, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Return ``a, b``: pairs of fingerprints (column fp, distinct) within max_bits that connect all that are so linked."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments serve up to 3 differing bits")
    members, found = distinct.select("fp"), None
    for level in (1, 2, 3):
        # the last level's groups share all but 11 bits, so they hold at most 2048 members and none is passed on
        limit = group if level < 3 else max(group, GROUP)
        dealt = _variants(members, level).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
        met = materialize(dealt.mapInArrow(_verify(max_bits, limit), _LINKS), f"simhash-links{level}")
        near = met.where("not hot").select("a", "b")
        found = near if found is None else found.unionByName(near)
        members = met.where("hot").select(F.col("a").alias("fp"), "k1", "k2")
        if members.isEmpty():
            break
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """Return ``node, root`` for every node of edges (a, b: longs): root is the smallest node reachable.

    Alternating large-star and small-star until the edge set stays the same; it ends with stars, in O(log^2 n) rounds.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e, older = materialize(small.where("u <> v").distinct(), "components"), e
        discard(older)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


_REP = ["__no_id", "__id", "__id_text", "__text_hash"]  # in order: ids before nulls, then by id


def _grouped(docs: DataFrame, shingle: int, max_bits: int, group: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored: rows with their ``fp``; and each distinct fp with its first row ``rep``, its number of rows and its ``root``."""
    arrow_limits(docs.sparkSession)
    fps = materialize(_fingerprinted(_rows(docs, id_col, text_col), shingle), "simhash")
    reps = materialize(fps.groupBy("fp").agg(F.min(F.struct(*_REP)).alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = components(links(reps, max_bits=max_bits, group=group))
    return fps, reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _named(named: DataFrame, node: str) -> DataFrame:
    """Stored: node, its number of rows, and the least id of its root's nodes."""
    names = named.groupBy("root").agg(F.min("rep").alias("first")).select("root", F.col("first.__id").alias("component_id"))
    return materialize(named.select(node, "root", "n").join(names, "root").select(node, "n", "component_id"), "component-names")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, max_bits: int = MAX_BITS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``id_col, fp, component_id``, a row for each input row.

    component_id: the smallest id whose fingerprint is reached by steps of at most max_bits bits, null only if the
    whole component has no id. Equal fingerprints are one node, however many rows share it, so copies cost one row
    each. Null and empty texts share fingerprint 0 and link like any other; an empty table gives an empty result;
    other columns of docs are ignored.
    """
    fps, named = _grouped(docs, shingle, max_bits, group, id_col, text_col)
    return join_hot(fps.select("__id", "fp"), _named(named, "fp"), "fp", "n").select(F.col("__id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, max_bits: int = MAX_BITS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return docs with one row of each component: that of the smallest id; rows without an id come after all others.

    Of rows with that id, the one of the component's text stays; of rows equal in both, one.
    """
    _, named = _grouped(docs, shingle, max_bits, group, id_col, text_col)
    return _keep_first(docs, named, id_col, text_col)


# Near copies by similarity. A 64-bit fingerprint of 5-word shingles puts most pairs of similarity 0.8 further than
# 3 bits apart: a changed word changes five shingles. So candidates come from a 128-bit SimHash of the distinct word
# pairs, cut into 5 segments of 24 bits and, its even and odd bits dealt anew, into 5 others, indexed by the same
# one-wildcard variants, and each is then verified by the exact Jaccard similarity of its word shingles.

SEGMENTS, SEGMENT_BITS = 10, 24
#: Every second bit: the second deal puts those of both halves in one half, and the others in the other.
EVEN = 0x5555555555555555
#: Candidates differ by so many of 128 bits at most: similarity 0.8 is near 12.
CANDIDATE_BITS = 28


def signature(text: bytes | None) -> bytes:
    """16 bytes: a bit is 1 if set in over half of the distinct word pairs' hashes; no words: zeros."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(16)
    pairs = {words[0]} if len(words) == 1 else set(map(b" ".join, zip(words, words[1:])))
    digest = xxhash.xxh3_128_digest
    octets = np.frombuffer(b"".join([digest(p, SEED) for p in pairs]), np.uint8).reshape(-1, 16)
    ones = np.zeros(128, np.int64)
    for i in range(0, len(octets), 1 << 14):
        ones += np.unpackbits(octets[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(octets)).tobytes()


def words_hash(text: bytes | None) -> int:
    """Of all words in their order: texts of equal words are equal for every shingle."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()) if text else b"", SEED)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words, the one of all words; of none, empty."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    pieces = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64)).view(np.int64)


def nearest_forest(hi: np.ndarray, lo: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest by differing bits (Prim), without edges of more than max_bits."""
    n = len(hi)
    best, parent, left, edges, u = np.full(n, 999, np.int64), np.zeros(n, np.int64), np.ones(n, bool), [], 0
    for _ in range(n):
        left[u] = False
        d = np.bitwise_count(hi ^ hi[u]).astype(np.int64) + np.bitwise_count(lo ^ lo[u])
        closer = left & (d < best)
        best[closer], parent[closer] = d[closer], u
        if not left.any():
            break
        u = int(np.where(left, best, 1000).argmin())
        if best[u] <= max_bits:
            edges.append((int(parent[u]), u))
        else:
            best[left] = 999  # a new tree
    return edges


#: Of a key of up to so many members, each pair is tested at once.
FEW = 4
#: Members of a block whose shingle sets are held in one task, twice.
BLOCK = 512


def _bits(hi: np.ndarray, lo: np.ndarray, u) -> np.ndarray:
    return np.bitwise_count(hi ^ hi[u]).astype(np.int64) + np.bitwise_count(lo ^ lo[u])


def _middle(hi: np.ndarray, lo: np.ndarray) -> int:
    """The member nearest to the bitwise majority."""
    octets = np.stack([hi, lo], axis=1).astype(">u8").view(np.uint8)
    ones = np.zeros(128, np.int64)
    for i in range(0, len(octets), 1 << 14):
        ones += np.unpackbits(octets[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    h, l = np.frombuffer(np.packbits(2 * ones > len(hi)).tobytes(), ">u8").astype(np.uint64)
    return int((np.bitwise_count(hi ^ h).astype(np.int64) + np.bitwise_count(lo ^ l)).argmin())


def _segments(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """The segments of ``_segment``, of uint64."""
    low, n, even = np.uint64(0xFFFFFF), np.uint64, np.uint64(EVEN)
    out = []
    for h, l in ((hi, lo), ((hi & ~even) | ((lo >> n(1)) & even), (lo & even) | ((hi & even) << n(1)))):
        out += [l & low, (l >> n(24)) & low, h & low, (h >> n(24)) & low, (l >> n(48)) | (((h >> n(48)) & n(255)) << n(16))]
    return out


def _bit(rows: np.ndarray) -> np.ndarray:
    """The wiped bit of each of rows (g, hi, lo, ...)."""
    hi, lo = rows[:, 1].view(np.uint64), rows[:, 2].view(np.uint64)
    s, w = np.divmod(rows[:, 0] >> SEGMENT_BITS, SEGMENT_BITS)
    parts = np.choose(s, _segments(hi, lo))
    return (parts >> w.astype(np.uint64)) & np.uint64(1)


def _own(rows: np.ndarray, label: np.ndarray, max_bits: int) -> np.ndarray:
    """Which members of a key have a pair of unlike labels within max_bits that meets here and under no key before."""
    hi, lo = (np.ascontiguousarray(rows[:, i]).view(np.uint64) for i in (1, 2))
    parts, (s, w), n = _segments(hi, lo), divmod(int(rows[0, 0]) >> SEGMENT_BITS, SEGMENT_BITS), len(rows)
    bit = _bit(rows)
    own = np.zeros(n, bool)
    # equal segments meet under every variant, the first is theirs; others under that of the differing bit
    for u in range(n) if w == 0 else np.flatnonzero(bit == (2 * bit.sum() < n)).tolist():
        near = (label != label[u]) & (_bits(hi, lo, u) <= max_bits)
        if w:
            near &= bit != bit[u]
        for before in parts[:s]:
            near &= np.bitwise_count(before ^ before[u]) > 1
        if near.any():
            own |= near
            own[u] = True
    return own


def _meet(max_bits: int, group: int):
    """Of rows (g, hi, lo, node) sorted in that order, g a variant: links to test, and nodes of keys where more may meet.

    Members with the wiped bit alike have the whole segment in common and so meet under all its variants; their links
    are made under the first: a minimum spanning forest by bits of each run of ``group`` of them, and all links to the
    middle one. Under every variant, members with that bit unlike are linked, each of the fewer to its nearest other.
    All members of a key over ``group`` may meet more, whatever run they are in.
    """

    def out(linked: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), linked)), pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["linked", "a", "b"])

    def links_of(one: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = np.bitwise_count((one[:, 1] ^ other[:, 1]).view(np.uint64)).astype(int) + np.bitwise_count((one[:, 2] ^ other[:, 2]).view(np.uint64))
        a, b = one[bits <= max_bits, 3], other[bits <= max_bits, 3]
        if len(a):
            yield out(True, np.minimum(a, b), np.maximum(a, b))

    def alike(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        if n <= FEW:
            i, j = np.triu_indices(n, 1)
        else:
            hi, lo = (np.ascontiguousarray(rows[:, i]).view(np.uint64) for i in (1, 2))
            e = np.array(nearest_forest(hi, lo, max_bits), np.int64).reshape(-1, 2)
            m, rest = _middle(hi, lo), np.arange(n)
            rest = rest[rest != m]
            i, j = np.r_[e[:, 0], np.full(n - 1, m)], np.r_[e[:, 1], rest]
        yield from links_of(rows[i], rows[j])

    def run_of(rows: np.ndarray, over: bool = False) -> Iterator[pa.RecordBatch]:
        """over: of a key of more members than ``group``; each may meet others in another run."""
        first, bit = (int(rows[0, 0]) >> SEGMENT_BITS) % SEGMENT_BITS == 0, _bit(rows)
        sides = [rows[bit == 0], rows[bit == 1]]
        fewer, more = sorted(sides, key=len)
        if first:
            for side in sides:
                if len(side) > 1:
                    yield from alike(side)
        if len(fewer):
            if len(rows) <= FEW:
                i, j = np.repeat(np.arange(len(fewer)), len(more)), np.tile(np.arange(len(more)), len(fewer))
            else:
                i, hi, lo = np.arange(len(fewer)), more[:, 1].view(np.uint64), more[:, 2].view(np.uint64)
                j = np.array([(np.bitwise_count(hi ^ h).astype(np.int64) + np.bitwise_count(lo ^ l)).argmin() for h, l in zip(fewer[:, 1].view(np.uint64), fewer[:, 2].view(np.uint64))])
            yield from links_of(fewer[i], more[j])
        # of a key with over FEW members the more are three at least, and met under the first variant of their segment
        seen = rows if first or over else fewer if len(rows) > FEW else rows[:0]
        if (over or len(rows) > 2) and len(seen):
            yield out(False, seen[:, 3], seen[:, 3])

    def runs_of(rows: np.ndarray, over: bool) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), group):
            yield from run_of(rows[at : at + group], over)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, hot = np.empty((0, 4), np.int64), None  # rows of the last key; that key, once runs of it have been worked
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64, copy=False)
            rows = np.concatenate([carry, rows])
            if not len(rows):
                continue
            if hot is not None and (n := int((rows[:, 0] == hot).sum())) < len(rows):
                yield from runs_of(rows[:n], True)
                rows, hot = rows[n:], None
            last = 0
            if hot is None:
                starts = np.r_[0, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1]
                sizes = np.diff(np.r_[starts, len(rows)])
                done, last = sizes[:-1], int(starts[-1])
                bit, first = _bit(rows[:last]), (rows[:last, 0] >> SEGMENT_BITS) % SEGMENT_BITS == 0
                pair = starts[:-1][(done == 2) & (done <= group)]
                pair = pair[first[pair] | (bit[pair] != bit[pair + 1])]
                yield from links_of(rows[pair], rows[pair + 1])
                # a key whose members have its bit alike has nothing to link, unless it is the first of its segment
                ones = np.add.reduceat(bit.astype(np.int64), starts[:-1]) if last else np.empty(0, np.int64)
                use = ((done > 2) | (done > group)) & (first[starts[:-1]] | (ones > 0) & (ones < done))
                for s, n in zip(starts[:-1][use].tolist(), done[use].tolist()):
                    yield from runs_of(rows[s : s + n], n > group)
            carry = rows[last:]
            while len(carry) > group:  # a key of any size is worked in runs
                hot = int(carry[0, 0])
                yield from run_of(carry[:group], True)
                carry = carry[group:]
        if len(carry) > 1 or hot is not None:
            yield from runs_of(carry, hot is not None)

    return run


def _unlinked(max_bits: int, group: int):
    """Of rows (g, hi, lo, node, label) sorted in that order: members (g, block, node, label, hi, lo) to be compared.

    Of a key of up to ``group`` members those of ``_own``; of a larger one all. Blocks with the wiped bit 0 have even
    numbers, those with it 1 odd ones; under the first variant of a segment, where sides don't matter, all are even.
    """
    names = ["g", "block", "node", "label", "hi", "lo"]

    def out(rows: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        """begin: members of each side that went before; it is moved on."""
        side = np.where((rows[:, 0] >> SEGMENT_BITS) % SEGMENT_BITS == 0, 0, _bit(rows).astype(np.int64))
        number = np.where(side == 1, begin[1] + np.cumsum(side) - 1, begin[0] + np.cumsum(1 - side) - 1)
        begin += [len(rows) - side.sum(), side.sum()]
        columns = [rows[:, 0], 2 * (number // BLOCK) + side, rows[:, 3], rows[:, 4], rows[:, 1], rows[:, 2]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, hot, passed = np.empty((0, 5), np.int64), None, np.zeros(2, np.int64)  # rows of the last key, or a key that is passed on

        def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows) > group:
                yield out(rows, np.zeros(2, np.int64))
            elif len(rows) > 1 and (own := _own(rows, rows[:, 4], max_bits)).any():
                yield out(rows[own], np.zeros(2, np.int64))

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64, copy=False)
            if hot is not None and len(rows):
                n = int((rows[:, 0] == hot).sum())
                yield out(rows[:n], passed)
                rows = rows[n:]
                if len(rows):
                    hot = None
            rows = np.concatenate([carry, rows])
            if not len(rows):
                continue
            cuts = [0, *(np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1).tolist()]
            for i, j in zip(cuts, cuts[1:]):
                yield from whole(rows[i:j])
            carry = rows[cuts[-1] :]
            if len(carry) > group:
                passed = np.zeros(2, np.int64)
                yield out(carry, passed)
                hot, carry = int(carry[0, 0]), carry[:0]
        if len(carry):
            yield from whole(carry)

    return run


def _segment(v: str) -> str:
    """SQL of 24 of the 128 bits: of each deal two segments of each half, the fifth of what is left of both."""
    five = lambda n, h, l: (
        f"when {n} then {l} & 16777215L when {n + 1} then shiftrightunsigned({l}, 24) & 16777215L when {n + 2} then {h} & 16777215L "
        f"when {n + 3} then shiftrightunsigned({h}, 24) & 16777215L when {n + 4} then shiftrightunsigned({l}, 48) | ((shiftrightunsigned({h}, 48) & 255L) << 16)"
    )
    return f"case {v} {five(0, 'hi', 'lo')} {five(5, 'hi2', 'lo2')} end"


def _keys(nodes: DataFrame, more: list[str]) -> DataFrame:
    """Rows (g, hi, lo, node, bit, ...): a row for each one-wildcard variant of each node's segments, and the bit it wipes."""
    dealt = nodes.selectExpr("node", "hi", "lo", f"(hi & {~EVEN}L) | (shiftrightunsigned(lo, 1) & {EVEN}L) as hi2", f"(lo & {EVEN}L) | ((hi & {EVEN}L) << 1) as lo2", *more)
    rows = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * SEGMENT_BITS - 1))).alias("v")).selectExpr("node", "hi", "lo", *more, "v", f"{_segment('v div 24')} as segment")
    return rows.selectExpr("(cast(v as bigint) << 24) | (segment & ~(1L << (v % 24))) as g", "hi", "lo", "node", "cast(shiftright(segment, v % 24) & 1L as int) as bit", *more)


def meetings(distinct: DataFrame, *, max_bits: int = CANDIDATE_BITS, group: int = GROUP) -> DataFrame:
    """Of distinct texts (node, hi, lo), stored: pairs ``a, b`` to test first (linked), and nodes ``a`` that may meet others too."""
    dealt = _keys(distinct, []).drop("bit").repartition("g").sortWithinPartitions("g", "hi", "lo", "node")
    return materialize(dealt.mapInArrow(_meet(max_bits, group), "linked boolean, a long, b long"), "near-candidates")


def unlinked(nodes: DataFrame, *, max_bits: int = CANDIDATE_BITS, group: int = GROUP) -> DataFrame:
    """Of nodes (node, hi, lo, label): members (g, block, node, label, hi, lo) of keys where unlike labels meet.

    A key's members are taken if they have an unlike label across the wiped bit or, under the first variant of a
    segment, on their own side: members with the whole segment in common need no other variant.
    """
    keys, of_key = _keys(nodes, ["label"]).repartition("g"), Window.partitionBy("g")
    of = lambda f, bit: f(F.when(F.col("bit") == bit, F.col("label"))).over(of_key)
    sides = keys.select("*", of(F.min, 0).alias("low0"), of(F.max, 0).alias("high0"), of(F.min, 1).alias("low1"), of(F.max, 1).alias("high1"))
    sides = sides.where("least(low0, low1) < greatest(high0, high1)")
    label, zero = F.col("label"), F.col("bit") == 0
    differs = lambda low, high: F.coalesce((F.col(low) != label) | (F.col(high) != label), F.lit(False))
    across, along = F.when(zero, differs("low1", "high1")).otherwise(differs("low0", "high0")), F.when(zero, differs("low0", "high0")).otherwise(differs("low1", "high1"))
    first = F.shiftright("g", SEGMENT_BITS) % SEGMENT_BITS == 0
    met = sides.where(across | (first & along))
    dealt = met.select("g", "hi", "lo", "node", "label").repartition("g").sortWithinPartitions("g", "hi", "lo", "node")
    return dealt.mapInArrow(_unlinked(max_bits, group), "g long, block long, node long, label long, hi long, lo long")


def _compare(max_bits: int, similarity: float):
    """Of rows (g, x, y, node, label, hi, lo, s) sorted by g, x, y: verified links that join labels, for each (g, x, y)."""

    def links_of(rows: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        n, found = len(rows), []
        label = np.unique(rows[:, 4], return_inverse=True)[1]
        hi, lo = (np.ascontiguousarray(rows[:, i]).view(np.uint64) for i in (5, 6))
        sizes = np.array([len(s) for s in sets], np.int64)
        words, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner, ends = np.repeat(np.arange(n), sizes), np.cumsum(sizes)
        for u in range(n - 1):
            near = (label != label[u]) & (_bits(hi, lo, u) <= max_bits)
            near[: u + 1] = False
            if not near.any():
                continue
            mark = np.zeros(len(words), bool)
            mark[at[ends[u] - sizes[u] : ends[u]]] = True
            both = np.bincount(owner, weights=mark[at], minlength=n)
            for v in np.flatnonzero(near & (both >= similarity * (sizes[u] + sizes - both))).tolist():
                if label[v] != label[u]:
                    found.append((int(rows[u, 3]), int(rows[v, 3])))
                    label[label == label[v]] = label[u]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, sets = np.empty((0, 7), np.int64), []

        def closed(rows: np.ndarray, those: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cuts = np.r_[0, np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1, len(rows)].tolist()
            e = [pair for i, j in zip(cuts, cuts[1:]) for pair in links_of(rows[i:j], those[i:j])]
            if e:
                e = np.array(e, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e.min(axis=1)), pa.array(e.max(axis=1))], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)], axis=1).astype(np.int64, copy=False)
            lists = batch.column(7)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            # copies, so the batch's buffer can go
            sets += [x.copy() for x in np.split(flat, ends[:-1])]
            kept = np.concatenate([kept, rows])
            other = np.flatnonzero((kept[:, :3] != kept[-1, :3]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from closed(kept[:cut], sets[:cut])
                kept, sets = kept[cut:], sets[cut:]
        if len(kept):
            yield from closed(kept, sets)

    return run


def _apart(members: DataFrame) -> DataFrame:
    """Rows (g, x, y, node, label, hi, lo): members of each two blocks x <= y of a key that are not all linked yet.

    Members with the wiped bit alike share the segment and are compared under its first variant; under the others only
    blocks of unlike sides are.
    """
    blocks = members.groupBy("g", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    x, y = (blocks.select("g", F.col("block").alias(c), F.col("least").alias(f"least_{c}"), F.col("most").alias(f"most_{c}")) for c in "xy")
    pairs = x.join(y, "g").where(f"x <= y and (shiftright(g, {SEGMENT_BITS}) % {SEGMENT_BITS} = 0 or x % 2 <> y % 2) and least(least_x, least_y) <> greatest(most_x, most_y)").select("g", "x", "y")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    return members.join(sides, ["g", "block"]).select("g", "x", "y", "node", "label", "hi", "lo")


def _similar(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str, max_bits: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Stored: rows with their ``node``, texts of equal words; and each node with its first row, number of rows and root.

    What is stored on the way, shingle sets above all, is deleted when the roots are known.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    source = _rows(docs, id_col, text_col)

    def signed(texts: list[bytes | None]) -> dict[str, pa.Array]:
        pair = np.frombuffer(b"".join(map(signature, texts)), ">i8").astype(np.int64).reshape(-1, 2)
        words = np.fromiter(map(words_hash, texts), np.uint64, len(texts)).view(np.int64)
        return {"hi": pa.array(pair[:, 0].copy()), "lo": pa.array(pair[:, 1].copy()), "words": pa.array(words)}

    signatures = materialize(_with(source, signed, "hi long, lo long, words long").withColumn("node", F.xxhash64("hi", "lo", "words")), "near-signatures")
    reps = materialize(signatures.groupBy("node", "hi", "lo").agg(F.min(F.struct(*_REP)).alias("rep"), F.count(F.lit(1)).alias("n")), "near-distinct")
    met = meetings(reps, max_bits=max_bits, group=group)
    pairs, active = materialize(met.where("linked").select("a", "b").distinct(), "near-pairs"), materialize(met.where("not linked").select(F.col("a").alias("node")).distinct(), "near-active")
    discard(met)

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(active).distinct()
    wanted = reps.join(nodes, "node", "left_semi").select("node", *[F.col(f"rep.{c}").alias(c) for c in ROW_KEY])
    found = source.join(wanted, ROW_KEY).select("node", "__text")
    shingled = _with(found, lambda texts: {"s": pa.array([shingle_set(t, shingle) for t in texts], pa.list_(pa.int64()))}, "s array<bigint>")
    sets = materialize(shingled.dropDuplicates(["node"]), "near-shingles")
    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    common = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    verified = materialize(common.where(F.expr(f"n >= {similarity!r}D * (na + nb - n)")).select("a", "b"), "near-verified")
    roots = components(verified)
    labelled = reps.select("node", "hi", "lo").join(active, "node").join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = materialize(unlinked(labelled, max_bits=max_bits, group=group), "near-unlinked")
    if not members.isEmpty():
        dealt = _apart(members).join(sets, "node").select("g", "x", "y", "node", "label", "hi", "lo", "s").repartition("g", "x", "y").sortWithinPartitions("g", "x", "y")
        roots = components(verified.unionByName(dealt.mapInArrow(_compare(max_bits, similarity), "a long, b long")))
    for done in (pairs, active, sets, verified, members):
        discard(done)
    return signatures, reps.select("node", "rep", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar_documents(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_bits: int = CANDIDATE_BITS, group: int = GROUP) -> DataFrame:
    """Return ``id_col, component_id``, a row for each input row.

    component_id: the smallest id reached over verified links, null only if none of them has an id; two texts link if
    the Jaccard similarity of their distinct word shingles (of all words, where they are fewer) is at least
    ``similarity``. Pairs are found by SimHash, so one that shares no segment within a bit may be missed, the less
    likely the more alike the texts are; all that meet are compared until they are linked, and none is reported in
    error. Texts of equal words are one text here. Null and empty texts are alike.
    """
    signatures, named = _similar(docs, shingle, similarity, id_col, text_col, max_bits, group)
    return join_hot(signatures.select("__id", "node"), _named(named, "node"), "node", "n").select(F.col("__id").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_bits: int = CANDIDATE_BITS, group: int = GROUP) -> DataFrame:
    """Return docs with one row of each component: that of the smallest id; rows without an id come after all others.

    Of rows with that id, the one of the component's text stays; of rows equal in both, one.
    """
    _, named = _similar(docs, shingle, similarity, id_col, text_col, max_bits, group)
    return _keep_first(docs, named, id_col, text_col)
