"""SimHash: fingerprints, links at every level, components, and similarity-verified near copies."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessitura.llm import simhash


def brute_fingerprint(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    pieces = [b" ".join(w)] if len(w) < n else [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def roots_of(values, near):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprints(docs):
    short = docs.where("doc_id is null or doc_id not in (8, 9)")
    got = sorted((r["doc_id"] or 0, r["fp"] % 2**64) for r in simhash.fingerprints(short, shingle=3).collect())
    assert got == sorted((r["doc_id"] or 0, brute_fingerprint(r["text"], 3)) for r in short.collect())


@pytest.mark.parametrize("group", [2, 8, 2048])
def test_links_of_dense_clusters(spark, group):
    """Balls around centres, chains, and values that share a whole segment; small groups force the further levels."""
    rng = random.Random(group)
    values = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        values |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(60)}
    c = rng.getrandbits(64)
    values |= {c ^ rng.getrandbits(32) for _ in range(40)} | {c ^ (rng.getrandbits(6) << 40) for _ in range(40)}
    for _ in range(20):
        c ^= sum(1 << b for b in rng.sample(range(64), 3))
        values.add(c)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), group=group).collect()
    near = lambda a, b: bin((a ^ b) % 2**64).count("1") <= 3
    assert all(near(e["a"], e["b"]) for e in edges)
    want = roots_of({v for (v,) in signed}, near)
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame([(e["a"], e["b"]) for e in edges], "a long, b long")).collect()}
    assert {v: found.get(v, v) for v in want} == want


def test_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = simhash.components(edges).collect()
    assert len(got) == n and {r["root"] for r in got} == {0}


def test_components_of_nothing(spark):
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(docs, empty):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, shingle=3).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6)} <= got
    assert simhash.near_duplicates(docs, shingle=3).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(docs, shingle=3).where("doc_id <= 6 or doc_id is null").orderBy("doc_id").collect()] == [None, 1, 3, 6]


@pytest.mark.parametrize("drop", [simhash.drop_similar, simhash.drop_near_duplicates])
def test_rows_are_dropped_not_ids(spark, drop):
    """Unlike texts under one id stay; of copies without an id one stays; an id goes before none."""
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long, "a"), (1, other, "b"), (None, "x y z " + other[:50], "c"), (None, "x y z " + other[:50], "c"), (None, long, "d"), (4, other, "e"), (1, other, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = drop(d)
    assert got.columns == d.columns
    assert sorted((r["doc_id"] or 0, r["root"]) for r in got.collect()) == [(0, "c"), (1, "a"), (1, "b")]


def test_recall_by_similarity(spark):
    """Pairs of a text and one copy: found the more surely the more alike, and nothing below the threshold."""
    rng = random.Random(17)
    rows, bands = [], {}
    for n in range(900):
        w = [f"w{rng.randrange(4000)}" for _ in range(250)]
        other = list(w)
        for k in rng.sample(range(250), 1 + n % 9):
            other[k] = f"x{rng.randrange(10**6)}"
        a, b = (set(simhash.shingle_set(" ".join(x).encode(), 5).tolist()) for x in (w, other))
        bands[n] = len(a & b) / len(a | b)
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = lambda low, high: np.mean([got[2 * n + 1] == 2 * n for n, s in bands.items() if low <= s < high])
    assert found(0.9, 1.0) >= 0.98 and found(0.85, 0.9) >= 0.95 and found(0.8, 0.85) >= 0.93 and found(0.0, 0.8) == 0


@pytest.mark.parametrize("length", [40, 80, 150, 500])
def test_recall_by_length(length):
    """Words replaced, left out and put in: of the pairs in each band of similarity at least nine in ten share a segment within a bit."""
    rng, bands = random.Random(length), {}
    for n in range(6000 if length < 100 else 1500):
        w = [f"w{rng.randrange(4000)}" for _ in range(length)]
        other = list(w)
        for i in rng.sample(range(length), 1 + n % max(1, length // 22)):
            other[i] = rng.choice([f"x{rng.randrange(10**6)}", "", other[i] + " y"])
        a, b = (set(simhash.shingle_set(" ".join(x).encode(), 5).tolist()) for x in (w, other))
        similar = len(a & b) / len(a | b)
        if similar >= 0.8:
            halves = [np.frombuffer(simhash.signature(" ".join(x).encode()), ">u8").astype(np.uint64) for x in (w, other)]
            parts = [simhash._segments(s[:1], s[1:]) for s in halves]
            bands.setdefault(min(int((similar - 0.8) / 0.05 + 1e-9), 2), []).append(any(np.bitwise_count(p ^ q)[0] <= 1 for p, q in zip(*parts)))
    assert all(np.mean(v) >= 0.9 for v in bands.values() if len(v) >= 60), {k: (len(v), np.mean(v)) for k, v in bands.items()}


def copies(spark, n=30, edits=4, words=400):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(words)] for _ in range(10)]
    rows = []
    for i in range(n * 10):
        w = list(base[i % 10])
        for k in rng.sample(range(words), edits):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("group", [8, 2048])
def test_similar_documents(spark, group):
    d = copies(spark)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(d, group=group).collect()}
    sets = {r["doc_id"]: set(simhash.shingle_set(r["text"].encode(), 5).tolist()) for r in d.collect()}
    want = roots_of(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert all(want[i] == want[c] for i, c in got.items())  # nothing joined in error
    assert np.mean([got[i] == want[i] for i in want]) > 0.9


def test_similar_odd_tables(docs, empty):
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert got[1] == got[2] == 1 and got[3] == got[4] == got[5] == 3 and got[8] == got[9] == 8 and got[None] is None
    assert simhash.similar_documents(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.drop_similar(docs).orderBy("doc_id").collect()]
    assert kept == [None, 1, 3, 6, 7, 8, 10] and simhash.drop_similar(docs).columns == docs.columns


def test_rejects_wide_thresholds(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.range(3).select(F.col("id").alias("fp")), max_bits=4)


def family(n, edits=4, words=200, seed=7):
    """A base text and n copies of other edits each: near the base, and most not near each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    texts = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for i, k in enumerate(rng.sample(range(2, words - 3), edits)):
            w[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


def components_of(spark, texts, **options):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(d, **options).collect()}


def met_roots(texts, max_bits=simhash.CANDIDATE_BITS):
    """Components of all verified pairs that share a segment within a bit."""
    sig = [np.frombuffer(simhash.signature(t.encode()), ">u8").astype(np.uint64) for t in texts]
    parts = [[int(x[0]) for x in simhash._segments(s[:1], s[1:])] for s in sig]
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]

    def near(i, j):
        if not any((x ^ y).bit_count() <= 1 for x, y in zip(parts[i], parts[j])) or int(np.bitwise_count(sig[i] ^ sig[j]).sum()) > max_bits:
            return False
        n = len(sets[i] & sets[j])
        return n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)

    return roots_of(range(len(texts)), near)


def test_family_of_one_base(spark):
    """Each copy links to the base alone, though its nearest by bits is another copy."""
    texts = family(300)
    assert components_of(spark, texts) == met_roots(texts)


@pytest.mark.parametrize("group", [6, 2048])
@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_unlinked_members_by_brute_force(spark, group, broadcast):
    """Whatever join the planner takes, all members of unlike labels that meet within the bits are passed on, and together."""
    rng = random.Random(19)
    rows = []
    for f in range(4):
        base = rng.getrandbits(128)
        for i in range(40):
            v = base
            for b in rng.sample(range(128), rng.randrange(9)):
                v ^= 1 << b
            rows.append((v, f if i % 3 else 100 + len(rows)))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(n, signed(v >> 64), signed(v & (2**64 - 1)), label) for n, (v, label) in enumerate(rows)], "node long, hi long, lo long, label long")
    hi, lo = (np.array([v >> 64 if k else v & (2**64 - 1) for v, _ in rows], np.uint64) for k in (1, 0))
    parts = [list(map(int, p)) for p in simhash._segments(hi, lo)]
    want = set()
    for i, (v, a) in enumerate(rows):
        for j, (w, b) in enumerate(rows[:i]):
            if a != b and (v ^ w).bit_count() <= 12 and any((p[i] ^ p[j]).bit_count() <= 1 for p in parts):
                want.add((j, i))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = simhash.unlinked(table, max_bits=12, group=group).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = {}
    for r in got:
        keys.setdefault(r["g"], set()).add(r["node"])
    together = {(min(i, j), max(i, j)) for nodes in keys.values() for i in nodes for j in nodes if i != j}
    assert want and want <= together
    if group > 1000:
        assert {r["node"] for r in got} == {n for pair in want for n in pair}


def test_chains_are_followed(spark):
    """Members that the first links leave apart are compared with all others of their group."""
    rng = random.Random(11)
    texts = family(1, seed=11)[:1]
    for _ in range(119):
        w = rng.choice(texts).split()
        for k in rng.sample(range(len(w)), 4):
            w[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    assert components_of(spark, texts) == met_roots(texts)


def test_oversized_groups(spark):
    """Members of different runs of an oversized group are compared too."""
    texts = family(60, seed=13)
    assert components_of(spark, texts, group=8) == met_roots(texts)


def test_equal_signatures_are_verified(spark):
    """Long texts over few words have equal signatures but other shingles."""
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(20_000)) for _ in range(2)]
    assert simhash.signature(texts[0].encode()) == simhash.signature(texts[1].encode())
    assert components_of(spark, [*texts, texts[0].upper().replace(" ", "  ")]) == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("group,batch", [(8, 5), (8, 1000), (4, 3)])
def test_all_of_an_oversized_key_are_compared(spark, group, batch):
    """Whatever is left for a key's last run: members that share one segment and nothing else are all reported."""
    rng = np.random.default_rng(group)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for n in (group, group + 1, group + 2, group + 4, 2 * group, 2 * group + 1, 2 * group + 2, 3 * group):
            rows = [(i, int(hi), int(lo) & ~0xFFFFFF | i % 2) for i, (hi, lo) in enumerate(rng.integers(-(2**63), 2**63, (n, 2)))]  # segment 0: one bit
            table = spark.createDataFrame(rows, "node long, hi long, lo long")
            met = simhash.meetings(table, max_bits=0, group=group)
            assert {r["a"] for r in met.where("not linked").collect()} == set(range(n))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


@pytest.mark.parametrize("extra", [0, 1, 2, 4, 9])
def test_groups_just_over_the_limit(spark, extra):
    """Near copies in groups of the limit and a little more, against all pairs that meet."""
    texts = family(7 + extra, edits=3, seed=extra) + family(3, seed=90)
    assert components_of(spark, texts, group=8) == met_roots(texts)
