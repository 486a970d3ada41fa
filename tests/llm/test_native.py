"""Sharding, mixing and the rule ledger."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessitura.llm import mixing, rules, sharding


@pytest.mark.parametrize("n", [1, 3, 24])
def test_shards(docs, n):
    got = sharding.shard_by_bytes(docs, n).collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 8) for r in docs.collect()))
    total, at, shards = sum(w[3] for w in want), 0, []
    for w in want:
        shards.append(min(n - 1, at * n // total))
        at += w[3]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"]) for r in got) == sorted((*w, s) for w, s in zip(want, shards))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = Counter()
    for r in sharding.shard_by_bytes(d, 7).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 57


def test_shards_of_odd_tables(docs, empty):
    assert sharding.shard_by_bytes(docs, 2).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    for of in (sharding.shard_by_bytes, sharding.shard_stored):
        assert of(empty, 5).count() == 0
        with pytest.raises(ValueError):
            of(docs, 0)


def test_stored_shards_keep_columns(docs):
    d = docs.withColumn("docs_shard", F.lit("taken"))
    got = sharding.shard_stored(d, 2)
    assert got.columns == ["doc_id", "text", "lang", "source", "score", "docs_docs_shard", "docs_slot", "docs_shard", *sharding.ADDED]
    assert got.where("docs_docs_shard <> 'x' or docs_shard <> 'taken' or docs_slot <> date'2024-01-01'").count() == 0
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("n", [1, 5, 24])
@pytest.mark.parametrize("filtered", [False, True])
def test_stored_shards(spark, tmp_path, n, filtered):
    """Cuts in order of the files and the rows in them, whether a read holds all their rows or not."""
    path = str(tmp_path / "rows")
    order = F.md5(F.col("doc_id").cast("string"))
    spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text")).repartitionByRange(12, order).sortWithinPartitions(order).write.parquet(path)
    d = spark.read.parquet(path)
    d = d.where("doc_id % 3 <> 1") if filtered else d
    got = {r["doc_id"]: r for r in sharding.shard_stored(d, n).collect()}
    import hashlib

    ids = sorted((r["doc_id"] for r in d.collect()), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    total, at, slots = sum(2 * (i % 50) + 8 for i in ids), 0, Counter()
    assert len(got) == len(ids)
    for i in ids:
        shard = min(n - 1, at * n // total)
        assert (got[i]["size"], got[i]["shard"], got[i]["slot"]) == (2 * (i % 50) + 8, shard, slots[shard])
        slots[shard] += 1
        at += 2 * (i % 50) + 8


def test_large_offsets_do_not_overflow(spark):
    """Bytes and tokens of far over 100 TB."""
    big = spark.sql("select 99999999999999999L as start, 100000000000000000L as total")
    assert big.select(sharding.cut("start", "total", 1_000_000).alias("x")).first()["x"] == 999_999
    tokens = spark.sql("select 9999999999999L as start, 10000000000000L as budget")
    assert tokens.select(mixing.block_of("start", "budget", 10**8).alias("x")).first()["x"] == 9999999999999 * 10**8 // 10**13


def skewed(spark):
    return spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("small"), (F.col("id") % 7).cast("string"))).otherwise("large").alias("source"))


def test_mix(spark):
    d = skewed(spark)
    plan = mixing.solve(mixing.tokens(d), entropy_share=0.95, repetition_limit=2.0, block_tokens=500)
    got = mixing.mix(d, entropy_share=0.95, repetition_limit=2.0, block_tokens=500).toPandas()
    tokens = got.drop_duplicates("doc_id").groupby("source")["n_tokens"].sum()
    read = got.groupby("source")["n_tokens"].sum()
    p = tokens / tokens.sum()
    assert 0 < plan.exponent < 1
    assert ((p.max() / p) ** (1 - plan.exponent) <= 2.0 + 1e-5).all()  # the limit binds
    assert ((p.max() / p) ** (1 - plan.exponent + 2e-6) > 2.0).any()
    weights = p**plan.exponent / (p**plan.exponent).sum()
    assert abs(read / read.sum() - weights).max() < 0.01
    assert set(got["doc_id"]) == set(range(4000)) and got["copy"].max() == 2 and not got.duplicated(["doc_id", "copy"]).any()
    assert all(sorted(s) == list(range(len(s))) for s in got.groupby("block")["slot"].apply(list))
    share = got[got["source"] == "large"].groupby("block")["n_tokens"].sum() / got.groupby("block")["n_tokens"].sum()
    assert abs(share - weights["large"]).max() < 0.12  # every block holds the mix


def test_mix_reaches_entropy(spark):
    import math

    d = skewed(spark)
    plan = mixing.solve(mixing.tokens(d), entropy_share=0.97, repetition_limit=1e9, block_tokens=500)
    w = [r["weight"] for r in plan.weights.collect()]
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(0.97 * math.log(len(w)), abs=1e-4)


def test_mix_odd_tables(docs, empty):
    got = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in got if r["copy"] == 1) == Counter(r["doc_id"] for r in docs.collect())
    assert {r["source"] for r in got} == {None, "s0", "s1"}
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns and mixing.apply_mix(empty).count() == 0


def test_rows_are_read_as_mixed(spark, tmp_path):
    """Rows that share an id, or have none, are read each as often as the mix says, and written in its order."""
    d = skewed(spark).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 7)).withColumn("text", F.concat("text", F.monotonically_increasing_id().cast("string"))).withColumn("block", F.lit("mine"))
    d = d.unionByName(d.limit(3)).unionByName(d.limit(3))
    d.write.parquet(str(tmp_path / "in"))
    d = spark.read.parquet(str(tmp_path / "in"))
    plan = mixing._place(mixing.tokens(d, keyed=True), "__row", 0.95, 2.0, 300, "mix")
    want = Counter(r["__row"] for r in plan.collect())
    out = mixing.apply_mix(d, block_tokens=300)
    out.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    got = back.select(mixing._row("doc_id", "text", "source").alias("row"), "block").collect()
    assert out.columns == d.columns and Counter(r["row"] for r in got) == want and {r["block"] for r in got} == {"mine"}
    # contiguous pieces of the written stream hold the mix
    shards = sharding.shard_stored(back, 5).groupBy("shard").agg((F.sum(F.when(F.col("source") == "large", F.regexp_count("text", F.lit(mixing.WORD))).otherwise(0)) / F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).alias("share")).collect()
    assert len(shards) == 5 and max(r["share"] for r in shards) - min(r["share"] for r in shards) < 0.12


def brute(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_ledger(docs, empty):
    got = rules.ledger(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r["doc_id"] or 0, *(r[n] for n in names)) for r in got) == sorted((r["doc_id"] or 0, *brute(r["text"])) for r in docs.collect())
    assert rules.ledger(empty).count() == 0


def test_policies_and_ablations(docs):
    book = rules.ledger(docs)
    kept = {v: rules.apply_policy(book, v).where("kept").count() for v in rules.POLICIES}
    assert kept["v1"] <= kept["base"]
    for r in rules.ablations(book, "v1").collect():
        mask = rules.POLICIES["v1"] & ~rules.BIT[r["rule"]]
        without = book.where(F.col("failed").bitwiseAND(F.lit(mask)) == 0).count()
        assert without - kept["v1"] == r["n_only_this"] <= r["n_failed"]


def test_repeats_overlap():
    w = [b"a"] * 7
    assert rules.repeated_words(w) == 7 and rules.repeated_words([b"a", b"b"]) == 0
