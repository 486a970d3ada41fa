"""The registered queries against their SQL, and the pipeline's rules against brute force."""

import pytest
from pyspark.sql import functions as F

from tessitura.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_a_row_for_each_document(name, spark, sf):
    got = QUERIES[name](spark, sf).toPandas()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == n and got["doc_id"].nunique() == n


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from tessitura.llm import decontamination as D
    from tessitura.llm import simhash, toxicity

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in p.STAGES:
        kept.append(p.materialize(stage(spark, kept[-1], sf), "test"))
    for before, after in zip(kept[:-2], kept[1:-1]):
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
    scored = toxicity.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("not is_toxic")
    assert {r["doc_id"] for r in kept[1].collect()} == {r["doc_id"] for r in scored.collect()}
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in texts.items()}
    whole = {}
    for i, t in texts.items():
        assert whole.setdefault(t, i) == i  # no exact copies
    removed = {r["doc_id"]: r["text"] for r in kept[1].collect() if r["doc_id"] not in texts}
    everything = sets | {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in removed.items()}
    for i in removed:  # each that went was like some other
        assert any(len(everything[i] & s) >= 0.8 * len(everything[i] | s) for j, s in everything.items() if j != i)
    test = [D.words(r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in test for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = {r["doc_id"] for r in kept[3].collect()}
    for i, t in texts.items():
        w = D.words(t.encode())
        assert (i in clean) == (not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)))
    assert {r["doc_id"] for r in kept[4].collect()} == clean
    assert {r["doc_id"] for r in kept[5].collect()} == clean and kept[5].count() == kept[4].count()
    assert p.run(spark, sf).count() == kept[5].count()


def test_stages_of_odd_tables(spark, sf, docs, empty):
    """Nulls, repeats and columns named like the stages' own: kept as they are, and every stage takes an empty table."""
    import corpus_pipeline as p

    d = docs.withColumn("is_toxic", F.lit("mine")).withColumn("toxicity", F.lit(2))
    for name, stage in p.STAGES:
        out = stage(spark, d, sf)
        assert out.where("is_toxic <> 'mine' or toxicity <> 2").count() == 0 and out.columns[: 5] == d.columns[: 5]
        if name != "sharding":
            assert out.columns == d.columns
        else:
            assert {"docs_shard", "docs_slot"} <= set(out.columns) and out.where("docs_shard <> 'x'").count() == 0
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in d.collect()} and out.where("doc_id is null").count() >= 1  # mixing may read it again
        assert stage(spark, d.limit(0), sf).count() == 0
