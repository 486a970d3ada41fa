"""Native operators run no Python on executors; texts are not shuffled where they need not be."""

import pytest

from tessitura.llm import mixing, sharding
from tessitura.llm.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_sharding", "op2_mixing"])
def test_native(name, spark, sf):
    p = plan(QUERIES[name](spark, sf))
    assert not any(x in p for x in ("Python", "Pandas", "Arrow", "text#"))


def test_stored_shards_shuffle_no_texts(spark, sf):
    p = plan(sharding.shard_stored(spark.read.parquet(f"{sf}/documents.parquet"), 24))
    assert not any(x in p for x in ("Python", "Pandas", "Arrow", "Exchange hashpartitioning(__row", "SortMergeJoin"))


def test_what_is_stored_has_no_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert "text" not in mixing.tokens(docs).columns
    assert sharding.shard_by_bytes(docs, 3).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
