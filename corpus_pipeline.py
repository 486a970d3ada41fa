"""From raw documents to training shards: each stage reads what its predecessor kept, as Parquet.

1. toxicity: documents that the classifier chain finds toxic go.
2. near_duplicates: one document of each group of near copies stays (5-word shingles, similarity 0.8 or more).
3. decontamination: documents that hold a 10-word window of a benchmark item go.
4. mixing: smaller sources are read again until each has its weight, and rows are written in the order of the mix,
   block by block; no document is left out.
5. sharding: 24 contiguous shards of near-equal bytes, cut in that order, so each holds the mix; with the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import decontamination, mixing, sharding, simhash, toxicity
from tessitura.llm._shared import col, materialize, table

N_SHARDS = 24


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row travels as one struct, so columns of docs called like the verdict's stay as they are
    whole = docs.select(F.struct(*map(col, docs.columns)).alias("__row"), "doc_id", "text")
    return toxicity.classify(whole, table(spark, sf_dir, "labels")).where("not is_toxic").select("__row.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_similar(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, entropy_share=0.95, repetition_limit=2.0)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_stored(docs, N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier and SimHash have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
