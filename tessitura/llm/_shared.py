"""What the corpus operators share: the folder all executors see, tables written there, Arrow limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session (tests) has one of its own; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tessitura-"))
    return _OWN_DIR[0]


def run_dir(spark: SparkSession) -> str:
    """Where this application's tables go."""
    return f"{shared_dir(spark)}/tessitura/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all that this application stored. Results read stored tables lazily: call it when they are written."""
    _delete(spark, run_dir(spark))


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the run's folder that nothing has yet."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` returned and that nothing reads any more."""
    if path := getattr(df, "_stored_at", None):
        _delete(df.sparkSession, path)


def arrow_limits(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Bound the Arrow batches sent to Python by rows and by bytes, so long texts can't blow a worker up.

    Plans read these settings when they run, which for a lazy result is after this returns; so they stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than a row in so many is joined by broadcast: there are fewer than this of them, however large the table.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join on a key that may hold a large share of rows; by_key has one row a key and, in ``count``, its number of rows.

    Both must be stored tables. Keys over 1 / HOT_SHARE of all rows, fewer than HOT_SHARE, are broadcast, so their
    rows stay where they are; the others are shuffled, no task getting more than that share for one key.
    """
    total = by_key.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = by_key.where(F.col(count) * HOT_SHARE > total).drop(count)
    cold = by_key.where(F.col(count) * HOT_SHARE <= total).drop(count)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns ``__id_text, __no_id, __text_hash`` that tell rows apart by id, nulls among them, and text."""
    return [F.coalesce(col(id_col).cast("string"), F.lit("")).alias("__id_text"), col(id_col).isNull().alias("__no_id"), F.xxhash64(col(text_col)).alias("__text_hash")]


ROW_KEY = ["__id_text", "__no_id", "__text_hash"]


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct ``__row``, so that they can't clash with working columns."""
    return F.struct(*map(col, docs.columns)).alias("__row")
