"""Contiguous shards of near-equal bytes, cut from a global prefix sum that never passes through one task.

Rows have one total order. Per-partition totals of it (one row a partition) are prefix-summed and broadcast; the
running sum inside a partition gives each row its byte offset in the whole table, and the shard is the equal-width
cut that the offset falls in. There are two orders:

* by id, checksum and size: rows are put in it by a range partitioning that is written down once, so every later
  pass sees the same buckets. Only ids, sizes and checksums are shuffled, never texts.
* as stored: the files of a table in order of their part number, and the rows in each. Offsets come from a narrow
  shuffle of sizes; the rows themselves are read once more and meet only their file's and the shards' first places,
  so nothing of them is shuffled.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm._shared import col, materialize, partitions, whole_row

#: A row's bytes besides its text: the 8 of its id.
ROW_OVERHEAD = 8


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)


def _checksum(text: Column) -> Column:
    return F.coalesce(F.crc32(text), F.lit(0)).cast("long")


def cut(start: str, total: str, n_shards: int) -> Column:
    """The shard of a byte offset; the product is a decimal, as offset times shards may pass 64 bits."""
    return F.expr(f"cast(least({n_shards - 1}L, (cast({start} as decimal(20, 0)) * cast({n_shards} as decimal(10, 0))) div cast({total} as decimal(20, 0))) as int)")


def _totals(dealt: DataFrame, bucket: str, size: str) -> DataFrame:
    """Of each bucket, in order: bytes and rows before it, and the bytes of all. A row a bucket."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.groupBy(bucket).agg(F.sum(size).alias("__b"), F.count(F.lit(1)).alias("__n")).select(
        bucket, F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__bytes_before"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__b").over(Window.partitionBy(F.lit(0))).alias("__total"),
    )


def _check(n_shards: int) -> None:
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")


def shard_by_bytes(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``id_col, size, text_crc32, shard, slot``, a row for each input row, cut in order of id.

    size: UTF-8 bytes of the text plus 8; a null text has none and checksum 0. shard: 0 to n_shards - 1, contiguous
    in (id, checksum, size), no shard further than one row's size from the mean; slot: gapless from 0 in each shard.
    Null ids come first. Rows equal in all three order columns are alike, so their order does not matter. An empty
    table gives an empty result. Other columns of docs are ignored, whatever their names.
    """
    _check(n_shards)
    text = col(text_col)
    # written down first, so that the range partitioner samples 20 bytes a row and not texts
    narrow = materialize(docs.select(col(id_col).alias("__id"), _size(text).alias("__size"), _checksum(text).alias("__crc")), "shard-sizes")
    order = ["__id", "__crc", "__size"]
    dealt = narrow.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("__bucket", F.spark_partition_id())
    dealt = materialize(dealt, "shard-buckets")
    inside = Window.partitionBy("__bucket").orderBy(*order)
    start = F.col("__bytes_before") + F.coalesce(F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        dealt.join(F.broadcast(_totals(dealt, "__bucket", "__size")), "__bucket")
        .withColumn("__start", start)
        .withColumn("__rank", F.col("__rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", cut("__start", "__total", n_shards))
    )
    first = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "shard", (F.col("__rank") - F.col("__first")).cast("long").alias("slot"),
    )


def _stored(docs: DataFrame) -> DataFrame:
    """``__file, __at, __row``: number of the part file, place in it, and all columns. What isn't read from files is stored first."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(F.coalesce(F.regexp_extract(place["file_name"], r"part-(\d+)", 1).try_cast("long"), F.lit(-1)).alias("__part"), place["file_path"].alias("__path"), place["row_index"].alias("__at"), whole_row(docs))
    except AnalysisException:
        return _stored(materialize(docs, "shard-rows"))


#: The columns that ``shard_stored`` adds.
ADDED = ["size", "text_crc32", "shard", "slot"]


def shard_stored(docs: DataFrame, n_shards: int, *, text_col: str = "text") -> DataFrame:
    """Return the columns of docs, then ``size, text_crc32, shard, slot``, a row for each input row, cut in stored order.

    Sizes, shards and slots are as in ``shard_by_bytes``, but the order is that of docs' part files and of the rows in
    them. A column of docs called like an added one is kept under its name with ``docs_`` before it, as often as it
    takes to be unlike all others. An empty table gives an empty result.
    """
    _check(n_shards)
    rows = _stored(docs)
    file, text = ["__part", "__path"], F.col("__row").getField(text_col)
    narrow = materialize(rows.select(*file, "__at", _size(text).alias("__size")), "shard-sizes")
    files = narrow.groupBy(*file).agg(F.count(F.lit(1)).alias("n"), F.max("__at").alias("last"), F.sum("__at").alias("places"))
    # one row a file; numbered in order
    files = materialize(files.withColumn("__bucket", F.row_number().over(Window.orderBy(*file))), "shard-files")
    dealt = narrow.join(F.broadcast(files.select(*file, "__bucket")), file)
    if not files.where("n <> last + 1 or 2 * places <> n * last").isEmpty():
        # docs are not all rows of their files, so a place does not tell how many came before: rows meet their number
        numbered = dealt.withColumn("__nth", F.row_number().over(Window.partitionBy("__bucket").orderBy("__at")).cast("long") - 1)
        dealt = materialize(numbered, "shard-numbers")
        rows = rows.join(dealt.select(*file, "__at", "__nth"), [*file, "__at"]).drop("__at").withColumnRenamed("__nth", "__at")
        dealt = dealt.drop("__at").withColumnRenamed("__nth", "__at")
    totals = materialize(_totals(dealt, "__bucket", "__size"), "shard-totals")
    inside = Window.partitionBy("__bucket").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__bytes_before") + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    shard_at = dealt.drop(*file).join(F.broadcast(totals), "__bucket").withColumn("__start", start).select("__bucket", "__at", (F.col("__rows_before") + F.col("__at")).alias("__rank"), cut("__start", "__total", n_shards).alias("shard"))
    # where shards begin in each file: a row a file and a row a shard
    begins = materialize(shard_at.groupBy("__bucket", "shard").agg(F.min("__at").alias("at"), F.min("__rank").alias("rank")), "shard-begins")
    firsts = begins.groupBy("shard").agg(F.min("rank").alias("first"))
    by_file = begins.join(F.broadcast(firsts), "shard").groupBy("__bucket").agg(F.array_sort(F.collect_list(F.struct("at", "shard", "rank", "first"))).alias("__begins"))
    own = F.element_at(F.filter("__begins", lambda b: b["at"] <= F.col("__at")), -1)
    placed = rows.join(F.broadcast(files.select(*file, "__bucket").join(by_file, "__bucket").drop("__bucket")), file).withColumn("__own", own)
    slot = F.col("__own.rank") - F.col("__own.first") + F.col("__at") - F.col("__own.at")
    taken, kept = set(ADDED) | set(docs.columns), []
    for name in docs.columns:
        new = name
        while new in ADDED or new != name and new in taken:
            new = f"docs_{new}"
        taken.add(new)
        kept.append(F.col("__row").getField(name).alias(new))
    return placed.select(*kept, _size(text).alias("size"), _checksum(text).alias("text_crc32"), F.col("__own.shard").alias("shard"), slot.alias("slot"))
