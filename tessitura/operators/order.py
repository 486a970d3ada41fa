"""Dense numbers in a global order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.sources.scratch import materialize


def numbered(df: DataFrame, order: list[str | Column], name: str = "i") -> DataFrame:
    """df with ``name`` (long): the place of each row from 0, gapless, by ``order`` (ties in any order).

    The rows are range-partitioned, sorted and stored once, so that sizes and places are read off the same files: a
    second run of the partitioning would sample other bounds. A row's number is its place in its file and the rows of
    the files before, which are joined (a row a file).
    """
    stored = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order), "numbered")
    place = stored.metadataColumn("_metadata")
    at = stored.select("*", place["file_name"].alias("__file"), place["row_index"].alias("__at"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # of a row a file; their names begin with the partition's number
    sizes = at.groupBy("__file").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return at.join(F.broadcast(sizes), "__file").withColumn(name, F.col("__before") + F.col("__at")).drop("__file", "__at", "__before")
