"""Row order of file sources: Spark scans in no order, so order is made a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = "_order"


def order_key() -> Column:
    """Sorts rows by file path and place in the file, straight from a file scan: the start of the split, then
    the rows of the split as they were read."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def with_ordinal(df: DataFrame, order: str = ORDER, name: str = "_ordinal") -> DataFrame:
    """Replaces the order key by 0, 1, 2, ... over the whole frame. One narrow row per split is summed up in
    one task; the rows themselves are numbered where they are."""
    parts = df.groupBy(F.col(f"{order}.file").alias("_f"), F.col(f"{order}.start").alias("_s")).agg(F.min(f"{order}.row").alias("_first"), F.count("*").alias("_n"))
    before = W.orderBy("_f", "_s").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("_f", "_s", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = df.withColumns({"_f2": F.col(f"{order}.file"), "_s2": F.col(f"{order}.start"), "_row": F.col(f"{order}.row")}).drop(order)
    joined = rows.join(offsets, (F.col("_f2") == F.col("_f")) & (F.col("_s2") == F.col("_s")))
    return joined.withColumn(name, F.col("_before") + F.col("_row") - F.col("_first")).drop("_f", "_s", "_f2", "_s2", "_row", "_first", "_before")
