"""Merging a stream of files into a Parquet table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import quoted
from ..operators import merge


def watch(spark: SparkSession, folder: str, schema: T.StructType, suffix: str = "parquet") -> DataFrame:
    """The files that appear in a folder, as a stream."""
    return spark.readStream.format(suffix).schema(schema).load(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str] | None = None, order: str | None = None):
    """Append the stream's new rows to `target`, or upsert them by key with the last by `order`.

    Each batch writes a new version next to the old ones, named by the batch, so a batch that is run again
    after a failure writes the same version anew. Returns the unstarted writer.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        now = current(spark, target, before=number)
        have = spark.read.schema(df.schema).parquet(now) if now else spark.createDataFrame([], df.schema)
        if keys:
            out = merge.upsert(have, df.withColumn("_order", quoted(order) if order else F.monotonically_increasing_id()), keys, "_order")
        else:
            out = merge.append(have, df)
        out.write.mode("overwrite").parquet(f"{target}/version={number:08d}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)


def current(spark: SparkSession, target: str, before: int | None = None) -> str | None:
    """The newest finished version of the table, or the newest before a batch; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done) and (before is None or int(name[8:]) < before):
            found.append(name)
    return f"{target}/{max(found)}" if found else None
