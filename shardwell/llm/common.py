"""Helpers shared by the corpus operators: shared scratch space and Arrow text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = re.compile(rb"[\x20\x09-\x0d]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session that has none (a test) gets a temporary folder; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shardwell-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, below a folder that goes when the application ends."""
    context = spark.sparkContext
    own = f"{shared_root(spark)}/shardwell/{context.applicationId}"
    if getattr(context, "_shardwell_scratch", None) != own:
        path, fs = _path(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        context._shardwell_scratch = own
    return f"{own}/{what}-{uuid.uuid4().hex}"


class Scope:
    """Tables that cut() writes while the scope is open are deleted when it closes, but for those kept."""

    open: list[Scope] = []

    def __init__(self) -> None:
        self.written: dict[str, SparkSession] = {}

    def __enter__(self) -> Scope:
        Scope.open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """A table that stays, or goes with the scope around this one."""
        for path in [p for p in self.written if any(f"/{p.rpartition('/')[2]}/" in f for f in df.inputFiles())]:
            spark = self.written.pop(path)
            if len(Scope.open) > 1:
                Scope.open[-2].written[path] = spark
        return df

    def __exit__(self, *_) -> None:
        Scope.open.remove(self)
        for name, spark in self.written.items():
            path, fs = _path(spark, name)
            fs.delete(path, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    if Scope.open:
        Scope.open[-1].written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote, once nothing reads it."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/shardwell/" in folder:
            path, fs = _path(spark, folder)
            fs.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8(column) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of an Arrow string array, without a copy."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if buffers[1] is None or not len(column):
        return memoryview(b""), np.zeros(len(column) + 1, kind), np.zeros(len(column), bool)
    offsets = np.frombuffer(buffers[1], dtype=kind, count=column.offset + len(column) + 1)[column.offset :]
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    return data, offsets, column.is_valid().to_numpy(zero_copy_only=False)


def texts(column) -> Iterator[bytes | None]:
    """Each value of an Arrow string array as UTF-8 bytes; None for null."""
    data, offsets, valid = utf8(column)
    for i in range(len(column)):
        yield bytes(data[offsets[i] : offsets[i + 1]]) if valid[i] else None


def pieces(data: bytes, most: int = 1 << 22) -> Iterator[bytes]:
    """A text in pieces of about `most` bytes, cut at white space, so that one huge text stays bounded."""
    at = 0
    while at < len(data):
        found = SPACE.search(data, at + most) if at + most < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def remainder(column: str, modulus: int):
    """crc32 of an id written as text, modulo `modulus`: the fold rule of the learning operators."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
