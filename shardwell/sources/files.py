"""Datasets on disk: resolving a path, listing its files, reading and writing them by suffix."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from enum import StrEnum
from pathlib import Path, PurePosixPath
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordinal import ORDER, order_key
from ..functions.types import union_relaxed, widened
from ..session import settings
from .arrow import FILE, ROW, read_arrow, write_arrow
from .paths import AnyPath, StorePath, move, place, remove

SUFFIXES = (".csv", ".feather", ".arrow", ".parquet")
SOURCE_FILE = "_source_file"
METADATA, DATA = "metadata.json", "data"


class SourceError(ValueError):
    pass


class Kind(StrEnum):
    FILE = "file"
    FOLDER = "folder"
    COMPILED = "compiled_dataset"


@dataclass(frozen=True)
class Dataset:
    path: AnyPath
    kind: Kind

    def files(self) -> list[AnyPath]:
        """Sorted files: the file itself, a compiled dataset's parts, or a folder's supported files at any depth."""
        if self.kind is Kind.FILE:
            return [self.path]
        if self.kind is Kind.COMPILED:
            return sorted((self.path / DATA).glob("*.parquet"))
        return sorted(p for p in self.path.rglob("*") if p.is_file() and p.suffix.lower() in SUFFIXES)

    def relative(self, file: AnyPath) -> str:
        return file.name if self.kind is Kind.FILE else file.relative_to(self.path).as_posix()


def is_compiled(path: AnyPath) -> bool:
    return (path / METADATA).is_file() and (path / DATA).is_dir()


def resolve(path: str | os.PathLike) -> Dataset:
    found = place(path)
    if not found.exists():
        raise SourceError(f"Source does not exist: {path}")
    if found.is_file():
        if found.suffix.lower() not in SUFFIXES:
            raise SourceError(f"Unsupported file type: {found.suffix or found.name}")
        return Dataset(found, Kind.FILE)
    dataset = Dataset(found, Kind.COMPILED if is_compiled(found) else Kind.FOLDER)
    if not dataset.files():
        raise SourceError(f"No supported files in {path}")
    return dataset


# How CSV is read: a value that is not there is null, one that is quoted and empty is empty.
CSV = {"header": True, "escape": '"', "nullValue": "\0", "emptyValue": ""}

#: What is known of CSV files, by path, size and time: a file is looked over once, however often it is read.
_LAYOUTS: dict[tuple, tuple[T.StructType, bool]] = {}


def csv_layout(spark: SparkSession, name: str) -> tuple[T.StructType, bool]:
    """The schema of a CSV file, types inferred from all rows and integers as bigint, and whether quoted values hold
    line breaks. Such files are read whole by a task; all others are split. A value holds a line break if some line
    has an odd number of quotes."""
    path = place(name)
    key = (name, *((s.st_size, s.st_mtime_ns) if path.is_file() and (s := path.stat()) else ()))
    if key in _LAYOUTS:
        return _LAYOUTS[key]
    odd = F.length("value") - F.length(F.replace("value", F.lit('"')))
    broken = not spark.read.text(name).filter(F.pmod(odd, F.lit(2)) == 1).isEmpty()
    with settings(spark, spark__sql__timestampType="TIMESTAMP_NTZ"):
        schema = widened(spark.read.csv(name, inferSchema=True, multiLine=broken, **CSV)).schema
    if len(key) > 1:
        if len(_LAYOUTS) >= 10_000:
            _LAYOUTS.clear()
        _LAYOUTS[key] = schema, broken
    return schema, broken


def read(spark: SparkSession, path: str | os.PathLike, ordered: bool = False) -> DataFrame:
    """A file as a frame. CSV types are inferred, dates and naive times too, and integers are bigint; quoted values
    may hold line breaks and quotes. With `ordered`, a column ORDER sorts the rows as they stand in the file."""
    name, suffix = str(path), PurePosixPath(str(path)).suffix.lower()
    if suffix == ".csv":
        schema, broken = csv_layout(spark, name)
        df = spark.read.csv(name, schema=schema, multiLine=broken, **CSV)
    elif suffix == ".parquet":
        with settings(spark, spark__sql__legacy__parquet__nanosAsLong="true", spark__sql__timeType__enabled="true"):
            df = spark.read.parquet(name)
    elif suffix in (".feather", ".arrow"):
        if isinstance(place(path), StorePath):
            raise SourceError(f"Arrow files are read from local or mounted paths only: {name}")
        df = read_arrow(spark, [name], tagged=ordered)
        return df.withColumn(ORDER, F.struct(F.col(FILE).alias("file"), F.lit(0).cast("bigint").alias("start"), F.col(ROW).alias("row"))).drop(FILE, ROW) if ordered else df
    else:
        raise SourceError(f"Unsupported file type: {suffix or name}")
    return df.withColumn(ORDER, order_key()) if ordered else df


def read_all(spark: SparkSession, dataset: Dataset, files: list[AnyPath] | None = None, tagged: bool = False, ordered: bool = False) -> DataFrame:
    """All files under each other by name and common type; `tagged` adds the relative path of each row's file.
    Parquet files of a compiled dataset, all of one schema, are one scan."""
    paths = dataset.files() if files is None else files
    if dataset.kind is Kind.COMPILED and not tagged and not ordered:
        return spark.read.parquet(*map(str, paths))
    frames = [read(spark, p, ordered) for p in paths]
    if tagged:
        frames = [f.withColumn(SOURCE_FILE, F.lit(dataset.relative(p))) for f, p in zip(frames, paths, strict=True)]
    return union_relaxed(frames)


def rows_of(spark: SparkSession, paths: list[AnyPath]) -> dict[AnyPath, int]:
    """How many rows files of one format hold, in one job; a file without rows may be missing. Of Parquet only the
    footers are read."""
    names, suffix = [str(p) for p in paths], paths[0].suffix.lower()
    if suffix in (".feather", ".arrow"):
        found = read_arrow(spark, names, tagged=True, bare=True).groupBy(FILE).count().collect()
        return {Path(r[FILE]): r["count"] for r in found}
    if suffix == ".csv":
        df = spark.read.csv(names, schema="_first string", multiLine=csv_layout(spark, names[0])[1], enforceSchema=True, **CSV)
    else:
        df = spark.read.schema(T.StructType([])).parquet(*names)
    rows = df.groupBy(F.col("_metadata.file_path").alias("path")).count().collect()
    # a store may write its own URIs otherwise than they were given; the end of the path stays
    known = {p.as_posix() if isinstance(p, Path) else urlsplit(str(p)).path: p for p in paths}
    return {known[next(k for k in _ends(unquote(urlsplit(r["path"]).path)) if k in known)]: r["count"] for r in rows}


def _ends(path: str) -> Iterator[str]:
    """A path and what is left of it without its first folders."""
    yield path
    while path.count("/") > 1:
        path = "/" + path.split("/", 2)[2]
        yield path


def write(df: DataFrame, path: str | os.PathLike) -> None:
    """Write one file by suffix, through a staging folder beside it, so that it appears whole."""
    target = place(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    suffix = target.suffix.lower()
    stage = target.parent / f".stage-{uuid.uuid4().hex}"
    try:
        if suffix in (".feather", ".arrow"):
            if isinstance(target, StorePath):
                raise SourceError(f"Arrow files are written to local or mounted paths only: {target}")
            stage.mkdir()
            write_arrow(df, str(stage / "part"))
            part = stage / "part"
        elif suffix == ".csv":
            # an empty text is quoted, so that it is told from null; a null in a file of one column is a blank line, which
            # readers of CSV pass over
            df.coalesce(1).write.csv(str(stage), header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
            part = next(stage.glob("part-*"), None)
        elif suffix == ".parquet":
            df.coalesce(1).write.parquet(str(stage))
            part = next(stage.glob("part-*"), None)
        else:
            raise SourceError(f"Unsupported file type: {suffix or target.name}")
        if part is None:  # a CSV without rows has no part
            part = stage / "part"
            part.write_text(",".join(df.columns) + "\n")
        move(part, target)
    finally:
        remove(stage)


PART_BYTES = 256 << 20


def write_parts(df: DataFrame, folder: AnyPath, bytes_per_row: float = 64.0) -> None:
    """Parquet parts named part-000 on, in the frame's order of partitions, of about PART_BYTES at most by the bytes
    that a row takes in the source."""
    rows_per_file = max(1000, int(PART_BYTES / max(bytes_per_row, 1.0)))
    stage = folder.parent / f".stage-{uuid.uuid4().hex}"
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(str(stage))
        folder.mkdir(parents=True, exist_ok=True)
        for i, part in enumerate(sorted(stage.glob("part-*"))):
            move(part, folder / f"part-{i:03d}.parquet")
    finally:
        remove(stage)


def metadata(dataset: Dataset) -> dict | None:
    """The metadata of a compiled dataset; None if it cannot be read."""
    try:
        found = json.loads((dataset.path / METADATA).read_text())
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def content_hashes(spark: SparkSession, paths: list[AnyPath]) -> dict[str, str]:
    """SHA-256 of many files, hashed on the executors: local files in pieces, whatever their size, those of a store as
    Spark reads them, under 2 GB each."""
    if not paths:
        return {}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                with open(name, "rb") as f:
                    found.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "hash"])

    if any(isinstance(p, StorePath) for p in paths):
        known = {urlsplit(str(p)).path: str(p) for p in paths}
        rows = spark.read.format("binaryFile").load([str(p) for p in dict.fromkeys(paths)]).select("path", F.sha2("content", 256).alias("hash")).collect()
        return {known[next(k for k in _ends(unquote(urlsplit(r["path"]).path)) if k in known)]: r["hash"] for r in rows}
    names = spark.createDataFrame([(str(p),) for p in dict.fromkeys(paths)], "path string")
    rows = names.repartition(min(len(paths), 256)).mapInArrow(run, "path string, hash string").collect()
    return {r.path: r.hash for r in rows}


