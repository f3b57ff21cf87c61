"""The first rows of a file, a compiled dataset, or of each of a folder's files."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession

from ..sources.files import Dataset, Kind, SourceError, read
from ..sources.paths import AnyPath


def first_rows(spark: SparkSession, paths: list[AnyPath], n: int) -> list[Row]:
    """The first n rows of files one after another. Spark takes a file's splits in their order, and more of them only
    until there are enough rows, so neither a long file nor the files after it are read through."""
    out: list[Row] = []
    for path in paths:
        if len(out) >= n:
            break
        out += read(spark, path).take(n - len(out))
    return out


def head_dataset(spark: SparkSession, dataset: Dataset, n: int) -> list[tuple[str, list[Row]]]:
    """(name, rows): the first n rows of a file or compiled dataset; of a folder the first row of each of the
    first n files by path."""
    if n < 0:
        raise SourceError("--n must not be negative")
    if dataset.kind is not Kind.FOLDER:
        return [(dataset.path.name, first_rows(spark, dataset.files(), n))]
    return [(dataset.relative(p), first_rows(spark, [p], 1)) for p in dataset.files()[:n]]
