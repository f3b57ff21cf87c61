"""Queries by name, each with its SQL or None."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict[str, tuple[Query, str | None]]):
    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self[name or f.__name__] = f, sql
            return f

        return put


def local_folder(spark: SparkSession, what: str) -> Path:
    """A folder for single files, which local tools write: for the queries about files."""
    path = Path(shared_path(spark, what).removeprefix("file://").removeprefix("file:"))
    path.mkdir(parents=True)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
