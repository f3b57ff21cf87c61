"""Small files for the tests."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyarrow import csv, feather
from pyarrow import parquet as pq


def put(path: Path, **columns) -> Path:
    """Write columns as a CSV, Feather, Arrow or Parquet file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    found = pa.table(columns)
    if path.suffix == ".csv":
        csv.write_csv(found, path)
    elif path.suffix == ".parquet":
        pq.write_table(found, path)
    else:
        feather.write_feather(found, path)
    return path


def rows(spark, path: Path) -> list[tuple]:
    from shardwell.sources.files import read

    return [tuple(r) for r in read(spark, path).collect()]
