"""A digest of a column that depends on the order of its rows and yet adds up in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import is_duration, is_nested

NULL = "<NULL>"


def digestible(kind: T.DataType) -> bool:
    return not (is_nested(kind) or is_duration(kind))


def as_text(column: Column, kind: T.DataType) -> Column:
    return F.lower(F.hex(column)) if isinstance(kind, T.BinaryType) else column.cast("string")


def digest(ordinal: Column, column: Column, kind: T.DataType) -> Column:
    """An aggregate: the sum over rows of 60-bit SHA-256 pieces of ordinal and value, as text.

    Each row's piece holds its ordinal, so moving a value changes the sum; sums commute, so Spark may add
    partial ones. A null is told from any text by a prefix.
    """
    value = F.when(column.isNull(), F.lit(NULL)).otherwise(F.concat(F.lit("="), as_text(column, kind)))
    hashed = F.sha2(F.concat_ws(":", ordinal.cast("string"), value).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    return F.concat_ws("-", *[F.coalesce(p, F.lit(0).cast("decimal(38,0)")).cast("string") for p in parts], F.count(F.lit(1)).cast("string"))
