"""Column types: classes, schema signatures, common types and alignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
MISSING = T.NullType()


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, NESTED)


def is_time(kind: T.DataType) -> bool:
    return kind.simpleString().startswith("time(")


def is_duration(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType))


def is_datetime(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.DateType) or is_datetime(kind) or is_time(kind) or is_duration(kind)


def columns_of(schema: T.StructType) -> tuple[tuple[str, str], ...]:
    return tuple((f.name, f.dataType.simpleString()) for f in schema.fields)


def signature(columns: Iterable[tuple[str, str]]) -> str:
    """The identity of an ordered schema: SHA-256 of its names and types."""
    return hashlib.sha256("|".join(f"{n}:{t}" for n, t in columns).encode()).hexdigest()


def widened(df: DataFrame) -> DataFrame:
    """Integers of a text source as bigint, so that the same numbers have the same type in every format."""
    small = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGERS) and not isinstance(f.dataType, T.LongType)]
    return df.withColumns({n: quoted(n).cast("bigint") for n in small}) if small else df


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: wider number, timestamp over date, else string; nested types must be equal."""
    if a.simpleString() == b.simpleString() or isinstance(b, T.NullType):  # nullability aside
        return a
    if isinstance(a, T.NullType):
        return b
    if is_nested(a) or is_nested(b):
        raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")
    if isinstance(a, INTEGERS) and isinstance(b, INTEGERS):
        return max(a, b, key=lambda t: INTEGERS.index(type(t)))
    if is_numeric(a) and is_numeric(b):
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            scale = max(a.scale, b.scale)
            return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
        return T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return T.TimestampType()
    return T.StringType()


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under each other by column name; a column that frames type differently takes the
    common type, one that a frame lacks is null there. Columns stand in order of first appearance."""
    kinds: dict[str, T.DataType] = {}
    for frame in frames:
        for f in frame.schema.fields:
            kinds[f.name] = common_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    return reduce(DataFrame.unionByName, [aligned(frame, kinds) for frame in frames])


def aligned(frame: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """The columns of `kinds` in that order, missing ones as typed nulls, others cast; a value that does not
    fit fails (ANSI cast)."""
    have = {f.name: f.dataType for f in frame.schema.fields}
    out = []
    for name, kind in kinds.items():
        if name not in have:
            out.append(F.lit(None).cast(kind).alias(name))
        else:
            out.append((quoted(name) if have[name].simpleString() == kind.simpleString() else quoted(name).cast(kind)).alias(name))
    return frame.select(*out)


def kinds_of(schema: T.StructType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in schema.fields}


def no_nan(column: Column, kind: T.DataType) -> Column:
    """NaN as null, so that it neither wins a maximum nor spoils a mean."""
    return F.when(~F.isnan(column), column) if is_float(kind) else column
