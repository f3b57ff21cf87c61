"""Merging a source into a target: append, upsert, conflicts and previews. All joins are null-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import aligned, kinds_of, quoted


class MergeError(ValueError):
    pass


def _same(columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"s.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in columns])


def not_in(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """Source rows whose columns occur nowhere in the target.

    Over many columns the join goes by one 64-bit hash first, and the columns are compared behind it."""
    if len(columns) > 3:
        mixed = lambda df: df.withColumn("_hash", F.xxhash64(*[quoted(c) for c in columns]))
        found = mixed(source).alias("s").join(mixed(target).alias("t"), (F.col("s._hash") == F.col("t._hash")) & _same(columns), "left_anti")
        return found.drop("_hash")
    return source.alias("s").join(target.alias("t"), _same(columns), "left_anti")


def effective_schema(target: T.StructType, source: T.StructType, additive: bool) -> T.StructType:
    """The result's columns. Strict: both sides name the same columns in the same order. Additive: the
    target's, then those that only the source has. A shared column must have one type."""
    if not additive and target.names != source.names:
        raise MergeError("Schemas differ: strict merging needs the same columns in the same order")
    if unlike := [f"{f.name} ({f.dataType.simpleString()} and {target[f.name].dataType.simpleString()})" for f in source.fields if f.name in target.names and target[f.name].dataType != f.dataType]:
        raise MergeError(f"Column types differ: {', '.join(unlike)}")
    return T.StructType([*target.fields, *(f for f in source.fields if f.name not in target.names)])


def _prepared(target: DataFrame, source: DataFrame, additive: bool, order: str | None) -> tuple[DataFrame, DataFrame, list[str]]:
    plain = [df.drop(order) if order else df for df in (target, source)]
    schema = effective_schema(plain[0].schema, plain[1].schema, additive)
    kinds = kinds_of(schema)
    known = lambda df: kinds | ({order: df.schema[order].dataType} if order in df.columns else {})
    return aligned(target, known(target)), aligned(source, known(source)), schema.names


def _stacked(kept: DataFrame, new: DataFrame, names: list[str], order: str | None) -> DataFrame:
    """The kept rows and the new ones, in that order and each in its own if there is an order column."""
    if order is None:
        return kept.unionAll(new)
    both = kept.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return both.orderBy("_side", quoted(order)).select(*[quoted(n) for n in names])


def append(target: DataFrame, source: DataFrame, additive: bool = False, order: str | None = None) -> DataFrame:
    """All target rows, duplicates too, then the distinct source rows that the target lacks. With `order`, a column of
    both sides that is no part of the result, rows stand in that order."""
    t, s, names = _prepared(target, source, additive, order)
    new = not_in(s, t.drop(order) if order else t, names)
    new = new.groupBy(*[quoted(n) for n in names]).agg(F.min(quoted(order)).alias(order)) if order else new.distinct()
    return _stacked(t, new, names, order)


def last_by_key(source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by the order column. A hot key costs one narrow aggregate slot, not a sort."""
    row = F.struct(*[quoted(c) for c in source.columns])
    return source.groupBy(*[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, quoted(order)).alias("_row")).select("_row.*")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: str, additive: bool = False) -> DataFrame:
    """Target rows whose key the source lacks, then the source with the last row of each key. `order` tells the source's
    row order and is no part of the result; if the target has it too, rows stand in that order."""
    if not keys:
        raise MergeError("Upsert needs key columns")
    ordered = order in target.columns
    last = last_by_key(source, keys, order)
    t, s, names = _prepared(target, last if ordered else last.drop(order), additive, order if ordered else None)
    return _stacked(not_in(t, s, keys), s, names, order if ordered else None)


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one payload (a payload of nulls counts); with key columns only, any repeated key."""
    payload = [c for c in df.columns if c not in keys]
    if not payload:
        return df.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("variants")).filter("variants > 1")
    # distinct first: it combines on the map side, and a hot key's equal rows vanish before the second count
    return df.distinct().groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("variants")).filter("variants > 1")


def check_conflicts(df: DataFrame, keys: list[str]) -> None:
    if found := conflicts(df, keys).limit(1).collect():
        raise MergeError(f"Conflicting duplicate key: {({k: found[0][k] for k in keys})}")


def preview_append(target: DataFrame, source: DataFrame, additive: bool = False) -> DataFrame:
    """target_rows, source_rows and insert_rows. Rows to insert count repeats that append() then drops."""
    t, s, names = _prepared(target, source, additive, None)
    counts = lambda df, n: df.agg(F.count("*").alias(n))
    return counts(t, "target_rows").crossJoin(counts(s, "source_rows")).crossJoin(counts(not_in(s, t, names), "insert_rows"))  # one row each


def preview_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target_rows, source_keys, replace_rows (target rows whose key the source has) and insert_rows (distinct
    source keys that the target lacks)."""
    t = target.select(*[quoted(k) for k in keys])
    s = source.select(*[quoted(k) for k in keys]).distinct()
    counts = lambda df, n: df.agg(F.count("*").alias(n))
    replaced = t.alias("t").join(s.alias("s"), _same(keys), "left_semi")
    return counts(t, "target_rows").crossJoin(counts(s, "source_keys")).crossJoin(counts(replaced, "replace_rows")).crossJoin(counts(not_in(s, t, keys), "insert_rows"))


def ordered(source: DataFrame, *order: str, name: str = "_order") -> DataFrame:
    """Adds an order column for upsert() from columns that tell the row order."""
    return source.withColumn(name, F.struct(*[quoted(c) for c in order]))


