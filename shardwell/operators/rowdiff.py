"""Keyed row comparison by one null-safe full outer join."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import quoted


class DiffError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often. Null keys are equal to each other."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("n")).filter("n > 1")


def check_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Keys must be named once, exist on both sides with one type, and be unique on each side."""
    if not keys:
        raise DiffError("Row comparison needs at least one key column")
    if len(set(keys)) < len(keys):
        raise DiffError("Key columns must not repeat")
    for name, side in (("left", left), ("right", right)):
        if missing := [k for k in keys if k not in side.columns]:
            raise DiffError(f"Key columns not found on the {name} side: {', '.join(missing)}")
    if unlike := [k for k in keys if left.schema[k].dataType != right.schema[k].dataType]:
        raise DiffError(f"Key columns of different types: {', '.join(unlike)}")
    for name, side in (("left", left), ("right", right)):
        if (found := duplicate_keys(side, keys).limit(1).collect()):
            raise DiffError(f"Duplicate key rows detected on the {name} side: {found[0].asDict()}")


def changed(left: Column, right: Column, same_type: bool) -> Column:
    """Whether a value differs: nulls are equal, NaN is equal to NaN, values of different types go as strings."""
    return ~left.eqNullSafe(right) if same_type else ~left.cast("string").eqNullSafe(right.cast("string"))


@dataclass
class RowDiff:
    """A joined comparison: key columns k0.., l.* and r.* payload structs, in_left, in_right, is_changed."""

    keys: list[str]
    payload: list[str]
    joined: DataFrame

    def summary(self, by: str | None = None) -> DataFrame:
        """added, removed, updated, unchanged in one row, or in a row for each value of the key column `by`."""
        both = F.col("in_left") & F.col("in_right")
        rows = self.joined.groupBy(F.col(f"k{self.keys.index(by)}").alias(by)) if by else self.joined
        return rows.agg(
            F.count_if(~F.col("in_left")).alias("added"),
            F.count_if(~F.col("in_right")).alias("removed"),
            F.count_if(both & F.col("is_changed")).alias("updated"),
            F.count_if(both & ~F.col("is_changed")).alias("unchanged"),
        )

    def _keys(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(self.keys)])

    def added(self) -> DataFrame:
        return self._keys(self.joined.filter("not in_left"))

    def removed(self) -> DataFrame:
        return self._keys(self.joined.filter("not in_right"))

    def updated(self) -> DataFrame:
        """Keys of changed rows and deltas: an array of (column, left, right), values as text.

        Deltas compare values, not text, so a row that changed only in type has none."""
        rows = self.joined.filter("in_left and in_right and is_changed")
        deltas = F.array(*[F.when(self._unlike(p), F.struct(F.lit(p).alias("column"), self._side("l", p).cast("string").alias("left"), self._side("r", p).cast("string").alias("right"))) for p in self.payload])
        kept = F.filter(deltas, lambda d: d.isNotNull()) if self.payload else F.array()
        return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(self.keys)], kept.alias("deltas"))

    def _side(self, side: str, name: str) -> Column:
        return F.col(side)[name]

    def _unlike(self, name: str) -> Column:
        left, right = (self.joined.schema[s].dataType[name].dataType for s in "lr")
        if left == right:
            return changed(self._side("l", name), self._side("r", name), True)
        try:
            numbers = self._side("l", name).cast("double"), self._side("r", name).cast("double")
            if all(hasattr(t, "json") and t.typeName() in NUMBERS for t in (left, right)):
                return changed(*numbers, True)
        except TypeError:
            pass
        return changed(self._side("l", name), self._side("r", name), False)

    def changes(self) -> RowDiff:
        """The comparison without unchanged rows."""
        return RowDiff(self.keys, self.payload, self.joined.filter("not in_left or not in_right or is_changed"))

    def examples(self, n: int) -> dict[str, list]:
        """At most n rows of each kind, the smallest keys first."""
        order = [F.col(f"`{k}`").asc_nulls_first() for k in self.keys]
        return {kind: getattr(self, kind)().orderBy(*order).limit(n).collect() for kind in ("added", "removed", "updated")}


def compare_files(left: DataFrame, right: DataFrame, file_col: str, keys: list[str], check: bool = True) -> RowDiff:
    """compare() within each file of two frames tagged with their file; files of one side only are not compared. One
    join over all files, so a folder of many files is one job."""
    files = left.select(file_col).distinct().join(right.select(file_col).distinct(), file_col, "left_semi")
    a, b = (df.join(files, file_col, "left_semi") for df in (left, right))
    return compare(a, b, [file_col, *keys], check)


NUMBERS = {"byte", "short", "integer", "long", "float", "double", "decimal"}


def compare(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> RowDiff:
    """Compare rows by key. Payload is every other column of either side; a column that a side lacks is null
    there. With `check`, keys are checked first, which groups each side by key: the shuffle that the join
    needs too."""
    if check:
        check_keys(left, right, keys)
    payload = sorted((set(left.columns) | set(right.columns)) - set(keys))

    def side(df: DataFrame, name: str) -> DataFrame:
        struct = F.struct(*[(quoted(p) if p in df.columns else F.lit(None).cast("string")).alias(p) for p in payload], F.lit(True).alias("_here"))
        return df.select(*[quoted(k).alias(f"{name}k{i}") for i, k in enumerate(keys)], struct.alias(name))

    a, b = side(left, "l"), side(right, "r")
    on = reduce(lambda x, y: x & y, [F.col(f"lk{i}").eqNullSafe(F.col(f"rk{i}")) for i in range(len(keys))])
    joined = a.join(b, on, "full_outer")
    have = {p: p in left.columns and p in right.columns and left.schema[p].dataType == right.schema[p].dataType for p in payload}
    differ = reduce(lambda x, y: x | y, [changed(F.col("l")[p], F.col("r")[p], have[p]) for p in payload], F.lit(False))
    here = lambda s: F.col(s).isNotNull() & F.coalesce(F.col(s)["_here"], F.lit(False))
    return RowDiff(keys, payload, joined.select(*[F.when(here("l"), F.col(f"lk{i}")).otherwise(F.col(f"rk{i}")).alias(f"k{i}") for i in range(len(keys))], "l", "r", here("l").alias("in_left"), here("r").alias("in_right"), differ.alias("is_changed")))
