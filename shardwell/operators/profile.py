"""Column profiles: every statistic of every column in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import digest, digestible
from ..functions.histogram import MOST_BINS, finite
from ..functions.types import is_datetime, is_float, is_nested, is_numeric, is_temporal, no_nan, quoted
from .quantiles import column_medians

STATISTICS = ("null_rate", "min", "max", "n", "mean", "median", "stddev", "unique")
ISO = {"timestamp": "yyyy-MM-dd'T'HH:mm:ss{}xxx", "timestamp_ntz": "yyyy-MM-dd'T'HH:mm:ss{}"}


def iso(column: Column, kind: T.DataType) -> Column:
    """A temporal value as ISO text: fractions only where there are some, an offset for zoned times."""
    if is_datetime(kind):
        pattern = ISO[kind.typeName()]
        return F.when(F.date_format(column, "SSSSSS") == "000000", F.date_format(column, pattern.format(""))).otherwise(F.date_format(column, pattern.format(".SSSSSS")))
    if isinstance(kind, T.DayTimeIntervalType):
        return F.regexp_replace(column.cast("string"), r"^INTERVAL '(.*)' .*$", "$1")
    return column.cast("string")


def shown(column: Column, kind: T.DataType) -> Column:
    """A value as text in a profile: NaN as null, bytes in hex, temporal as ISO."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(column))
    if is_temporal(kind):
        return iso(column, kind)
    return no_nan(column, kind).cast("string")


def as_number(column: Column, kind: T.DataType) -> Column | None:
    """The number by which a column's median is taken: itself, days, or microseconds; None if it has none."""
    if is_numeric(kind):
        return column.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if is_datetime(kind):
        return F.unix_micros(column.cast("timestamp_ltz")).cast("double")
    if isinstance(kind, T.DayTimeIntervalType):
        part = lambda name: F.date_part(F.lit(name), column).cast("double")
        return part("DAY") * 86_400e6 + part("HOUR") * 3_600e6 + part("MINUTE") * 60e6 + part("SECOND") * 1e6
    return None


def median_text(median: Column, kind: T.DataType) -> Column:
    """The median's number as text."""
    if is_numeric(kind):
        return F.when(~F.isnan(median), median).cast("string")
    if isinstance(kind, T.DateType):
        return iso(F.timestamp_micros((median * 86_400e6).cast("bigint")).cast("timestamp_ntz"), T.TimestampNTZType())
    if is_datetime(kind):
        return iso(F.timestamp_micros(median.cast("bigint")).cast(kind), kind)
    if isinstance(kind, T.DayTimeIntervalType):
        return shown(F.make_dt_interval(secs=(median / 1e6).cast("decimal(18,6)")), kind)
    return F.lit(None).cast("string")


def statistics(column: str, kind: T.DataType, deep: bool = False) -> dict[str, Column]:
    """The aggregates of one column by name but for the median, all nullable; text for min and max."""
    value = quoted(column)
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    plain = no_nan(value, kind)
    numeric = is_numeric(kind)
    out = {
        "null_rate": F.coalesce(F.avg(value.isNull().cast("int")), F.lit(0.0)),
        "min": none_text if is_nested(kind) else shown(F.min(plain), kind),
        "max": none_text if is_nested(kind) else shown(F.max(plain), kind),
        "n": F.count(value),
        "mean": F.avg(value.cast("double")) if numeric else none_number,
        "stddev": F.stddev_samp(value.cast("double")) if numeric else none_number,
        "unique": F.approx_count_distinct(value) + F.max(value.isNull().cast("int")) if deep and not is_nested(kind) else F.lit(None).cast("bigint"),
    }
    if numeric and is_float(kind):
        for name in ("mean", "stddev"):
            out[name] = F.when(~F.isnan(out[name]), out[name])
    return out


def profile(df: DataFrame, deep: bool = False) -> DataFrame:
    """One row per column, in order: column, dtype and STATISTICS.

    All columns share one aggregate, whose wide row is unpivoted where it lands, and the passes of the exact medians
    (column_medians(), which run at once). A frame without rows has null rates of 0 and nulls else.
    """
    fields = df.schema.fields
    wide = df.agg(*[F.struct(*[c.alias(n) for n, c in statistics(f.name, f.dataType, deep).items()]).alias(f"c{i}") for i, f in enumerate(fields)])
    plain = [n for n in STATISTICS if n != "median"]
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), *[F.col(f"c{i}.{n}").alias(n) for n in plain]) for i, f in enumerate(fields)])))
    numbers = [(i, f, n) for i, f in enumerate(fields) if (n := as_number(quoted(f.name), f.dataType)) is not None]
    median = F.lit(None).cast("string")
    if numbers:
        for (i, f, _), value in zip(numbers, column_medians(df, [n for _, _, n in numbers]), strict=True):
            median = F.when(F.col("i") == i, median_text(F.lit(value).cast("double"), f.dataType)).otherwise(median)
    return rows.orderBy("i").select("column", "dtype", *[median.alias(n) if n == "median" else n for n in STATISTICS])


def digests(df: DataFrame, ordinal: str) -> DataFrame:
    """(column, digest) of all columns that can be digested but the ordinal; equal for equal values in equal order."""
    fields = [f for f in df.schema.fields if f.name != ordinal and digestible(f.dataType)]
    wide = df.agg(*[digest(quoted(ordinal), quoted(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}").alias("digest")) for i, f in enumerate(fields)])))


def profile_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bin, low, high, count): the profile's equal-width histogram of each numeric column as a plan.

    Edges are computed from a one-row aggregate, so nothing is collected. Columns with an infinite extreme have
    no histogram; a constant column has one bin.
    """
    number = {c: quoted(c).cast("double") for c in columns}
    stats = df.agg(*[F.struct(F.min(F.when(~F.isnan(v), v)).alias("lo"), F.max(F.when(~F.isnan(v), v)).alias("hi"), F.count(v).alias("n")).alias(f"s{i}") for i, v in enumerate(number.values())])
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(number.values())])))
    bounds = stats.select(F.inline(F.array(*[F.struct(F.lit(i).alias("j"), F.lit(c).alias("column"), F.col(f"s{i}.lo").alias("lo"), F.col(f"s{i}.hi").alias("hi"), F.col(f"s{i}.n").alias("n")) for i, c in enumerate(columns)])))
    bounds = bounds.filter("lo is not null and abs(lo) < double('inf') and abs(hi) < double('inf')")
    bins = F.least(F.lit(MOST_BINS), F.greatest(F.lit(2), F.ceil(F.sqrt("n"))))
    bounds = bounds.withColumn("bins", F.when(F.abs(F.col("hi") - F.col("lo")) <= F.greatest(1e-9 * F.greatest(F.abs("hi"), F.abs("lo")), F.lit(1e-9)), F.lit(1)).otherwise(bins).cast("int"))
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) / F.col("bins") * i
    joined = long.filter(finite(F.col("v"))).join(F.broadcast(bounds), F.col("i") == F.col("j"))  # a row per column
    index = sum((F.when((F.col("bins") > b) & (F.col("v") >= edge(b)), 1).otherwise(0) for b in range(1, MOST_BINS)), F.lit(0))
    counted = joined.groupBy("j", index.alias("bin")).agg(F.count("*").alias("count"))
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    found = every.join(F.broadcast(counted), ["j", "bin"], "left")
    return found.select("column", "bin", edge(F.col("bin")).alias("low"), F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(edge(F.col("bin") + 1)).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def is_sorted(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row, `sorted`: whether values never fall along the order; nulls are passed over.

    Neighbours are compared within ranges of the order, and the ranges' ends with each other, so no task
    sees all rows."""
    ranged = df.select(quoted(value).alias("v"), quoted(order).alias("o")).filter("v is not null").repartitionByRange("o").sortWithinPartitions("o").withColumn("p", F.spark_partition_id())
    inside = W.partitionBy("p").orderBy("o")
    pairs = ranged.withColumn("before", F.lag("v").over(inside))
    parts = pairs.groupBy("p").agg(F.coalesce(F.bool_and(F.col("v") >= F.col("before")), F.lit(True)).alias("ok"), F.min("v").alias("least"), F.max("v").alias("most"), F.min("o").alias("at"))
    ends = parts.withColumn("last", F.max("most").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)))
    return ends.agg(F.coalesce(F.bool_and(F.col("ok") & (F.col("last").isNull() | (F.col("least") >= F.col("last")))), F.lit(True)).alias("sorted"))
