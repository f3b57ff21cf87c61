"""Preparing (x, y) data for charts: cleaning, aggregation, ordering, outliers and resampling, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.histogram import finite
from ..functions.types import is_datetime, is_numeric, is_temporal, is_time, quoted
from .quantiles import exact_quantiles, medians

AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": lambda y: F.count(y).cast("double")}
MOST_BUCKETS, LEAST_IN_BUCKET, LEAST_POINTS = 24, 6, 8
MAD_SCALE, MAD_LIMIT, IQR_FACTOR, TINY = 1.4826022185056018, 3.5, 1.5, 1e-12


class PlotError(ValueError):
    pass


def axis_kind(kind: T.DataType) -> str:
    """numeric, temporal or categorical."""
    return "numeric" if is_numeric(kind) or isinstance(kind, T.BooleanType) else "temporal" if is_temporal(kind) else "categorical"


def to_number(column: Column, kind: T.DataType) -> Column:
    """A value on a numeric axis: numbers and booleans as they are, moments as epoch seconds (naive ones as if
    UTC), dates as their midnight, times as seconds of the day, durations as seconds; else null."""
    if is_numeric(kind) or isinstance(kind, T.BooleanType):
        return column.cast("double")
    if is_datetime(kind):
        return F.unix_micros(column.cast("timestamp_ltz")) / 1e6
    if isinstance(kind, T.DateType):
        return (F.unix_date(column) * 86400).cast("double")
    if isinstance(kind, T.DayTimeIntervalType):
        part = lambda name: F.date_part(F.lit(name), column).cast("double")
        return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")
    if is_time(kind):
        return F.hour(column) * 3600 + F.minute(column) * 60 + F.date_part(F.lit("SECOND"), column).cast("double")
    return F.lit(None).cast("double")


def y_number(column: Column, kind: T.DataType) -> Column:
    """A value on the y axis; text that is no number is null."""
    if isinstance(kind, (T.StringType, T.BooleanType)) or is_numeric(kind):
        return column.try_cast("double") if isinstance(kind, T.StringType) else column.cast("double")
    return F.lit(None).cast("double")


def prepare(df: DataFrame, x: str, y: str, order: str | None = None) -> DataFrame:
    """x, y (double) and order of the rows that can be drawn: x there, and finite if a float, y a finite number."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(quoted(x).alias("x"), y_number(quoted(y), kinds[y]).alias("y"), *([quoted(order).alias("o")] if order else []))
    fit = F.col("x").isNotNull() & finite(F.col("y"))
    return rows.filter(fit & finite(F.col("x")) if isinstance(kinds[x], (T.FloatType, T.DoubleType)) else fit)


def cast_failures(df: DataFrame, column: str) -> DataFrame:
    """One row, `failures`: values that are there but are no numbers."""
    value = quoted(column)
    return df.agg(F.count_if(value.isNotNull() & y_number(value, df.schema[column].dataType).isNull()).alias("failures"))


def duplicates(points: DataFrame) -> DataFrame:
    """One row, `duplicates`: rows beyond the first of each x. Grouped, not collected into one set."""
    per_x = points.groupBy("x").agg(F.count("*").alias("n"))
    return per_x.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def aggregate(points: DataFrame, how: str) -> DataFrame:
    """One y per x, in order of x."""
    if how == "median":
        return medians(points, "x", "y").withColumnRenamed("median", "y").orderBy("x")
    if how not in AGGREGATES:
        raise PlotError(f"Unknown aggregate {how!r}; one of median, {', '.join(AGGREGATES)}")
    return points.groupBy("x").agg(AGGREGATES[how](F.col("y")).alias("y")).orderBy("x")


def chart_kind(x_kind: str, n_duplicates: int, ascending: bool) -> str:
    """line or scatter, when not asked for: a line needs one y per x, and a numeric x must ascend already."""
    if n_duplicates or x_kind == "categorical":
        return "scatter"
    return "line" if x_kind == "temporal" or ascending else "scatter"


def ordinals(points: DataFrame, order: str = "o") -> DataFrame:
    """Categorical x as 0, 1, ... by first appearance in the order column."""
    first = points.groupBy("x").agg(F.min(order).alias("_first"))
    ranked = first.select(F.col("x").alias("_x"), (F.row_number().over(W.orderBy("_first", "x")) - 1).cast("double").alias("position"))
    return points.join(ranked, F.col("x").eqNullSafe(F.col("_x"))).drop("_x")


def outliers(points: DataFrame) -> DataFrame:
    """Adds is_outlier to numeric x, y points.

    x is cut into about the root of n equal buckets, 24 at most. In a bucket of 6 points or more a point is out
    if it is over 3.5 scaled MADs from the bucket's median, or, where the MAD vanishes, outside 1.5 IQR fences.
    Points of smaller buckets are judged together if they are 8 or more. Fewer than 8 points: none is out.
    Quantiles by bucket are exact in bounded memory; what is broadcast is at most 25 rows.
    """
    span = points.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    close = F.abs(F.col("hi") - F.col("lo")) <= F.greatest(1e-9 * F.greatest(F.abs("hi"), F.abs("lo")), F.lit(1e-9))
    buckets = F.when(close, 1).otherwise(F.least(F.lit(MOST_BUCKETS), F.greatest(F.lit(1), F.floor(F.sqrt("n"))))).cast("int")
    rows = points.crossJoin(F.broadcast(span.withColumn("buckets", buckets)))  # one row
    at = F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("buckets")))
    rows = rows.withColumn("bucket", F.when(F.col("buckets") == 1, 0).otherwise(F.least(F.greatest(at, F.lit(0)), F.col("buckets") - 1)).cast("int"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"))
    rows = rows.join(F.broadcast(sizes), "bucket").withColumn("pool", F.when((F.col("size") < LEAST_IN_BUCKET) & (F.col("buckets") > 1), -1).otherwise(F.col("bucket")))
    middle = exact_quantiles(rows, "pool", "y", [0.25, 0.5, 0.75]).select("pool", F.col("q")[1].alias("median"), F.array(F.col("q")[0], F.col("q")[2]).alias("q"), F.col("n").alias("members"))
    rows = rows.join(F.broadcast(middle), "pool")
    spread = medians(rows.withColumn("away", F.abs(F.col("y") - F.col("median"))).select("pool", "away"), "pool", "away").withColumnRenamed("median", "mad")
    rows = rows.join(F.broadcast(spread), "pool")
    scaled, iqr = F.col("mad") * MAD_SCALE, F.col("q")[1] - F.col("q")[0]
    by_mad = F.abs(F.col("y") - F.col("median")) / scaled > MAD_LIMIT
    by_iqr = (F.col("y") < F.col("q")[0] - IQR_FACTOR * iqr) | (F.col("y") > F.col("q")[1] + IQR_FACTOR * iqr)
    out = F.when(scaled > TINY, by_mad).when(iqr > TINY, by_iqr).otherwise(False)
    judged = (F.col("n") >= LEAST_POINTS) & ((F.col("pool") >= 0) | (F.col("members") >= LEAST_POINTS))
    return rows.select(*points.columns, (judged & out).alias("is_outlier"))


def resample(points: DataFrame, width: int, method: str = "linear") -> DataFrame:
    """The line through points (x, y) at max(2, width) places from the least to the largest x, as i, x, y.

    linear, or nearest with the midpoint to the left. Points of one x: as they are. Every point is dealt to its
    grid cell first; per cell only the last point at or before and the first at or after matter, so the windows
    run over one row per cell.
    """
    n = max(2, width)
    span = points.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    low = points.crossJoin(F.broadcast(span))  # one row
    at = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) / (n - 1) * i
    guess = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (n - 1))
    # the grid place at or before the point, told by the very grid values
    cell = F.when(at(guess + 1) <= F.col("x"), guess + 1).when(at(guess) > F.col("x"), guess - 1).otherwise(guess)
    celled = low.withColumn("cell", F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0), F.least(F.lit(n - 1), cell))).otherwise(0).cast("int"))
    ends = celled.groupBy("cell").agg(F.min(F.struct("x", "y")).alias("first"), F.max(F.struct("x", "y")).alias("last"))
    grid = span.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("i", F.when(F.col("i") == n - 1, F.col("hi")).otherwise(at(F.col("i"))).alias("gx"), (F.col("hi") > F.col("lo")).alias("wide"))
    rows = grid.join(F.broadcast(ends), F.col("i") == F.col("cell"), "left")  # at most n rows on either side
    before = F.last("last", ignorenulls=True).over(W.orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(W.orderBy("i").rowsBetween(0, W.unboundedFollowing))
    # a point that lies on the grid place belongs to its cell and is its first
    exact = F.col("first").isNotNull() & (F.col("first")["x"] == F.col("gx"))
    rows = rows.withColumns({"a": F.when(exact, F.col("first")).otherwise(before), "b": F.when(exact, F.col("first")).otherwise(after)})
    share = (F.col("gx") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    if method == "linear":
        inside = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * share
    elif method == "nearest":
        inside = F.when(F.col("gx") - F.col("a.x") <= F.col("b.x") - F.col("gx"), F.col("a.y")).otherwise(F.col("b.y"))
    else:
        raise PlotError(f"Unknown interpolation {method!r}; linear or nearest")
    y = F.when(F.col("a.x").isNull(), F.col("b.y")).when(F.col("b.x").isNull() | (F.col("a.x") == F.col("b.x")), F.col("a.y")).otherwise(inside)
    return rows.filter("wide or i = 0").select("i", F.col("gx").alias("x"), y.alias("y")).orderBy("i")
