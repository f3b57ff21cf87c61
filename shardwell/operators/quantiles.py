"""Exact quantiles by group in bounded memory.

Spark's own exact median keeps every distinct value of a group in one buffer. Here a sketch with a proven rank
error brackets each quantile first; a second pass counts the rows below each bracket and keeps only the values
inside, less than a thousandth of the rows, which are ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(rows: DataFrame, group: str, value: str, shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(group, n, q): the count of values that are not null and the quantiles at `shares`, linearly interpolated
    as numpy does, for each group that has a value. Values are doubles; NaN ranks above all others."""
    number = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v is not null")
    # the sketch's rank is off by n / accuracy at most and interpolation looks two ranks on, so for groups of
    # `accuracy` rows and more the bracket holds the ranks wanted; smaller groups are ranked as a whole
    ends = [min(1.0, max(0.0, s + d)) for s in shares for d in (-4 / accuracy, 4 / accuracy)]
    sketch = number.groupBy("g").agg(F.count("v").alias("n"), F.percentile_approx("v", ends, accuracy).alias("ends"))
    told = number.alias("a").join(sketch.alias("b"), F.col("a.g").eqNullSafe(F.col("b.g"))).select("b.g", "v", "n", "ends")

    def place(j: int) -> Column:
        low, high = F.col("ends")[2 * j], F.col("ends")[2 * j + 1]
        # below: counted without its value; inside: counted by value; above: gone
        inside = F.struct(F.lit(j).alias("j"), F.col("v").alias("v"))
        small = F.col("n") < accuracy
        return F.when(small, inside).when(F.col("v") < low, F.struct(F.lit(j).alias("j"), F.lit(None).cast("double").alias("v"))).when(F.col("v") <= high, inside)

    kept = told.select("g", "n", F.explode(F.filter(F.array(*[place(j) for j in range(len(shares))]), lambda x: x.isNotNull())).alias("x"))
    counts = kept.groupBy("g", "n", F.col("x.j").alias("j"), F.col("x.v").alias("v")).agg(F.count("*").alias("c"))
    order = W.partitionBy("g", "j").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(order))
    rank = (F.col("n") - 1) * F.array(*[F.lit(float(s)) for s in shares])[F.col("j")]
    at = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("c") <= k), F.col("v")))
    ends_of = ranked.groupBy("g", "n", "j").agg(at(F.floor(rank)).alias("low"), at(F.ceil(rank)).alias("high"), F.max(rank - F.floor(rank)).alias("part"))
    value_at = F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    return ends_of.groupBy("g", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", value_at.alias("q")))), lambda x: x["q"]).alias("q")).withColumnRenamed("g", group)


def column_medians(df: DataFrame, numbers: list[Column], accuracy: int = 10_000, most: int = 100_000) -> list[float | None]:
    """The exact medians of several expressions of doubles over all rows, null if there is no value.

    A sketch brackets each median; the rows below and inside the brackets are counted; a bracket of over `most` rows is
    narrowed by a sketch of what is inside it, again and again, so however many rows there are only `most` of a column
    are ranked. Each step is one scan of all columns, and one row of counts comes to the driver."""
    # NaN ranks above all and is told by its count: sketches know no order for it
    wide = df.select(*[F.when(~F.isnan(n), n).alias(f"v{i}") for i, n in enumerate(numbers)], *[F.isnan(n).alias(f"nan{i}") for i, n in enumerate(numbers)])
    value = lambda i: F.col(f"v{i}")
    sketch = lambda v, share: F.percentile_approx(v, [max(0.0, share - 4 / accuracy), min(1.0, share + 4 / accuracy)], accuracy)
    every = range(len(numbers))
    first = wide.agg(*[F.struct(F.count(value(i)).alias("n"), F.count_if(F.col(f"nan{i}")).alias("nan"), sketch(value(i), 0.5).alias("ends")).alias(f"s{i}") for i in every]).first()
    out: list[float | None] = [float("nan") if first[f"s{i}"]["nan"] else None for i in every]
    rows = {i: first[f"s{i}"]["n"] for i in every}
    total = {i: rows[i] + first[f"s{i}"]["nan"] for i in every if (rows[i] + first[f"s{i}"]["nan"]) // 2 < rows[i]}
    ends = {i: tuple(first[f"s{i}"]["ends"]) if rows[i] >= accuracy and rows[i] == total[i] else (float("-inf"), float("inf")) for i in total}
    below: dict[int, int] = {}
    inside = lambda i: (value(i) >= F.lit(ends[i][0])) & (value(i) <= F.lit(ends[i][1]))
    wide_open = list(total)
    while wide_open:
        counts = wide.agg(*[F.struct(F.count_if(value(i) < F.lit(ends[i][0])).alias("below"), F.count_if(inside(i)).alias("n")).alias(f"s{i}") for i in wide_open]).first()
        below |= {i: counts[f"s{i}"]["below"] for i in wide_open}
        wide_open = [i for i in wide_open if counts[f"s{i}"]["n"] > most and ends[i][0] != ends[i][1]]
        if wide_open:
            share = {i: ((total[i] - 1) / 2 - below[i]) / counts[f"s{i}"]["n"] for i in wide_open}
            closer = wide.agg(*[sketch(F.when(inside(i), value(i)), share[i]).alias(f"s{i}") for i in wide_open]).first()
            wide_open = [i for i in wide_open if tuple(closer[f"s{i}"]) != ends[i]]
            ends |= {i: tuple(closer[f"s{i}"]) for i in wide_open}
    if not total:
        return out
    kept = wide.select(F.explode(F.filter(F.array(*[F.when(inside(i), F.struct(F.lit(i).alias("i"), value(i).alias("v"))) for i in total]), lambda x: x.isNotNull())).alias("x"))
    counted = kept.groupBy("x.i", "x.v").count()
    ranked = counted.withColumn("upto", F.sum("count").over(W.partitionBy("i").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)))
    # ranks within the bracket of the one or two values in the middle
    middle = F.create_map(*[x for i in total for x in (F.lit(i), F.array(F.lit((total[i] - 1) // 2 - below[i]), F.lit(total[i] // 2 - below[i])))])
    ranked = ranked.withColumn("m", middle[F.col("i")])
    at = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("count") <= k), F.col("v")))
    found = {r["i"]: (r["low"], r["high"]) for r in ranked.groupBy("i").agg(at(F.col("m")[0]).alias("low"), at(F.col("m")[1]).alias("high")).collect()}
    for i, (low, high) in found.items():
        out[i] = low if low == high else low + (high - low) / 2
    return out


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median)."""
    return exact_quantiles(rows, group, value, [0.5]).select(group, F.col("q")[0].alias("median"))
