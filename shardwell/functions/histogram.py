"""Equal-width histograms: how many bins, their edges and labels, and counting in one aggregate."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BINS, MOST_BINS = 2, 8


def bin_count(n: int) -> int:
    """About the root of the values, between 2 and 8; none without values, one for one value's sake is 2."""
    return min(MOST_BINS, max(LEAST_BINS, math.ceil(math.sqrt(n)))) if n > 0 else 0


def bound_label(value: float) -> str:
    near = round(value)
    return str(int(near)) if math.isclose(value, near, rel_tol=1e-9, abs_tol=1e-9) else f"{value:.3g}"


def time_label(seconds: float) -> str:
    """An epoch bound as a UTC date, or date and time if it is no midnight; one that no calendar has as a number."""
    if not math.isfinite(seconds):
        return str(seconds)
    try:
        moment = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)
    except OverflowError:
        return f"{seconds:.3g}"
    return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(" ", "seconds") + "Z"


def is_single(low: float, high: float) -> bool:
    return math.isclose(low, high, rel_tol=1e-9, abs_tol=1e-9)


def edges(low: float, high: float, n: int) -> list[float]:
    return [float(e) for e in np.linspace(low, high, bin_count(n) + 1)]


def bin_index(value: Column, bounds: list[float]) -> Column:
    """Which of the bins [e0, e1), [e1, e2), ... [.., en] holds a value, by the very edges; values outside go to the ends."""
    inner = [F.when(value >= e, 1).otherwise(0) for e in bounds[1:-1]]
    out = F.lit(0)
    for part in inner:
        out = out + part
    return out


def labels(bounds: list[float], label=bound_label) -> list[str]:
    return [f"{label(a)}..{label(b)}" for a, b in zip(bounds, bounds[1:], strict=False)]


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def numeric_histogram(df: DataFrame, value: Column, label=bound_label) -> list[tuple[str, int]]:
    """(label, count) over the finite values of an expression: two aggregates, no rows on the driver."""
    number = df.select(value.cast("double").alias("v")).filter(finite(F.col("v")))
    low, high, n = number.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return []
    if is_single(low, high):
        return [(label(low), n)]
    bounds = edges(low, high, n)
    counts = dict(number.groupBy(bin_index(F.col("v"), bounds).alias("b")).count().collect())
    return [(name, counts.get(i, 0)) for i, name in enumerate(labels(bounds, label))]
