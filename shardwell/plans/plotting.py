"""Charts of a dataset: filter, prepare, choose the kind, and hand a bounded result to the renderer."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.filters import Expression, parse, predicate
from ..functions.histogram import bound_label, finite, numeric_histogram, time_label
from ..functions.ordinal import ORDER
from ..functions.types import quoted, union_relaxed
from ..operators import series
from ..operators.profile import is_sorted
from ..operators.series import PlotError
from ..sources.files import Dataset, Kind, read, read_all

DEFAULT_FILES = 1
#: A chart has some hundred columns; a line beyond so many points is resampled on the executors first.
MOST_POINTS = 20_000
MOST_CATEGORIES = 1000


@dataclass
class Plot:
    """What is drawn; of a line also all its points, x and y in order, as a frame that is not collected."""

    kind: str
    x: str
    y: str
    points: list[tuple[float, float]] = field(default_factory=list)
    outliers: list[tuple[float, float]] = field(default_factory=list)
    bins: list[tuple[str, int]] = field(default_factory=list)
    x_kind: str = "numeric"
    categories: list[str] = field(default_factory=list)
    rows: int = 0
    dropped: int = 0
    cast_failures: int = 0
    duplicates: int = 0
    sorted_input: bool = True
    source: str = ""
    warnings: list[str] = field(default_factory=list)
    line: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    kind: str | None = None
    aggregate_x: str | None = None
    fail_on_duplicates: bool = False
    fail_on_unsorted: bool = False
    filter: str | None = None
    width: int = 400
    interpolation: str = "linear"


def _filtered(df: DataFrame, expression: Expression | None) -> DataFrame:
    return df.filter(predicate(expression, df.drop(ORDER).schema)) if expression else df


def _need(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise PlotError(f"Column not found: {', '.join(missing)}")


def xy(df: DataFrame, x: str, y: str, options: Options, source: str = "") -> Plot:
    """A line or scatter chart of a frame that has the order key. Two columns of the source are read, once: they are
    kept on the executors' disks until the chart is done."""
    _need(df, (x, y))
    rows = _filtered(df, parse(options.filter) if options.filter else None).select(*dict.fromkeys((x, y)), ORDER).persist(StorageLevel.DISK_ONLY)
    try:
        return _xy(rows, x, y, options, source)
    finally:
        rows.unpersist()


def _xy(rows: DataFrame, x: str, y: str, options: Options, source: str) -> Plot:
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    x_kind = series.axis_kind(kinds[x])
    points = series.prepare(rows, x, y, ORDER)
    plot = Plot(options.kind or "", x, y, x_kind=x_kind, source=source)
    plot.rows, failures = rows.agg(F.count("*"), F.count_if(quoted(y).isNotNull() & series.y_number(quoted(y), kinds[y]).isNull())).first()
    plot.cast_failures = failures
    kept = points.count()
    plot.dropped = plot.rows - kept
    if not kept:
        raise PlotError(f"No plottable numeric values remain for {x} and {y}")
    if failures:
        plot.warnings.append(f"{failures} values of {y} are no numbers")
    plot.duplicates = series.duplicates(points).first()["duplicates"]
    plot.sorted_input = x_kind == "categorical" or is_sorted(points, "x", "o").first()["sorted"]
    plot.kind = options.kind or series.chart_kind(x_kind, plot.duplicates, plot.sorted_input)
    if plot.duplicates and not options.aggregate_x and options.fail_on_duplicates:
        raise PlotError(f"{plot.duplicates} rows repeat an x value; use --aggregate-x")
    if options.aggregate_x:
        points = series.aggregate(points, options.aggregate_x).withColumn("o", F.col("x"))
    elif plot.duplicates and plot.kind == "line":
        plot.warnings.append(f"{plot.duplicates} rows repeat an x value")
    if plot.kind == "line":
        if x_kind == "categorical":
            raise PlotError(f"A line needs a numeric or temporal x; {x} is categorical")
        if not plot.sorted_input and not options.aggregate_x:
            if options.fail_on_unsorted:
                raise PlotError(f"{x} is not sorted")
            plot.warnings.append(f"{x} was sorted for the line")
        line = points.select(series.to_number(F.col("x"), kinds[x]).alias("x"), "y", F.col("o")).filter(finite(F.col("x")))
        # not read here: it is planned when it is first read, by then from the source and not from the rows kept for the chart
        plot.line = line.orderBy("x", "o").select("x", "y")
        if line.limit(MOST_POINTS + 1).count() > MOST_POINTS:
            line = series.resample(line.select("x", "y"), MOST_POINTS // 10, options.interpolation)
            plot.warnings.append(f"over {MOST_POINTS} points: the line is resampled at {MOST_POINTS // 10} places")
        plot.points = [(r["x"], r["y"]) for r in line.orderBy("x", *(["o"] if "o" in line.columns else [])).collect()]
        return plot
    if x_kind == "categorical":
        numbered = series.ordinals(points.withColumn("x", F.col("x").cast("string")))
        plot.categories = [r["x"] for r in numbered.select("x", "position").distinct().orderBy("position").limit(MOST_CATEGORIES + 1).collect()]
        if len(plot.categories) > MOST_CATEGORIES:
            plot.categories.pop()
            plot.warnings.append(f"only the first {MOST_CATEGORIES} categories are named")
        numbered = numbered.select(F.col("position").alias("x"), "y")
    else:
        numbered = points.select(series.to_number(F.col("x"), kinds[x]).alias("x"), "y").filter(finite(F.col("x")))
    # cells of a grid finer than any terminal: a point each stands for all in it
    judged = series.outliers(numbered)
    span = judged.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v, a, b, n: F.when(F.col(b) > F.col(a), F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * n)).otherwise(0)
    placed = judged.crossJoin(F.broadcast(span)).groupBy("is_outlier", cell("x", "x0", "x1", 500).alias("cx"), cell("y", "y0", "y1", 200).alias("cy")).agg(F.min(F.struct("x", "y")).alias("p"))
    for r in placed.orderBy("p").collect():
        (plot.outliers if r["is_outlier"] else plot.points).append((r["p"]["x"], r["p"]["y"]))
    return plot


def histogram(df: DataFrame, column: str, options: Options, source: str = "") -> Plot:
    _need(df, (column,))
    rows = _filtered(df, parse(options.filter) if options.filter else None)
    kind = df.schema[column].dataType
    x_kind = series.axis_kind(kind)
    value = series.to_number(quoted(column), kind) if x_kind != "categorical" else series.y_number(quoted(column), kind)
    plot = Plot("histogram", column, "count", x_kind="temporal" if x_kind == "temporal" else "numeric", source=source)
    plot.rows, present, usable = rows.agg(F.count("*"), F.count(quoted(column)), F.count_if(finite(value))).first()
    plot.dropped, plot.cast_failures = plot.rows - usable, present - usable
    if not usable:
        raise PlotError(f"No plottable numeric values remain for {column}")
    plot.bins = numeric_histogram(rows, value, time_label if x_kind == "temporal" and kind.typeName() in ("date", "timestamp", "timestamp_ntz") else bound_label)
    return plot


def plot_dataset(spark: SparkSession, dataset: Dataset, columns: Sequence[str], options: Options, n: int | None = None) -> list[Plot]:
    """The charts that the columns ask for: a histogram of each, or line or scatter charts of each but the
    first against the first.

    A folder's histogram is of all files together unless n is given; other folder charts are of the first n
    files (1) one by one, where files that fail are warnings unless all do.
    """
    columns = list(dict.fromkeys(columns))
    if options.filter:
        parse(options.filter)  # a broken filter fails before any file is read
    is_histogram = options.kind == "histogram"
    if is_histogram and (options.aggregate_x or options.fail_on_duplicates or options.fail_on_unsorted):
        raise PlotError("A histogram takes no line or scatter options")
    if not is_histogram and len(columns) < 2:
        raise PlotError("Line and scatter charts need an x and at least one y column")

    def charts(df: DataFrame, source: str) -> list[Plot]:
        return [histogram(df, c, options, source) for c in columns] if is_histogram else [xy(df, columns[0], y, options, source) for y in columns[1:]]

    if dataset.kind is not Kind.FOLDER:
        return charts(read_all(spark, dataset, ordered=True), dataset.path.name)
    warnings, files = [], dataset.files()
    if is_histogram and n is None:
        out = []
        for column in columns:
            frames = []
            for path in files:
                try:
                    df = read(spark, path)
                    _need(df, [column])
                    wanted = {column, parse(options.filter).column} if options.filter else {column}
                    frames.append(df.select(*[quoted(c) for c in df.columns if c in wanted]))
                except Exception as e:  # any unreadable file is passed over, and said
                    warnings.append(f"Skipped {dataset.relative(path)}: {str(e).splitlines()[0]}")
            if not frames:
                raise PlotError(f"No file has the column {column}")
            out.append(histogram(union_relaxed(frames), column, options, dataset.path.name))
    else:
        out = []
        for path in itertools.islice(files, n or DEFAULT_FILES):
            try:
                out += charts(read(spark, path, ordered=True), dataset.relative(path))
            except Exception as e:
                warnings.append(f"Skipped {dataset.relative(path)}: {str(e).splitlines()[0]}")
        if not out:
            raise PlotError("; ".join(warnings))
    out[0].warnings += warnings
    return out
