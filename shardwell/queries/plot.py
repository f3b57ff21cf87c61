"""Chart preparation: cleaning, aggregation, ordering, outliers, histograms and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.types import union_relaxed
from ..operators import series
from ..operators.profile import is_sorted
from ..plans.plotting import Options, histogram
from .registry import Registry, table

QUERIES = Registry()

# values with nulls, NaN and infinities injected
HOLED = "case when event_id % 5 = 0 then null when event_id % 11 = 0 then {nan} when event_id % 13 = 0 then {inf} else value end"
SPARK_HOLED, SQL_HOLED = HOLED.format(nan="double('NaN')", inf="double('Infinity')"), HOLED.format(nan="'nan'::double", inf="'inf'::double")
CLEAN = "event_id % 5 <> 0 and event_id % 11 <> 0 and event_id % 13 <> 0"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", f"{SPARK_HOLED} as holed")


@QUERIES.add(f"select event_id as x, value as y from events where {CLEAN}")
def plot_xy_clean(spark, sf_dir):
    return series.prepare(_events(spark, sf_dir), "event_id", "holed")


@QUERIES.add("select event_id as x, case when value > 50 then 1.0::double else 0.0::double end as y from events")
def plot_bool_y(spark, sf_dir):
    return series.prepare(_events(spark, sf_dir).withColumn("high", F.col("value") > 50), "event_id", "high")


@QUERIES.add("select event_id, epoch_us(ts) / 1e6 as moment, cast(date_diff('day', date '1970-01-01', cast(ts as date)) * 86400 as double) as day, cast(event_id % 1000 as double) as duration from events")
def plot_temporal_epoch(spark, sf_dir):
    rows = _events(spark, sf_dir).selectExpr("event_id", "ts", "cast(ts as date) as d", "make_dt_interval(0, 0, 0, event_id % 1000) as i")
    number = lambda c: series.to_number(F.col(c), rows.schema[c].dataType)
    return rows.select("event_id", number("ts").alias("moment"), number("d").alias("day"), number("i").alias("duration"))


def _aggregated(how: str):
    def run(spark, sf_dir):
        points = series.prepare(_events(spark, sf_dir), "event_type", "holed")
        return series.aggregate(points, how).select("x", F.round("y", 6).alias("y"))

    return run


for how, sql in {"mean": "avg(value)", "median": "median(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "count": "cast(count(*) as double)"}.items():
    QUERIES[f"plot_agg_{how}"] = _aggregated(how), f"select event_type as x, round({sql}, 6) as y from events where {CLEAN} group by 1"


@QUERIES.add(f"select cast(count(*) - count(distinct user_id) as bigint) as duplicates from events where {CLEAN}")
def plot_duplicate_x(spark, sf_dir):
    return series.duplicates(series.prepare(_events(spark, sf_dir), "user_id", "holed"))


@QUERIES.add(
    "select 'event_id' as column_name, true as sorted union all "
    + " union all ".join(f"select '{c}', coalesce(bool_and({c} >= before), true) from (select {c}, lag({c}) over (order by event_id) as before from events) where before is not null" for c in ("ts", "user_id", "value"))
)
def plot_is_sorted(spark, sf_dir):
    events = _events(spark, sf_dir)
    one = lambda c: is_sorted(events, c, "event_id").select(F.lit(c).alias("column_name"), "sorted")
    return one("event_id").union(one("ts")).union(one("user_id")).union(one("value"))


@QUERIES.add(
    "select 'event_id' as x, 'line' as kind union all select 'event_type', 'scatter' union all select 'user_id', 'scatter' union all "
    "select 'ts', case when count(*) = count(distinct ts) then 'line' else 'scatter' end from events"
)
def plot_auto_kind(spark, sf_dir):
    events = _events(spark, sf_dir)
    out = []
    for x in ("event_id", "event_type", "user_id", "ts"):
        points = series.prepare(events, x, "value", order="event_id")
        kind = series.axis_kind(events.schema[x].dataType)
        n = series.duplicates(points).first()["duplicates"]
        ascending = kind == "numeric" and not n and is_sorted(points, "x", "o").first()["sorted"]
        out.append((x, series.chart_kind(kind, n, ascending)))
    return spark.createDataFrame(out, "x string, kind string")


@QUERIES.add("select row_number() over (order by ts, event_id) as position, ts as x, value as y from events qualify position <= 100")
def plot_line_sorted(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = _events(spark, sf_dir).select("ts", "event_id", "value").orderBy("ts", "event_id").limit(100)
    return rows.select(F.row_number().over(W.orderBy("ts", "event_id")).cast("bigint").alias("position"), F.col("ts").alias("x"), F.col("value").alias("y"))


@QUERIES.add(f"select epoch_us(ts) / 1e6 as x, value as y from events where {CLEAN}")
def plot_line_points(spark, sf_dir):
    points = series.prepare(_events(spark, sf_dir), "ts", "holed")
    return points.select(series.to_number(F.col("x"), points.schema["x"].dataType).alias("x"), "y").filter("x is not null").orderBy("x")


@QUERIES.add(
    "select event_id, cast(r.position as double) as position from events e join (select event_type, row_number() over (order by min(event_id), event_type) - 1 as position from events group by 1) r on e.event_type = r.event_type"
)
def scatter_ordinal(spark, sf_dir):
    points = _events(spark, sf_dir).select(F.col("event_type").alias("x"), F.col("event_id").alias("o"))
    return series.ordinals(points).select(F.col("o").alias("event_id"), "position")


@QUERIES.add(
    f"""with p as (select cast(event_id as double) as x, value * value * value as y from events),
s as (select min(x) as lo, max(x) as hi, count(*) as n from p),
b as (select p.*, s.n, least(24, greatest(1, cast(floor(sqrt(n)) as integer))) as buckets, lo, hi from p, s),
c as (select *, cast(least(buckets - 1, greatest(0, floor((x - lo) / ((hi - lo) / buckets)))) as integer) as bucket from b),
d as (select *, case when count(*) over (partition by bucket) < 6 then -1 else bucket end as pool from c),
e as (select *, median(y) over (partition by pool) as mid, quantile_cont(y, 0.25) over (partition by pool) as q1, quantile_cont(y, 0.75) over (partition by pool) as q3, count(*) over (partition by pool) as members from d),
f as (select *, 1.4826022185056018 * median(abs(y - mid)) over (partition by pool) as mad from e)
select x, case when n < 8 or (pool < 0 and members < 8) then false when mad > 1e-12 then abs(y - mid) / mad > 3.5
  when q3 - q1 > 1e-12 then y < q1 - 1.5 * (q3 - q1) or y > q3 + 1.5 * (q3 - q1) else false end as is_outlier from f"""
)
def scatter_outliers(spark, sf_dir):
    points = _events(spark, sf_dir).select(F.col("event_id").cast("double").alias("x"), (F.col("value") * F.col("value") * F.col("value")).alias("y"))
    return series.outliers(points).select("x", "is_outlier")


#: How the histogram writes an edge: a whole number plain, any other with three digits, a time as UTC text.
NUMBER_SQL = "case when abs(e - round(e)) <= 1e-9 * greatest(abs(e), abs(round(e)), 1) then cast(cast(round(e) as bigint) as varchar) else regexp_replace(format('{:.3g}', e), 'e([+-])0*(\\d)$', 'e\\10\\2') end"
TIME_SQL = "case when e % 86400 = 0 then strftime(make_timestamp(cast(e as bigint) * 1000000), '%Y-%m-%d') else strftime(make_timestamp(cast(floor(e) as bigint) * 1000000), '%Y-%m-%d %H:%M:%SZ') end"


def _bins(label: str, source: str, value: str, text: str = NUMBER_SQL) -> str:
    """The counts of an eight-bin histogram by its edges, and the edges' labels."""
    edge = lambda i: f"(case when {i} = 8 then hi else lo + (hi - lo) / 8 * {i} end)"
    shown = lambda i: f"(select {text} from (select {edge(i)} as e))"
    return f"""select '{label}' as histogram, b as bin, (select count(*) from (select {value} as v from {source}) where isfinite(v) and least(7, (select count(*) from range(1, 8) e(i) where v >= lo + (hi - lo) / 8 * i)) = b) as count,
        {shown("b")} || '..' || {shown("(b + 1)")} as edges
      from (select min(v) as lo, max(v) as hi from (select {value} as v from {source}) where isfinite(v)), range(0, 8) r(b)"""


def _counts(spark, label: str, found):
    return spark.createDataFrame([(label, i, n, edges) for i, (edges, n) in enumerate(found)], "histogram string, bin bigint, count bigint, edges string")


@QUERIES.add(_bins("holed", "events", f"cast({SQL_HOLED} as double)"))
def hist_plot(spark, sf_dir):
    return _counts(spark, "holed", histogram(_events(spark, sf_dir), "holed", Options(kind="histogram")).bins)


@QUERIES.add(_bins("balance", "(select c_acctbal from customer union all select s_acctbal from supplier)", "c_acctbal"))
def hist_folder(spark, sf_dir):
    both = union_relaxed([table(spark, sf_dir, "customer").selectExpr("c_acctbal as balance", "c_name"), table(spark, sf_dir, "supplier").selectExpr("s_acctbal as balance")])
    return _counts(spark, "balance", histogram(both, "balance", Options(kind="histogram")).bins)


@QUERIES.add(_bins("day", "orders", "cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 86400 as double)", TIME_SQL))
def hist_temporal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return _counts(spark, "day", histogram(orders, "day", Options(kind="histogram")).bins)


RESAMPLED = """with p as (select epoch_us(date_trunc('day', o_orderdate)) / 1e6 as x, cast(count(*) as double) as y from orders group by 1),
s as (select min(x) as lo, max(x) as hi from p), g as (select cast(i as integer) as i, case when i = 59 then hi else lo + (hi - lo) / 59 * i end as gx from s, range(0, 60) r(i)),
n as (select g.i, gx, (select max(x) from p where x <= gx) as ax, (select min(x) from p where x >= gx) as bx from g),
m as (select i, gx, ax, bx, a.y as ay, b.y as b_y from n join p a on a.x = ax join p b on b.x = bx)
select i, round(gx, 3) as x, round({}, 6) as y from m"""


def _resampled(method: str):
    def run(spark, sf_dir):
        days = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("d")).agg(F.count("*").cast("double").alias("y"))
        points = days.select((F.unix_micros(F.col("d").cast("timestamp_ltz")) / 1e6).alias("x"), "y")
        return series.resample(points, 60, method).select("i", F.round("x", 3).alias("x"), F.round("y", 6).alias("y"))

    return run


QUERIES["line_resample_linear"] = _resampled("linear"), RESAMPLED.format("case when ax = bx then ay else ay + (b_y - ay) * ((gx - ax) / (bx - ax)) end")
QUERIES["line_resample_nearest"] = _resampled("nearest"), RESAMPLED.format("case when gx - ax <= bx - gx then ay else b_y end")
