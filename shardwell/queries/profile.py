"""Profiles, histograms, schema groups and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordinal import ORDER, with_ordinal
from ..operators.profile import digests, profile, profile_histogram
from ..plans.analysis import inventory, schema_groups as group_schemas, type_changes
from ..sources.files import read, resolve, write
from .registry import Registry, local_folder, table

QUERIES = Registry()

NUMBERS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# nulls are injected the same way on both sides: the tables have none
HOLES = {"c_custkey": "c_custkey", "nation": "nullif(c_nationkey % 7, 0)", "balance": "case when c_acctbal < 0 then null else c_acctbal end", "segment": "nullif(c_mktsegment, 'BUILDING')"}
HOLED = "select " + ", ".join(f"{e} as {n}" for n, e in HOLES.items()) + " from customer"


def _holed(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {n}" for n, e in HOLES.items()])


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


def _numeric_sql(column: str, source: str) -> str:
    d = f"cast({column} as double)"
    return (
        f"select '{column}' as column_name, count({column}) as n, round(avg(case when {column} is null then 1 else 0 end), 6) as null_rate, "
        f"min({d}) as min_value, max({d}) as max_value, round(avg({d}), 6) as mean, round(median({d}), 6) as median, round(stddev_samp({d}), 6) as stddev from {source}"
    )


def _numeric(df):
    number = lambda c: F.col(c).try_cast("double")
    return df.select(F.col("column").alias("column_name"), "n", F.round("null_rate", 6).alias("null_rate"), number("min").alias("min_value"), number("max").alias("max_value"), F.round("mean", 6).alias("mean"), F.round(number("median"), 6).alias("median"), F.round("stddev", 6).alias("stddev"))


@QUERIES.add(_union([_numeric_sql(c, "lineitem") for c in NUMBERS]))
def profile_numeric(spark, sf_dir):
    return _numeric(profile(table(spark, sf_dir, "lineitem").select(*NUMBERS)))


@QUERIES.add(_union([f"select '{c}' as column_name, round(avg(case when {e} is null then 1 else 0 end), 6) as null_rate from customer" for c, e in HOLES.items()]))
def profile_null_rate(spark, sf_dir):
    return profile(_holed(spark, sf_dir)).select(F.col("column").alias("column_name"), F.round("null_rate", 6).alias("null_rate"))


@QUERIES.add(_union([f"select '{c}' as column_name, cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value from nation" for c in ("n_nationkey", "n_name", "n_regionkey")]))
def profile_minmax(spark, sf_dir):
    return profile(table(spark, sf_dir, "nation")).select(F.col("column").alias("column_name"), F.col("min").alias("min_value"), F.col("max").alias("max_value"))


ISO_TIME, ISO_DAY = "'%Y-%m-%dT%H:%M:%S'", "'%Y-%m-%d'"


@QUERIES.add(
    f"select 'moment' as column_name, strftime(min(o_orderdate), {ISO_TIME}) as min_value, strftime(max(o_orderdate), {ISO_TIME}) as max_value, strftime(median(o_orderdate), {ISO_TIME}) as median from orders "
    f"union all select 'day', strftime(min(cast(o_orderdate as date)), {ISO_DAY}), strftime(max(cast(o_orderdate as date)), {ISO_DAY}), strftime(median(cast(o_orderdate as date)), {ISO_TIME}) from orders"
)
def profile_temporal(spark, sf_dir):
    rows = profile(table(spark, sf_dir, "orders").selectExpr("o_orderdate as moment", "cast(o_orderdate as date) as day"))
    return rows.select(F.col("column").alias("column_name"), F.col("min").alias("min_value"), F.col("max").alias("max_value"), "median")


@QUERIES.add(_union([f"select '{c}' as column_name, count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as exact, true as near from ({HOLED})" for c in HOLES]))
def profile_unique_estimate(spark, sf_dir):
    """Exact distinct counts, a null as one more, and whether the profile's estimates are within 15 % of them: three times
    the sketch's standard error."""
    rows = _holed(spark, sf_dir)
    exact = rows.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in rows.columns])
    long = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in rows.columns])))
    found = profile(rows, deep=True).select(F.col("column").alias("column_name"), "unique")
    return long.join(found, "column_name").select("column_name", "exact", (F.abs(F.col("unique") - F.col("exact")) <= 0.15 * F.col("exact")).alias("near"))


@QUERIES.add(
    _union(
        [_numeric_sql(c, f"({HOLED})") for c in ("c_custkey", "nation", "balance")]
        + [f"select 'segment', count(segment), round(avg(case when segment is null then 1 else 0 end), 6), null, null, null, null, null from ({HOLED})"]
    )
)
def profile_all(spark, sf_dir):
    return _numeric(profile(_holed(spark, sf_dir)))


def _histogram_sql(column: str, source: str) -> str:
    return f"""select '{column}' as column_name, b as bin, round(lo + (hi - lo) / bins * b, 6) as low,
        round(case when b = bins - 1 then hi else lo + (hi - lo) / bins * (b + 1) end, 6) as high,
        (select count(*) from {source} where {column} is not null and least(bins - 1, greatest(0, (select count(*) from range(1, 8) e(i) where i < bins and cast({column} as double) >= lo + (hi - lo) / bins * i))) = b) as count
      from (select *, cast(case when lo = hi then 1 else least(8, greatest(2, ceil(sqrt(n)))) end as integer) as bins
            from (select min(cast({column} as double)) as lo, max(cast({column} as double)) as hi, count({column}) as n from {source})), range(0, 8) r(b) where b < bins"""


def _named(df):
    return df.select(F.col("column").alias("column_name"), F.col("bin").cast("bigint").alias("bin"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@QUERIES.add(_union([_histogram_sql(c, "part") for c in ("p_size", "p_retailprice")]))
def hist_profile(spark, sf_dir):
    return _named(profile_histogram(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


@QUERIES.add("select 'three' as column_name, cast(0 as bigint) as bin, 3.0::double as low, 3.0::double as high, count(*) as count from customer")
def hist_constant(spark, sf_dir):
    return _named(profile_histogram(table(spark, sf_dir, "customer").select(F.lit(3).alias("three")), ["three"]))


# the digest's sums of two 60-bit pieces of SHA-256 over ordinal and value
PIECE = "cast(sum(cast(cast(concat('0x', substr(h, {}, 15)) as bigint) as decimal(38, 0))) as varchar)"
DIGEST = f"concat({PIECE.format(1)}, '-', {PIECE.format(16)}, '-', count(*))"
HASHED = "select sha256(concat({o}, ':', case when {v} is null then '<NULL>' else concat('=', {v}) end)) as h from events"


def _digest_sql(change: str, value: str = "user_id", ordinal: str = "event_id") -> str:
    return f"select '{change}' as change, {DIGEST} as digest from ({HASHED.format(o=ordinal, v=value)})"


@QUERIES.add(_union([_digest_sql("none"), _digest_sql("dealt anew"), _digest_sql("one value", "case when event_id = 5 then null else user_id end"), _digest_sql("two rows", ordinal="case event_id when 0 then 1 when 1 then 0 else event_id end")]))
def column_hash_equal(spark, sf_dir):
    """The digest of events.user_id as it stands, in other partitions, with a value gone, and with two rows swapped."""
    events = with_ordinal(read(spark, f"{sf_dir}/events.parquet", ordered=True).select("event_id", "user_id", ORDER))  # event_id counts the rows
    one = lambda change, df: digests(df.select("user_id", "_ordinal"), "_ordinal").select(F.lit(change).alias("change"), "digest")
    swapped = F.when(F.col("_ordinal") == 0, 1).when(F.col("_ordinal") == 1, 0).otherwise(F.col("_ordinal"))
    out = one("none", events).union(one("dealt anew", events.repartition(7, "user_id")))
    out = out.union(one("one value", events.withColumn("user_id", F.when(F.col("_ordinal") != 5, F.col("user_id")))))
    return out.union(one("two rows", events.withColumn("_ordinal", swapped)))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@QUERIES.add("select * from (" + _union([f"select '{t}' as file, count(*) as rows from {t}" for t in TABLES]) + ")")
def file_row_counts(spark, sf_dir):
    out = None
    for t in TABLES:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("file"), "rows")
        out = one if out is None else out.union(one)
    return out


def _files(spark, sf_dir):
    """A folder of small tables, with a copy of nation, one that drifted and one that is broken."""
    folder = local_folder(spark, "schemas")
    for name in ("region", "nation", "customer", "supplier"):
        write(table(spark, sf_dir, name).limit(50), folder / f"{name}.parquet")
    nation = table(spark, sf_dir, "nation")
    write(nation, folder / "sub" / "copy.parquet")
    write(nation.selectExpr("cast(n_nationkey as bigint) as n_nationkey", "n_name", "n_regionkey"), folder / "drift.feather")
    (folder / "broken.parquet").write_bytes(b"PAR1")
    return inventory(spark, resolve(folder))


KIND = "case column_type when 'INTEGER' then 'int' when 'VARCHAR' then 'string' else lower(column_type) end"


def _described(source: str, n: int) -> str:
    return f"select string_agg(column_name || ':' || {KIND}, ',') as columns, cast({n} as bigint) as files from (describe {source})"


DRIFTED = "select cast(n_nationkey as bigint) as n_nationkey, n_name, n_regionkey from nation"


@QUERIES.add(_union([_described("nation", 2), _described("region", 1), _described("customer", 1), _described("supplier", 1), _described(DRIFTED, 1)]))
def schema_groups(spark, sf_dir):
    found = group_schemas(_files(spark, sf_dir))
    assert [g.count for g in found] == sorted((g.count for g in found), reverse=True)
    return spark.createDataFrame([(",".join(f"{n}:{t}" for n, t in g.columns), g.count) for g in found], "columns string, files bigint")


@QUERIES.add(
    f"select column_name, string_agg(distinct kind, ',' order by kind) as dtypes from (select column_name, {KIND} as kind from (describe nation) union all select column_name, {KIND} from (describe {DRIFTED})) group by 1 having count(distinct kind) > 1"
)
def schema_type_changes(spark, sf_dir):
    found = type_changes(group_schemas(_files(spark, sf_dir)))
    return spark.createDataFrame([(n, ",".join(k)) for n, k in found.items()], "column_name string, dtypes string")
