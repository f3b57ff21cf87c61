"""User transforms: scripts as one would write them, loaded and applied by the engine."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from ..functions.types import columns_of, signature
from ..plans import transforming
from ..sources.files import read, write
from .registry import Registry, local_folder, table

QUERIES = Registry()


def _script(spark, body: str) -> Path:
    path = local_folder(spark, "scripts") / "script.py"
    path.write_text("from pyspark.sql import functions as F\n\n\ndef transform(df, context):\n    " + body.replace("\n", "\n    ") + "\n")
    return path


def _applied(spark, df: DataFrame, name: str, body: str) -> DataFrame:
    """The script's result for one file, as transform() gets it."""
    columns = columns_of(df.schema)
    context = transforming.Context(f"{name}.parquet", name, dict(columns), transforming.FileMetadata(0, signature(columns)))
    return transforming.apply(transforming.load(_script(spark, body)), df, context)


def _add(query: str, name: str, body: str, sql: str, prepared: list[str] | None = None) -> None:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        return _applied(spark, df.selectExpr(*prepared) if prepared else df, name, body)

    QUERIES[query] = run, sql


_add("tf_rename_drop", "part", 'return df.withColumnRenamed("p_name", "title").drop("p_brand", "p_type", "p_retailprice")', "select p_partkey, p_name as title, p_size from part")
_add("tf_filter", "supplier", 'return df.filter(F.col("s_acctbal") > 0)', "select * from supplier where s_acctbal > 0")
_add("tf_cast", "part", 'return df.select("p_partkey", F.col("p_size").cast("double").alias("p_size"))', "select p_partkey, cast(p_size as double) as p_size from part")
_add(
    "tf_standardize", "part",
    'known = df.agg(F.avg("p_retailprice"), F.stddev_samp("p_retailprice")).first()\nreturn df.select("p_partkey", F.round((F.col("p_retailprice") - known[0]) / known[1], 6).alias("z"))',
    "select p_partkey, round((p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_samp(p_retailprice) from part), 6) as z from part",
)
_add("tf_fill_null", "customer", 'return df.fillna({"segment": "none"})', "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment from customer", ["c_custkey", "nullif(c_mktsegment, 'BUILDING') as segment"])
_add(
    "tf_parse_ts", "orders", 'return df.select("o_orderkey", F.try_to_timestamp("text").cast("timestamp_ntz").alias("moment"))',
    "select o_orderkey, case when o_orderkey % 4 <> 0 then o_orderdate end as moment from orders", ["o_orderkey", "case when o_orderkey % 4 = 0 then 'no time' else date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') end as text"],
)
_add("tf_unique", "lineitem", "return df.distinct()", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"])
_add("tf_select_sort", "nation", 'return df.select("n_name", "n_regionkey").orderBy("n_regionkey", "n_name")', "select n_name, n_regionkey from nation")
_add("tf_source_file", "region", 'return df.select("r_name", F.lit(context.file_name).alias("file"))', "select r_name, 'region.parquet' as file from region")
_add("tf_lower_trim", "customer", 'return df.withColumn("segment", F.lower(F.trim("segment")))', "select c_custkey, lower(trim(' ' || c_mktsegment || '  ')) as segment from customer", ["c_custkey", "concat(' ', c_mktsegment, '  ') as segment"])
_add(
    "tf_revenue", "lineitem",
    'gross = F.col("l_quantity") * F.col("l_extendedprice")\nreturn df.select("l_orderkey", "l_linenumber", F.round(gross, 4).alias("gross"), F.round(gross * (1 - F.col("l_discount")), 4).alias("net"))',
    "select l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) as gross, round(l_quantity * l_extendedprice * (1 - l_discount), 4) as net from lineitem",
)
_add("tf_len_chars", "part", 'return df.select("p_partkey", F.char_length("p_name").alias("chars"))', "select p_partkey, cast(length(p_name) as integer) as chars from part")
_add("tf_diff_columns", "orders", 'return df.select("o_orderkey", (F.col("o_orderkey") - F.col("o_custkey")).alias("gap"))', "select o_orderkey, o_orderkey - o_custkey as gap from orders")
_add(
    "tf_when", "events", 'return df.select("event_id", F.when(F.col("value") > 75, "high").when(F.col("value") > 25, "middle").otherwise("low").alias("band"))',
    "select event_id, case when value > 75 then 'high' when value > 25 then 'middle' else 'low' end as band from events",
)


@QUERIES.add("select 'sub/nation.csv' as file, n_name as name, count(*) over () as rows, 'bigint' as kind from nation union all select 'region.parquet', r_name, count(*) over (), 'int' from region")
def tf_folder(spark, sf_dir):
    """A transform of a folder's files from source to result: context, layout and formats."""
    folder = local_folder(spark, "transformed")
    write(table(spark, sf_dir, "nation"), folder / "in" / "sub" / "nation.csv")
    write(table(spark, sf_dir, "region"), folder / "in" / "region.parquet")
    script = _script(spark, 'key = df.columns[0]\nreturn df.select(F.col(df.columns[1]).alias("name"), F.lit(context.metadata.row_count).cast("bigint").alias("rows"), F.lit(context.schema[key]).alias("kind"), F.lit(context.file_name).alias("seen"))')
    done = transforming.transform(spark, folder / "in", script, folder / "out", workers=2)
    out = None
    for path in sorted(done.files):
        name = path.relative_to(done.path).as_posix()
        one = read(spark, path).filter(f"seen = '{path.name}'").selectExpr(f"'{name}' as file", "name", "rows", "kind")
        out = one if out is None else out.union(one)
    return out
