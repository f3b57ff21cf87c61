"""Sources and sinks, compiled datasets and heads of files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from ..plans import compiling
from ..plans.preview import head_dataset
from ..sources.files import SOURCE_FILE, Dataset, Kind, read, resolve, write
from .registry import Registry, local_folder, table

QUERIES = Registry()


# values that break lines, hold quotes and commas, are blank, empty or null
ODD = {"c_name": "case c_custkey % 6 when 0 then concat(c_name, chr(10), 'second, line') when 1 then concat('\"', c_name) when 2 then '' when 3 then concat('  ', c_name, ' ') when 4 then null else c_name end"}


@QUERIES.add(f"select c_custkey, {ODD['c_name']} as c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') as segment from customer")
def scan_csv_roundtrip(spark, sf_dir):
    path = local_folder(spark, "csv") / "customer.csv"
    write(table(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{e} as {n}" for n, e in ODD.items()], "c_nationkey", "c_acctbal", "nullif(c_mktsegment, 'BUILDING') as segment"), path)
    return read(spark, path)


@QUERIES.add("select event_id, ts, user_id, event_type, value, nullif(user_id % 3, 0) as third from events")
def scan_arrow_roundtrip(spark, sf_dir):
    path = local_folder(spark, "arrow") / "events.feather"
    write(table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", "nullif(user_id % 3, 0) as third"), path)
    return read(spark, path)


@QUERIES.add("select l_orderkey, l_shipdate, l_extendedprice from lineitem where l_quantity > 45")
def scan_parquet(spark, sf_dir):
    return read(spark, f"{sf_dir}/lineitem.parquet").filter("l_quantity > 45").select("l_orderkey", "l_shipdate", "l_extendedprice")


def _source(spark, sf_dir) -> Path:
    """A folder of four order files, one of another schema."""
    folder = local_folder(spark, "orders")
    orders = table(spark, sf_dir, "orders")
    for status, name in (("F", "a.parquet"), ("O", "b.csv"), ("P", "sub/c.feather")):
        write(orders.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus", "o_totalprice"), folder / name)
    write(orders.limit(0).select("o_orderkey"), folder / "d.parquet")
    return folder


def _compiled(spark, sf_dir):
    folder = _source(spark, sf_dir)
    return folder, compiling.compile_dataset(spark, folder, folder.parent / f"{folder.name}-compiled", schema=1)


FILE = "case o_orderstatus when 'F' then 'a.parquet' when 'O' then 'b.csv' else 'sub/c.feather' end"


@QUERIES.add(f"select o_orderkey, o_orderstatus, o_totalprice, {FILE} as {SOURCE_FILE} from orders where o_orderstatus in ('F', 'O', 'P')")
def compile_union(spark, sf_dir):
    _, done = _compiled(spark, sf_dir)
    return spark.read.parquet(*[str(p) for p in resolve(done.path).files()])


@QUERIES.add(f"select {FILE} as file, count(*) as rows, sum(o_totalprice) > 0 as paid from orders where o_orderstatus in ('F', 'O', 'P') group by 1")
def compile_scan(spark, sf_dir):
    _, done = _compiled(spark, sf_dir)
    dataset = Dataset(done.path, Kind.COMPILED)
    return spark.read.parquet(*[str(p) for p in dataset.files()]).groupBy(F.col(SOURCE_FILE).alias("file")).agg(F.count("*").alias("rows"), (F.sum("o_totalprice") > 0).alias("paid"))


@QUERIES.add("select 4 as total, 3 as compiled, 1 as other_schema, 0 as unreadable, (select count(*) from orders where o_orderstatus in ('F', 'O', 'P')) as rows")
def compile_coverage(spark, sf_dir):
    _, done = _compiled(spark, sf_dir)
    c = done.coverage
    return spark.createDataFrame([(c.total, c.compiled, c.other_schema, c.unreadable, done.analysis.row_count)], "total int, compiled int, other_schema int, unreadable int, rows bigint")


@QUERIES.add(
    "select 'error' as kind, concat('Row counts differ: a.parquet (', count(*) filter (where o_orderstatus = 'F'), ' of ', count(*) filter (where o_orderstatus = 'F' and o_orderkey % 3 > 0), ')') as finding from orders "
    "union all select 'warning', 'Source files left out: d.parquet'"
)
def compile_validate(spark, sf_dir):
    """What validation finds after a third of a source file's rows went."""
    folder, done = _compiled(spark, sf_dir)
    assert compiling.validate(spark, done.path, folder).ok
    write(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderkey % 3 > 0").select("o_orderkey", "o_orderstatus", "o_totalprice"), folder / "a.parquet")
    found = compiling.validate(spark, done.path, folder)
    return spark.createDataFrame([("error", x) for x in found.errors] + [("warning", x) for x in found.warnings], "kind string, finding string")


@QUERIES.add("select event_id + 1 as position, event_id, value from events where event_id < 20")
def head_n(spark, sf_dir):
    """The first rows of events, whose event_id counts the rows from 0."""
    [(_, rows)] = head_dataset(spark, Dataset(Path(f"{sf_dir}/events.parquet"), Kind.FILE), 20)
    return spark.createDataFrame([(i, r["event_id"], r["value"]) for i, r in enumerate(rows, 1)], "position bigint, event_id bigint, value double")


@QUERIES.add("select 'nation.parquet' as file, 0::bigint as first_key union all select 'region.parquet', 0 union all select 'sub/supplier.csv', min(s_suppkey) from supplier")
def head_per_file(spark, sf_dir):
    """The first row of each file of a folder."""
    folder = local_folder(spark, "heads")
    for name, file in (("nation", "nation.parquet"), ("region", "region.parquet"), ("supplier", "sub/supplier.csv")):
        write(table(spark, sf_dir, name), folder / file)
    return spark.createDataFrame([(name, rows[0][0]) for name, rows in head_dataset(spark, resolve(folder), 9)], "file string, first_key bigint")
