"""Keyed row comparison and comparison of profiles and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rowdiff
from ..plans.analysis import Analysis, Mode, column_statistics
from ..plans.diffing import Report, compare_analyses, inventory_diff as compare_inventories
from .registry import Registry, table

QUERIES = Registry()

# Two versions of orders: keys dropped and added, payloads changed, one null key on both sides.
LEFT = {"k": "nullif(o_orderkey, 3)", "status": "o_orderstatus", "price": "o_totalprice"}
RIGHT = {"k": "nullif(o_orderkey, 3)", "status": "case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end", "price": "case when o_orderkey % 11 = 0 then null else o_totalprice end"}
EXTRA = {"k": "o_orderkey + 1000000000", "status": "o_orderstatus", "price": "o_totalprice"}


def _columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in exprs.items())


CTE = f"""with l as (select {_columns(LEFT)}, o_orderkey % 4 as file from orders where o_orderkey % 10 <> 1),
r as (select {_columns(RIGHT)}, o_orderkey % 4 as file from orders where o_orderkey % 9 <> 2 union all select {_columns(EXTRA)}, o_orderkey % 4 from orders where o_orderkey % 20 = 0),
j as (select l.k as lk, r.k as rk, l.here as lh, r.here as rh, l.file as lf, r.file as rf, l.status is distinct from r.status as ds, l.price is distinct from r.price as dp
  from (select *, 1 as here from l) l full join (select *, 1 as here from r) r on l.k is not distinct from r.k)"""


def _sides(spark, sf_dir, file: bool = False):
    orders = table(spark, sf_dir, "orders")
    pick = lambda df, e: df.selectExpr(*[f"{x} as {n}" for n, x in e.items()], *(["o_orderkey % 4 as file"] if file else []))
    left = pick(orders.filter("o_orderkey % 10 <> 1"), LEFT)
    return left, pick(orders.filter("o_orderkey % 9 <> 2"), RIGHT).unionAll(pick(orders.filter("o_orderkey % 20 = 0"), EXTRA))


COUNTS = """count(*) filter (where lh is null) as added, count(*) filter (where rh is null) as removed,
count(*) filter (where lh = 1 and rh = 1 and (ds or dp)) as updated, count(*) filter (where lh = 1 and rh = 1 and not (ds or dp)) as unchanged"""


@QUERIES.add(f"{CTE} select {COUNTS} from j")
def rowdiff_summary(spark, sf_dir):
    return rowdiff.compare(*_sides(spark, sf_dir), ["k"]).summary()


@QUERIES.add(f"{CTE} select rk as k from j where lh is null")
def rowdiff_added_keys(spark, sf_dir):
    return rowdiff.compare(*_sides(spark, sf_dir), ["k"]).added()


@QUERIES.add(f"{CTE} select lk as k from j where rh is null")
def rowdiff_removed_keys(spark, sf_dir):
    return rowdiff.compare(*_sides(spark, sf_dir), ["k"]).removed()


@QUERIES.add(f"{CTE} select lk as k, concat_ws(',', case when dp then 'price' end, case when ds then 'status' end) as columns from j where lh = 1 and rh = 1 and (ds or dp)")
def rowdiff_updated_keys(spark, sf_dir):
    rows = rowdiff.compare(*_sides(spark, sf_dir), ["k"]).updated()
    return rows.select("k", F.array_join(F.transform("deltas", lambda d: d["column"]), ",").alias("columns"))


@QUERIES.add(f"{CTE} select coalesce(lf, rf) as file, {COUNTS} from j group by 1")
def rowdiff_folder(spark, sf_dir):
    return rowdiff.compare_files(*_sides(spark, sf_dir, file=True), "file", ["k"]).summary("file")


@QUERIES.add("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return rowdiff.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


PART = "(select p_size, p_retailprice, case when p_size > 10 then p_size end as partly from part)"
CHANGED = "(select p_size + 1 as p_size, p_retailprice, case when p_size > 20 then p_size end as partly from part)"


def _numbers_sql(source: str) -> str:
    one = lambda c: " union all ".join(
        f"select '{c}' as column_name, '{name}' as statistic, cast({e.format(c)} as double) as value from {source}"
        for name, e in {"null_rate": "avg(case when {} is null then 1 else 0 end)", "min": "min({})", "max": "max({})", "mean": "avg({})", "median": "median({})", "stddev": "stddev_samp({})"}.items()
    )
    return " union all ".join(one(c) for c in ("p_size", "p_retailprice", "partly"))


@QUERIES.add(
    f"select l.column_name, l.statistic, round(l.value, 6) as before, round(r.value, 6) as after from ({_numbers_sql(PART)}) l join ({_numbers_sql(CHANGED)}) r using (column_name, statistic) "
    "where abs(l.value - r.value) > 1e-9 * greatest(1, abs(l.value), abs(r.value))"
)
def diff_statistics(spark, sf_dir):
    """What the comparison of two analyses reports where p_size is one larger and another column has more nulls."""
    part = table(spark, sf_dir, "part").selectExpr("p_size", "p_retailprice", "case when p_size > 10 then p_size end as partly")
    other = part.selectExpr("cast(p_size + 1 as int) as p_size", "p_retailprice", "case when p_size > 20 then partly end as partly")
    one, two = (Analysis(0, 3, 1, [], column_statistics(df, Mode.STANDARD)[0]) for df in (part, other))
    found = compare_analyses(one, two, Report("statistics")).statistics
    rows = [(c, s, round(float(a), 6), round(float(b), 6)) for c, pairs in found.items() for s, (a, b) in pairs.items()]
    return spark.createDataFrame(rows, "column_name string, statistic string, before double, after double")


def _listing(spark, sf_dir, changed: str, dropped: int):
    """(file, hash): customers grouped into 'files', each with a hash of its rows."""
    rows = table(spark, sf_dir, "customer").selectExpr("concat('f', cast(c_custkey % 12 as string)) as file", changed).filter(f"c_custkey % 12 <> {dropped}")
    return rows.groupBy("file").agg(F.sum("c_custkey").cast("string").alias("hash"))


@QUERIES.add(
    """with l as (select concat('f', c_custkey % 12) as file, sum(c_custkey) as h from customer where c_custkey % 12 <> 4 group by 1),
r as (select concat('f', c_custkey % 12) as file, sum(case when c_custkey % 12 = 7 then c_custkey + 24 else c_custkey end) as h from customer where c_custkey % 12 <> 5 group by 1)
select coalesce(l.file, r.file) as file, case when l.file is null then 'added' when r.file is null then 'removed' when l.h = r.h then 'matching' else 'modified' end as status
from l full join r on l.file = r.file"""
)
def inventory_diff(spark, sf_dir):
    left = _listing(spark, sf_dir, "c_custkey", 4)
    right = _listing(spark, sf_dir, "case when c_custkey % 12 = 7 then c_custkey + 24 else c_custkey end as c_custkey", 5)
    return compare_inventories(left, right)
