"""Filter expressions, projections, casts and relaxed unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import predicate
from ..functions.types import aligned, union_relaxed
from ..operators.series import cast_failures, y_number
from .registry import Registry, table

QUERIES = Registry()

LINES = "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity"


def _filtered(op: str):
    def run(spark, sf_dir):
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        return lines.filter(predicate(f"l_quantity {op} 25", lines.schema))

    return run


for name, op in {"eq": "==", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    QUERIES[f"filter_{name}"] = _filtered(op), f"{LINES} {op.replace('==', '=').replace('!=', '<>')} 25"


@QUERIES.add("select c_custkey, c_mktsegment from customer where c_mktsegment = 'MACHINERY'")
def filter_string_eq(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return rows.filter(predicate('c_mktsegment == "MACHINERY"', rows.schema))


@QUERIES.add("select o_orderkey, cast(o_orderdate as date) as day from orders where cast(o_orderdate as date) = date '1995-03-15'")
def filter_date_eq(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_orderdate as date) as day")
    return rows.filter(predicate("day == 1995-03-15", rows.schema))


@QUERIES.add("select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1996-06-30 22:00:00'")
def filter_datetime_ge(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rows.filter(predicate("o_orderdate >= 1996-07-01T00:00:00+02:00", rows.schema))


@QUERIES.add("select c_custkey, c_acctbal > 0 as in_credit from customer where c_acctbal > 0")
def filter_bool(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal > 0 as `in credit?`")
    return rows.filter(predicate("in credit? == true", rows.schema)).withColumnRenamed("in credit?", "in_credit")


@QUERIES.add("select p_partkey as id, p_retailprice as price from part")
def project_alias(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))


@QUERIES.add("select cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as double) as n_regionkey, cast(null as varchar) as note from nation")
def cast_strict(spark, sf_dir):
    from pyspark.sql import types as T

    rows = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) as n_nationkey", "n_name", "n_regionkey")
    return aligned(rows, {"n_nationkey": T.LongType(), "n_name": T.StringType(), "n_regionkey": T.DoubleType(), "note": T.StringType()})


MIXED = "case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 3 = 1 then cast(c_custkey as string) end"


@QUERIES.add("select c_custkey, case when c_custkey % 3 = 1 then cast(c_custkey as double) end as number from customer")
def cast_lenient(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{MIXED} as mixed")
    return rows.select("c_custkey", y_number(F.col("mixed"), rows.schema["mixed"].dataType).alias("number"))


@QUERIES.add("select count(*) as failures from customer where c_custkey % 3 = 0")
def plot_cast_failures(spark, sf_dir):
    return cast_failures(table(spark, sf_dir, "customer").selectExpr(f"{MIXED} as mixed"), "mixed")


@QUERIES.add(
    "select cast(n_nationkey as varchar) as id, n_name as name, cast(n_regionkey as double) as weight, cast(null as bigint) as extra from nation "
    "union all select r_name, cast(null as varchar), cast(null as double), cast(null as bigint) from region union all select cast(s_suppkey as varchar), s_name, s_acctbal, s_suppkey from supplier"
)
def union_relaxed_rows(spark, sf_dir):
    one = table(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "n_name as name", "n_regionkey as weight")
    two = table(spark, sf_dir, "region").selectExpr("r_name as id")
    three = table(spark, sf_dir, "supplier").selectExpr("s_acctbal as weight", "s_suppkey as extra", "s_suppkey as id", "s_name as name")
    return union_relaxed([one, two, three])


QUERIES["union_relaxed"] = QUERIES.pop("union_relaxed_rows")
