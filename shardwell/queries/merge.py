"""Merging: append, upsert, additive evolution, conflicts and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from .registry import Registry, table

QUERIES = Registry()

# Target: orders with some rows twice and one null key. Source: changed, repeated and new rows.
TARGET = "select nullif(o_orderkey, 6) as k, o_custkey % 50 as v from orders where o_orderkey % 10 <> 3 union all select o_orderkey, o_custkey % 50 from orders where o_orderkey % 40 = 1"
SOURCE = (
    "select nullif(o_orderkey, 6) as k, case when o_orderkey % 8 = 0 then null else o_custkey % 50 end as v, o_orderkey as seq from orders where o_orderkey % 3 = 0 "
    "union all select o_orderkey, o_custkey % 50, o_orderkey + 500000000 from orders where o_orderkey % 12 = 0 "
    "union all select o_orderkey + 1000000000, o_custkey % 50, o_orderkey + 700000000 from orders where o_orderkey % 25 = 0"
)
CTE = f"with t as ({TARGET}), s as ({SOURCE})"


def _target(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.filter("o_orderkey % 10 <> 3").selectExpr("nullif(o_orderkey, 6) as k", "o_custkey % 50 as v").unionAll(orders.filter("o_orderkey % 40 = 1").selectExpr("o_orderkey as k", "o_custkey % 50 as v"))


def _source(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    one = orders.filter("o_orderkey % 3 = 0").selectExpr("nullif(o_orderkey, 6) as k", "case when o_orderkey % 8 = 0 then null else o_custkey % 50 end as v", "o_orderkey as seq")
    two = orders.filter("o_orderkey % 12 = 0").selectExpr("o_orderkey as k", "o_custkey % 50 as v", "o_orderkey + 500000000 as seq")
    new = orders.filter("o_orderkey % 25 = 0").selectExpr("o_orderkey + 1000000000 as k", "o_custkey % 50 as v", "o_orderkey + 700000000 as seq")
    return one.unionAll(two).unionAll(new)


ALL = "not exists (select 1 from t where t.k is not distinct from s.k and t.v is not distinct from s.v)"
LAST = "(select k, arg_max(struct_pack(v := v), seq).v as v from s group by k)"
KEPT = "not exists (select 1 from s where s.k is not distinct from t.k)"


@QUERIES.add(f"{CTE} select k, v from t union all select distinct k, v from s where {ALL}")
def merge_append(spark, sf_dir):
    return merge.append(_target(spark, sf_dir), _source(spark, sf_dir).drop("seq"))


@QUERIES.add(f"{CTE} select k, v from t where {KEPT} union all select k, v from {LAST}")
def merge_upsert(spark, sf_dir):
    return merge.upsert(_target(spark, sf_dir), _source(spark, sf_dir), ["k"], "seq")


@QUERIES.add(f"{CTE} select k, v from {LAST}")
def merge_upsert_keep_last(spark, sf_dir):
    return merge.last_by_key(_source(spark, sf_dir), ["k"], "seq").drop("seq")


@QUERIES.add(f"{CTE} select k, v, cast(null as varchar) as note from t union all select distinct k, v, case when k % 2 = 0 then 'even' end from s where not exists (select 1 from t where t.k is not distinct from s.k and t.v is not distinct from s.v and case when s.k % 2 = 0 then 'even' end is null)")
def merge_additive_append(spark, sf_dir):
    source = _source(spark, sf_dir).drop("seq").withColumn("note", F.when(F.col("k") % 2 == 0, "even"))
    return merge.append(_target(spark, sf_dir), source, additive=True)


@QUERIES.add(f"{CTE} select k, v, cast(null as varchar) as note from t where {KEPT} union all select k, v, case when k % 2 = 0 then 'even' end from {LAST}")
def merge_additive_upsert(spark, sf_dir):
    source = _source(spark, sf_dir).withColumn("note", F.when(F.col("k") % 2 == 0, "even"))
    return merge.upsert(_target(spark, sf_dir), source, ["k"], "seq", additive=True)


@QUERIES.add(
    "select cast(row_number() over () - 1 as integer) as position, column_name as name, case column_type when 'VARCHAR' then 'string' else lower(column_type) end as dtype "
    "from (describe select nullif(o_orderkey, 6) as k, o_custkey % 50 as v, 'x' as note from orders)"
)
def merge_schema_effective(spark, sf_dir):
    source = _source(spark, sf_dir).drop("seq").withColumn("note", F.lit("x"))
    schema = merge.effective_schema(_target(spark, sf_dir).schema, source.schema, additive=True)
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)], "position int, name string, dtype string")


@QUERIES.add("select l_orderkey, l_linenumber, cast(count(*) as bigint) as variants from (select distinct l_orderkey, l_linenumber, l_returnflag, nullif(l_linestatus, 'O') as status from lineitem) group by 1, 2 having count(*) > 1")
def merge_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag", "nullif(l_linestatus, 'O') as status")
    return merge.conflicts(rows, ["l_orderkey", "l_linenumber"])


@QUERIES.add("select l_orderkey, l_linenumber, count(*) as variants from lineitem group by 1, 2 having count(*) > 1")
def merge_conflicts_keyonly(spark, sf_dir):
    return merge.conflicts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@QUERIES.add(f"{CTE} select (select count(*) from t) as target_rows, (select count(*) from s) as source_rows, (select count(*) from s where {ALL}) as insert_rows")
def merge_preview_append(spark, sf_dir):
    return merge.preview_append(_target(spark, sf_dir), _source(spark, sf_dir).drop("seq"))


@QUERIES.add(
    f"{CTE}, d as (select distinct k from s) select (select count(*) from t) as target_rows, (select count(*) from d) as source_keys, "
    "(select count(*) from t where exists (select 1 from d where d.k is not distinct from t.k)) as replace_rows, (select count(*) from d where not exists (select 1 from t where t.k is not distinct from d.k)) as insert_rows"
)
def merge_preview_upsert(spark, sf_dir):
    return merge.preview_upsert(_target(spark, sf_dir), _source(spark, sf_dir), ["k"])
