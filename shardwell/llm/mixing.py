"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (MD5 of seed and id) and may pass `most` times. A passing
document's virtual finish time is the source's words up to its end, divided by the source's target. All
passes are range-sorted by that time and cut where the words reach the total budget; the last document stays
if the cut is nearer with it than without.

Running sums never need a whole source or the whole order in one task: sums per (source, slice of the shuffle) are
added up first, and only rows of one slice are summed one by one. Where the budget is reached is found in slices of
virtual time, and in slices of the one slice that holds it, before the rows of that one are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

SLICES = 1024  # slices of virtual time between 0 and 1, and of each slice; the last slice of SLICES * 4 is open


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target stops
    at `most` times its source's size, and the excess goes to the others by weight. One row per source is
    gathered, which the number of sources bounds.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levels = weighed.withColumn("turn", F.row_number().over(order)).withColumn("level", (F.col("total") - filled) / left)
    first = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("turn", "level"))).over(W.partitionBy())
    return levels.withColumn("share", first["level"]).select("source", "source_size", F.coalesce(F.least("cap", F.col("share") * F.col("weight")), "cap").alias("target"))


def _reached(slices: list, before: int, budget: int) -> tuple[int, int]:
    """The slice in which the budget is reached, and the words before it; the last one if it never is."""
    at = 0
    for r in sorted(slices, key=lambda r: r["at"]):
        at = r["at"]
        if before + r["words"] > budget:
            return at, before
        before += r["words"]
    return at + 1, before


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", slices: int = 4096) -> DataFrame:
    """The passes of all documents in the order of the mix: id, source, size, hash (xxHash64 of the text),
    place (tells repeated rows apart), source_size, target, pass (0, 1, ...), finish (virtual), taken (boolean).

    A null or blank text has size 0 and takes nothing; a null source is a source of its own; a null id
    shuffles as the empty string. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("hash"))
    rows = cut(rows, "sizes").withColumn("shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumn("slice", F.pmod(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("bigint") * slices / F.lit(1 << 32), F.lit(slices)).cast("int"))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    starts = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    starts = starts.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("slice")) - F.col("words"))
    starts = starts.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "s.slice", "before", "source_size", "target")
    within = W.partitionBy("source", "slice").orderBy("shuffle", "id", "hash", "size")
    rows = rows.withColumn("place", F.row_number().over(within)).withColumn("end", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.slice") == F.col("s.slice")))
    rows = rows.select("r.id", "r.source", "r.slice", "size", "hash", "shuffle", "place", "source_size", "target", (F.col("before") + F.col("end")).alias("end"))
    passes = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.withColumn("finish", F.when(F.col("target") > 0, (F.col("pass") * F.col("source_size") + F.col("end")).cast("double") / F.col("target")).otherwise(0.0))
    passes = cut(passes.withColumn("span", F.least(F.floor(F.col("finish") * SLICES), F.lit(4 * SLICES - 1)).cast("int")), "passes")
    budget = passes.filter("pass = 0").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # each time at most 4 * SLICES + 1 rows come to the driver
    span, before = _reached(passes.groupBy(F.col("span").alias("at")).agg(F.sum("size").alias("words")).collect(), 0, budget)
    fine = F.floor((F.col("finish") * SLICES - F.col("span")) * SLICES).cast("bigint")
    fine = F.when(F.col("span") == 4 * SLICES - 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(fine, F.lit(SLICES - 1)))).cast("int")
    part, before = _reached(passes.filter(F.col("span") == span).groupBy(fine.alias("at")).agg(F.sum("size").alias("words")).collect(), before, budget)
    place = F.struct(F.col("span").alias("x"), F.when(F.col("span") == span, fine).otherwise(0).alias("y"))
    edge = F.struct(F.lit(span).alias("x"), F.lit(part).alias("y"))
    sure = passes.filter(place != edge).withColumn("taken", place < edge)
    order = W.partitionBy("span").orderBy("finish", F.col("source").asc_nulls_last(), "pass", "slice", "place").rowsBetween(W.unboundedPreceding, 0)
    edge = passes.filter(place == edge).withColumn("taken", F.lit(before) + F.sum("size").over(order) - F.col("size") / 2 <= budget)
    columns = ["id", "source", "slice", "size", "hash", "place", "source_size", "target", "pass", "finish", "taken"]
    return sure.select(*columns).union(edge.select(*columns)).orderBy("finish", F.col("source").asc_nulls_last(), "pass", "slice", "place")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Whole rows of `docs` in the order of the mix, a document once per pass that the mix takes, with the
    columns mix_pass and mix_finish (a column of `docs` of that name gives way). Rows equal in source, id and text
    stand for each other; null and blank texts are in no mix; an empty table stays empty."""
    taken = mix(docs, id_col, text_col, source_col, **options).filter("taken and size > 0")
    same = W.partitionBy("_source", "_id", "_hash", "pass").orderBy("slice", "place")
    taken = taken.select(F.col("source").alias("_source"), F.col("id").alias("_id"), F.col("hash").alias("_hash"), "slice", "place", "pass", "finish").withColumn("_k", F.row_number().over(same))
    names = [c for c in docs.columns if c not in ("mix_pass", "mix_finish")]
    rows = docs.filter(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]")).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{source_col}`").alias("_source"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_hash"))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("_source", "_id", "_hash").orderBy(F.lit(0))))
    equal = lambda c: F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    both = rows.alias("r").join(taken.alias("t"), equal("_source") & equal("_id") & equal("_hash") & (F.col("r._k") == F.col("t._k")))
    return both.orderBy("finish", F.col("_row")[source_col].asc_nulls_last(), "pass", "slice", "place").select("_row.*", F.col("pass").alias("mix_pass"), F.col("finish").alias("mix_finish"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    passes = mix(table(spark, sf_dir, "documents"))
    each = passes.groupBy("source", "slice", "place").agg(*[F.first(c).alias(c) for c in ("id", "size", "source_size", "target")], F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = r"""
with sizes as (
  select doc_id as id, source, md5('mix:' || coalesce(cast(doc_id as varchar), '')) as shuffle, row_number() over () as line,
         cast(case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as bigint) as size
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as turn from sizes group by source),
weighed as (
  select *, case turn % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         cast(source_size * 3 as double) as cap, cast(sum(source_size) over () as double) as total from sources),
levels as (
  select *, cap / weight as ratio,
         (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level,
         row_number() over (order by cap / weight, source nulls last) as place from weighed),
goals as (
  select l.source, source_size, coalesce(least(cap, weight * (select arg_min(level, place) from levels where ratio > level)), cap) as target from levels l),
ends as (
  select z.*, source_size, target,
         cast(sum(size) over (partition by z.source order by shuffle, id, line rows unbounded preceding) as bigint) as stop
  from sizes z join goals g on z.source is not distinct from g.source),
passes as (
  select *, case when target > 0 then cast(pass * source_size + stop as double) / target else 0.0 end as finish
  from ends, (select unnest([0, 1, 2]) as pass)),
sums as (
  select *, sum(size) over (order by finish, source nulls last, pass, shuffle, id, line rows unbounded preceding) - size / 2.0 as middle,
         (select sum(size) from sizes) as budget from passes)
select id as doc_id, size, source_size, target, cast(sum(case when middle <= budget then size else 0 end) as bigint) as taken
from sums group by line, id, size, source_size, target
"""
