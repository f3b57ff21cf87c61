"""Exact deduplication in DataFrame operations only.

Equal texts are combined three times, and each time the whole text is a grouping key beside its SHA-256
digest, so content is compared and not only hashes: first inside each input partition (map-side combine), then
in salted digest groups, then over the salts' winners. A group of copies therefore reaches a reducer as at most
one row per input partition, spread over `salts` reducers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .components import attach


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _salted(docs: DataFrame, text_col: str, digest, salts: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"_text": text, "_digest": digest(text), "_salt": F.pmod(F.spark_partition_id(), F.lit(salts))})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, salts: int = 16) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, digest.

    Texts are equal when identical; null counts as the empty text. Of equal texts the largest id stays. A null
    id never wins over another; where all ids of a group are null, keep_id is null and every row is kept.
    Repeated rows with the largest id are all marked kept. Other columns are not read. The members of a very large
    group are narrow rows by then, which adaptive execution splits over tasks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    salted = _salted(rows, "text", digest, salts).groupBy("_digest", "_salt", "_text").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    whole = salted.repartition("_digest").groupBy("_digest", "_text").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    # a digest with one text decides its documents alone; the rest are told apart by their texts below
    groups = cut(whole.groupBy("_digest").agg(F.max("keep").alias("keep_id"), F.max("n").alias("group_size"), F.count("*").alias("texts")), "digests")
    alone = groups.filter("texts = 1 and group_size = 1").select(F.col("keep_id").alias("id"), "keep_id", "group_size", F.col("_digest").alias("digest"))
    copies = groups.filter("texts = 1 and group_size > 1")
    members = rows.select("id", digest(F.coalesce("text", F.lit(""))).alias("_digest"))
    out = alone.union(attach(members, "_digest", copies).select("id", "keep_id", "group_size", F.col("_digest").alias("digest")))
    clashes = groups.filter("texts > 1").select("_digest")
    if not clashes.isEmpty():
        clashing = _salted(rows, "text", digest, salts).join(clashes, "_digest", "left_semi").select("id", "_digest", "_text")
        each = clashing.groupBy("_digest", "_text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.union(clashing.join(each, ["_digest", "_text"]).select("id", "keep_id", "group_size", F.col("_digest").alias("digest")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, salts: int = 16) -> DataFrame:
    """One whole row of `docs` for each distinct text, that with the largest id; the columns of `docs`.

    Null counts as the empty text. Of rows equal in text and id, one stays.
    """
    names = docs.columns
    plain = [F.col(f"`{c}`") for c in names if "map" not in docs.schema[c].dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`") for c in names if c != text_col], F.col(f"`{text_col}`").isNull().alias("_null"))
    keyed = _salted(docs.select(row.alias("_row"), F.col(f"`{text_col}`"), F.struct(F.col(f"`{id_col}`"), F.xxhash64(*plain)).alias("_order")), text_col, digest, salts)
    salted = keyed.groupBy("_digest", "_salt", "_text").agg(F.max_by("_row", "_order").alias("_row"), F.max("_order").alias("_order"))
    whole = salted.groupBy("_digest", "_text").agg(F.max_by("_row", "_order").alias("_row"))
    text = F.when(~F.col("_row._null"), F.col("_text"))
    return whole.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names])


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
select doc_id, max(doc_id) over same as keep_id, cast(count(*) over same as bigint) as group_size,
       doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
