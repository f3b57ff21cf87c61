"""Connected components of an edge table by alternating large-star and small-star rounds.

Only aggregates and equi-joins on narrow rows; each round is written to the shared folder, so neither the
lineage nor the driver holds the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def attach(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Inner join of `rows` with `found`, which has each key once.

    `found` comes from the shared folder and so brings no partitioning along: the join shuffles both sides
    itself, and adaptive execution can then split a hot key's rows over several tasks.
    """
    return rows.join(found, key)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    moved = attach(both.filter("b > a"), "a", least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return _written(moved.distinct(), edges, least)


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = attach(down, "a", least).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _written(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), edges, least)


def _written(edges: DataFrame, *used: DataFrame) -> DataFrame:
    out = cut(edges, "edges")
    for df in used:
        forget(df.sparkSession, df)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(a long, b long)`; the root is the smallest node reachable.

    Self-links and repeated links are allowed; a node that only links to itself is not returned. No edges:
    an empty result.
    """
    now = cut(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = _small(_large(now))
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
