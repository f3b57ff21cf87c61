"""The corpus pipeline: documents in the languages known, without copies, near copies and benchmark passages,
mixed to the sources' target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents; extra columns pass through whatever their
names. An empty table stays empty in every stage. Rows without an id are documents like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardwell.llm import decontaminate, exact, langid, mixing, simhash
from shardwell.llm.common import cut, table
from shardwell.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows. Null and letterless texts go, and those whose language is doubtful
    or whose subwords are strange to it. The model learns from at most 4000 rows with an id and a language."""
    ship(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, that with the largest doc_id; a null text counts as empty."""
    return exact.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest doc_id (null last).

    Near copies have sets of five-word shingles of Jaccard similarity 0.8 or more; texts of under five words are one
    shingle. The trie join of SimHash fingerprints finds the first pairs, an exact search the rest."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within 8 % edits; null and empty texts hold none."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: a row for each pass of a document that the mix takes; blank texts are in no mix."""
    return mixing.mixed(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("mixing to target weights", mixture),
]

#: A trained model, components of similar texts and alignment are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table: its columns, mix_pass and mix_finish, in the mix's
    order. What each stage returns is a table in the shared folder until the application ends."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i}")
    return docs
