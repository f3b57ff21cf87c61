"""The corpus pipeline, stage by stage against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_dedup import brute_kept

from shardwell.llm import decontaminate, langid, mixing
from shardwell.llm.common import cut

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into each stage and what comes out."""
    extra = [(10_001, "12 34 !!", "en", "src1", 8), (10_002, None, None, None, None), (10_003, "", "en", "src2", 0), (None, "the thing of the inhere and that", "en", "src3", 32)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = cut(docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("id", F.lit("x")), "in")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5 and all(s.columns == steps[0].columns for s in steps[:5])
    assert all(s.count() for s in steps)


def test_language_stage(steps):
    import pyarrow as pa

    model = langid.fit(steps[0])
    rows = steps[0].collect()
    _, _, rejected = langid.predict(model, pa.array([r["text"] for r in rows], pa.string()))
    assert ids(steps[1]) == Counter(r["doc_id"] for r, no in zip(rows, rejected, strict=True) if not no)
    assert not {10_001, 10_002, 10_003} & set(ids(steps[1])) and None in ids(steps[1])
    assert sum(rejected) <= 3 + 0.005 * len(rows)


def test_exact_stage(steps):
    best = {}
    for r in steps[1].collect():
        if r["text"] not in best or (r["doc_id"] or -1) > (best[r["text"]] or -1):
            best[r["text"]] = r["doc_id"]
    assert ids(steps[2]) == Counter(best.values())


def test_near_stage(steps):
    rows = {r["doc_id"] if r["doc_id"] is not None else 10**9: r["text"] for r in steps[2].collect()}
    kept = {10**9 if i is None else i for i in ids(steps[3])}
    order = sorted(rows)
    assert kept == {order[i - 1] for i in brute_kept([rows[i] for i in order])}


def test_benchmark_stage(spark, steps):
    items = [decontaminate.fold(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: decontaminate.fold(r["text"].encode()) for r in steps[3].collect()}
    dirty = {i for i, t in before.items() if any(p in t for p in items)}
    assert dirty and set(ids(steps[4])) == set(before) - dirty


def test_mixture_stage(steps):
    taken = Counter()
    for r in mixing.mix(steps[4]).filter("taken and size > 0").collect():
        taken[r["id"]] += 1
    assert ids(steps[5]) == taken
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in steps[5].collect())
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in steps[4].collect())
    assert abs(words - total) < 0.2 * total


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() > 100


def test_empty_table(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
