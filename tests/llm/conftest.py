from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as extra columns.
CLASHES = ("id", "fp", "hash", "_row", "_id", "_hash", "_k", "component", "digest", "keep_id", "size", "taken", "pass", "finish", "score", "spans", "path", "license", "h")


@pytest.fixture
def docs(spark):
    """Documents from texts, with ids from 1 on unless given, and extra columns with clashing names."""

    def make(texts, ids=None, source=None, lang=None):
        ids = ids or range(1, len(texts) + 1)
        rows = [(i, t, (lang or ["en"] * len(texts))[k], (source or ["s"] * len(texts))[k], None if t is None else len(t), *[f"x{i}"] * len(CLASHES)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in CLASHES))

    return make


@pytest.fixture
def table(spark):
    from shardwell.llm.common import table as read

    return lambda name, sf="sf0.001": read(spark, f"/root/testdata/{sf}", name)


