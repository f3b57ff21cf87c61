"""Every query that has SQL gives the SQL's rows at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest
from helpers import put

from shardwell.queries import all_queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = all_queries()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query(spark, con, name):
    query, sql = QUERIES[name]
    df = query(spark, str(DATA))
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert norm(map(tuple, df.collect()), df.columns) == norm(found.fetchall(), columns)


def test_plot_run_line_of_many_users(spark, tmp_path):
    """More points than are drawn, each a tie of the sixth digit, and rows that the filter drops."""
    users = range(20_500)
    put(tmp_path / "events.parquet", user_id=[*users, *users], value=[*((20_000_001 + 2 * u) / 2e6 for u in users), *(float(u % 10) for u in users)])
    query, sql = QUERIES["plot_run_line"]
    want = duckdb.sql(sql.replace("events", f"'{tmp_path}/events.parquet'")).fetchall()
    assert len(want) == len(users)
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(want)


def test_every_query_has_sql():
    assert [n for n, (_, sql) in QUERIES.items() if not sql] == []
