from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from helpers import put  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from shardwell.session import session

    root = tmp_path_factory.mktemp("shared")
    s = session("4", **{"spark.checkpoint.dir": f"file://{root}", "spark.sql.warehouse.dir": f"file://{root}/warehouse", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def same(tmp_path):
    """A folder of one schema in two formats."""
    put(tmp_path / "same" / "a.csv", id=[1, 2], value=[1.5, 2.5], ts=[dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    put(tmp_path / "same" / "b.feather", id=[3, 4], value=[3.5, 4.5], ts=[dt.date(2024, 1, 3), dt.date(2024, 1, 4)])
    return tmp_path / "same"


@pytest.fixture
def drift(tmp_path):
    put(tmp_path / "drift" / "a.csv", id=[1, 2], value=[1.5, 2.5])
    put(tmp_path / "drift" / "b.feather", id=[3, 4], value=[3.5, 4.5])
    put(tmp_path / "drift" / "c.csv", id=[5], value=[5.5], extra=["x"])
    return tmp_path / "drift"
