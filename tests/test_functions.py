import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardwell.functions import filters, histogram
from shardwell.functions.digest import digest
from shardwell.functions.ordinal import ORDER, order_key, with_ordinal
from shardwell.functions.types import common_type, signature, union_relaxed
from shardwell.render import text


@pytest.mark.parametrize(("n", "bins"), [(0, 0), (1, 2), (4, 2), (25, 5), (400, 8)])
def test_bins(n, bins):
    assert histogram.bin_count(n) == bins


def test_numeric_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,), (math.nan,), (math.inf,)], "v double")
    found = histogram.numeric_histogram(df, F.col("v"))
    assert found == [("1..2.5", 2), ("2.5..4", 2)]
    assert histogram.numeric_histogram(df.filter("v = 3"), F.col("v")) == [("3", 1)]
    assert histogram.numeric_histogram(df.filter("v is null"), F.col("v")) == []


def test_last_bin_is_closed(spark):
    df = spark.range(0, 101).select(F.col("id").cast("double").alias("v"))
    found = histogram.numeric_histogram(df, F.col("v"))
    assert sum(n for _, n in found) == 101 and found[-1][1] == 13


@pytest.mark.parametrize(
    ("text", "want"),
    [("a>=3", ("a", ">=", "3")), ("a ==x", ("a", "==", "x")), ("[t>=s]==1", ("t>=s", "==", "1")), ("part description!=OK", ("part description", "!=", "OK")), ("a<b>c", ("a", "<", "b>c"))],
)
def test_filter_parse(text, want):
    e = filters.parse(text)
    assert (e.column, e.op, e.value) == want


@pytest.mark.parametrize("text", ["a=>1", "a", "==1", "a==", "", "[a]", "a] > 1", "x[a] > 1", "[a]b > 1", "[a > 1", "[[a] > 1", "[ ] > 1"])
def test_filter_parse_fails(text):
    with pytest.raises(filters.FilterError, match="Invalid --filter expression"):
        filters.parse(text)


def test_filter_literals(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "x", True, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 12)), (None,) * 6],
        "i int, d double, s string, b boolean, day date, ts timestamp_ntz",
    )
    for e in ("i==1", "i<1.5", "d>=1.5", 's=="x"', "s==x", "b==TRUE", "day==2024-01-01", "ts<=2024-01-01T14:00:00+02:00", "ts>2024-01-01", "i!=2"):
        assert df.filter(filters.predicate(e, df.schema)).count() == 1, e
    for e in ("b==1", "i==x", "day==soon", "nothing==1"):
        with pytest.raises(filters.FilterError):
            filters.predicate(e, df.schema)


def test_common_types():
    i, l, d, s = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
    assert common_type(i, l) == l and common_type(l, d) == d and common_type(i, s) == s
    assert common_type(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()
    assert common_type(T.NullType(), i) == i
    with pytest.raises(TypeError):
        common_type(T.ArrayType(i), s)


def test_union_relaxed_keeps_text(spark):
    a = spark.createDataFrame([(1, "x")], "k int, t string")
    b = spark.createDataFrame([("q", 2.5)], "k string, extra double")
    assert [tuple(r) for r in union_relaxed([a, b]).orderBy("k").collect()] == [("1", "x", None), ("q", None, 2.5)]


def test_signature_depends_on_order():
    assert signature([("a", "int"), ("b", "int")]) != signature([("b", "int"), ("a", "int")])


def test_digest(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("string").alias("v"))
    of = lambda d, o="id": d.agg(digest(F.expr(o), F.col("v"), T.StringType())).first()[0]
    assert of(df) == of(df.repartition(7, "v"))
    assert of(df) != of(df, "case id when 1 then 2 when 2 then 1 else id end")
    assert of(df) != of(df.withColumn("v", F.when(F.col("id") != 3, F.col("v"))))
    nulls = spark.createDataFrame([(0, None), (0, "<NULL>")], "id int, v string")
    assert of(nulls.filter("v is null")) != of(nulls.filter("v is not null"))


def test_ordinals_follow_the_files(spark, tmp_path):
    for name, first in (("b", 100), ("a", 0)):
        spark.range(first, first + 50).coalesce(1).write.csv(str(tmp_path / f"{name}.csv"), header=True)
    df = spark.read.csv([str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], header=True, inferSchema=True).withColumn(ORDER, order_key())
    got = with_ordinal(df).orderBy("_ordinal").collect()
    assert [r["_ordinal"] for r in got] == list(range(100))
    assert [r["id"] for r in got] == [*range(50), *range(100, 150)]


def test_ticks():
    assert text.number_tick(3.0) == "3" and text.number_tick(1 / 3) == "0.333333" and text.number_tick(-1e20) == "-100000000000000000000"
    assert text.time_tick(0) == "1970-01-01" and text.time_tick(86_399.5) == "1970-01-01 23:59:59Z"
    for unit in (1, 1e3, 1e6, 1e9):
        assert text.time_tick(1_700_000_000 * unit) == "2023-11-14 22:13:20Z"
    assert text.time_tick(math.inf) == "inf" and text.time_tick(1e12 * 1e3 - 1e14 * 9) != ""
    assert text.steps(0, 10, 5) == [0, 2, 4, 6, 8] and text.steps(3, 3, 4) == [3]
    for low, high, most in ((0.1, 0.9, 4), (-7, 1e6, 6), (1e-9, 2e-9, 3), (5, 5.5, 1)):
        found = text.steps(low, high, most)
        assert 1 <= len(found) <= most and all(low - 1e-9 <= v <= high + 1e-9 for v in found)


def test_chart_width():
    assert text.chart_width(80) == 80 and text.chart_width(200) == 180 and text.chart_width(9999) == 480


def test_bars():
    assert text.bars([("a", 2), ("bb", 4)], width=4).splitlines() == [" a▕██ 2", "bb▕████ 4"]
    assert text.bars([("a", 1), ("b", 16)], width=2, s=text.ASCII).splitlines() == ["a|= 1", "b|== 16"]
    assert text.bars([("a", 0), ("b", 3)], width=1).splitlines()[0] == "a▕ 0" and text.bars([]) == ""
    assert all(len(r) <= 12 for r in text.bars([("a long label here", 2)], room=12).splitlines())
    assert max(map(len, text.bars([("x" * 90, 2), ("y", 1)], width=5).splitlines())) == 35 + 1 + 5 + 2


def test_canvas():
    lines = text.scatter([(0.0, 0.0), (10.0, 100.0)], [(5.0, 50.0)], room=30, height=6).splitlines()
    assert len(lines) == 8 and lines[0].rstrip().endswith("•") and "×" in lines[2] + lines[3] and lines[5].split("╼")[-1].startswith("•")
    assert lines[-1].split() == ["0", "10"] and all(len(r) <= 30 for r in lines)
    assert text.scatter([(1.0, 1.0)], room=20, height=3).count("•") == 1 and text.scatter([(math.nan, 1.0)]) == ""
    far = text.scatter([(0.0, 0.0), (1e9, 1.0)], room=14, height=3, x_tick=text.time_tick).splitlines()
    assert far[-2].split() == ["1970-01-01"] and "2001-09-09 01:46:40Z" in far[-1]
    steep = text.line([(0.0, 0.0), (1.0, 0.0), (2.0, 9.0), (3.0, 9.0)], room=24, height=9)
    assert "┃" in steep and steep.splitlines()[0].rstrip().endswith("•")


def test_line_resampling_takes_the_left_of_two():
    points = [(0.0, 0.0), (2.0, 10.0), (1.0, 4.0)]
    assert text.resampled(points, 5) == [0, 2, 4, 7, 10]
    assert text.resampled(points, 5, "nearest") == [0, 0, 4, 4, 10]
    assert text.resampled([(1.0, 3.0), (1.0, 5.0)], 5) == [3.0, 5.0]
    assert "*" in text.line(points, s=text.ASCII)
