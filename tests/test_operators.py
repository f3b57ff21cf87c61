import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shardwell.operators import merge, rowdiff, series
from shardwell.operators.profile import is_sorted, profile


def test_profile_of_odd_types(spark):
    df = spark.createDataFrame(
        [(1, [1], {"a": 1}, bytearray(b"\x01\xff"), math.inf, math.nan, dt.timedelta(seconds=90), dt.datetime(2024, 1, 1, 8)), (None, None, None, None, -math.inf, 2.0, None, dt.datetime(2024, 1, 1, 10))],
        "i int, l array<int>, m map<string,int>, b binary, x double, y double, d interval day to second, t timestamp_ltz",
    )
    found = {r["column"]: r for r in profile(df, deep=True).collect()}
    assert list(found) == df.columns
    assert (found["i"]["null_rate"], found["i"]["min"], found["i"]["unique"]) == (0.5, "1", 2)
    assert found["l"]["min"] is None and found["m"]["unique"] is None
    assert found["b"]["max"] == "01ff"
    assert (found["y"]["min"], found["y"]["max"], found["y"]["stddev"]) == ("2.0", "2.0", None)
    assert found["t"]["median"] == "2024-01-01T09:00:00+00:00"


def test_profile_without_rows(spark):
    r = profile(spark.createDataFrame([], "a int"), deep=True).first()
    assert (r["null_rate"], r["min"], r["mean"], r["n"]) == (0.0, None, None, 0)


def test_rowdiff(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (2, "b", math.nan), (None, "n", None)], "k bigint, s string, v double")
    right = spark.createDataFrame([(2, "b", math.nan), (None, "m", None), (3, "c", 3.0)], "k bigint, s string, v double")
    found = rowdiff.compare(left, right, ["k"])
    assert found.summary().first().asDict() == {"added": 1, "removed": 1, "updated": 1, "unchanged": 1}
    one = found.updated().collect()
    assert one[0]["k"] is None and [d.asDict() for d in one[0]["deltas"]] == [{"column": "s", "left": "n", "right": "m"}]


def test_rowdiff_of_other_types_has_no_delta(spark):
    left, right = spark.createDataFrame([(1, 1)], "k int, v bigint"), spark.createDataFrame([(1, 1.0)], "k int, v double")
    found = rowdiff.compare(left, right, ["k"])
    assert found.summary().first()["updated"] == 1 and found.updated().first()["deltas"] == []


def test_rowdiff_of_missing_columns_and_keys_alone(spark):
    left, right = spark.createDataFrame([(1, "a")], "k int, gone string"), spark.createDataFrame([(1,)], "k int")
    assert rowdiff.compare(left, right, ["k"]).summary().first()["updated"] == 1
    assert rowdiff.compare(right, right, ["k"]).summary().first()["unchanged"] == 1


def test_rowdiff_checks_keys(spark):
    one, two = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), spark.createDataFrame([(1, 1)], "k int, v int")
    with pytest.raises(rowdiff.DiffError, match="Duplicate key rows detected"):
        rowdiff.compare(one, two, ["k"])
    for keys in ([], ["k", "k"], ["nothing"]):
        with pytest.raises(rowdiff.DiffError):
            rowdiff.compare(two, two, keys)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_append_keeps_target_repeats(spark):
    target = spark.createDataFrame([(1, 10), (1, 10), (2, None)], "id int, v int")
    source = spark.createDataFrame([(1, 10), (2, None), (3, 30), (3, 30)], "id int, v int")
    assert got(merge.append(target, source)) == [(1, 10), (1, 10), (2, None), (3, 30)]
    assert merge.preview_append(target, source).first()["insert_rows"] == 2


def test_append_of_many_columns_with_nulls(spark):
    schema = "a int, b string, c double, d date, e boolean"
    target = spark.createDataFrame([(1, None, 1.0, None, True)], schema)
    source = spark.createDataFrame([(1, None, 1.0, None, True), (1, None, None, None, True)], schema)
    assert merge.append(target, source).count() == 2


def test_upsert_takes_the_last_and_matches_null_keys(spark):
    target = spark.createDataFrame([(None, "old"), (1, "keep")], "id int, v string")
    source = spark.createDataFrame([(None, "first", 0), (None, "last", 1), (2, "new", 2)], "id int, v string, o int")
    assert got(merge.upsert(target, source, ["id"], "o")) == sorted([(None, "last"), (1, "keep"), (2, "new")], key=repr)
    found = merge.preview_upsert(target, source, ["id"]).first()
    assert (found["replace_rows"], found["insert_rows"]) == (1, 1)


def test_additive_schema(spark):
    target, source = spark.createDataFrame([(1, "t")], "id int, category string"), spark.createDataFrame([(2, 5.0)], "id int, extra double")
    out = merge.append(target, source, additive=True)
    assert out.columns == ["id", "category", "extra"] and got(out) == [(1, "t", None), (2, None, 5.0)]
    with pytest.raises(merge.MergeError):
        merge.append(target, source)
    with pytest.raises(merge.MergeError, match="types differ"):
        merge.append(target, spark.createDataFrame([(2, 1)], "id int, category int"))


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "b")], "id int, v string")
    assert got(merge.conflicts(df, ["id"])) == [(1, 2)]
    assert got(merge.conflicts(df.select("id"), ["id"])) == [(1, 2), (2, 2)]
    with pytest.raises(merge.MergeError, match="Conflicting duplicate key"):
        merge.check_conflicts(df, ["id"])


def test_outlier_spike(spark):
    points = [(float(i), 10 + (0.2 if i % 2 else -0.2)) for i in range(24)]
    points[11] = (11.0, 80.0)
    out = series.outliers(spark.createDataFrame(points, "x double, y double"))
    assert (11.0, 80.0) in {(r["x"], r["y"]) for r in out.filter("is_outlier").collect()}
    assert series.outliers(spark.createDataFrame(points[:7], "x double, y double")).filter("is_outlier").count() == 0


def test_outliers_like_brute_force(spark):
    rng = random.Random(5)
    points = [(rng.uniform(0, 100) ** 1.5, rng.gauss(0, 1) * (30 if rng.random() < 0.05 else 1)) for _ in range(300)]
    xs = [p[0] for p in points]
    lo, hi, n = min(xs), max(xs), min(24, int(math.sqrt(len(points))))
    pools: dict[int, list] = {}
    for x, y in points:
        pools.setdefault(min(n - 1, int((x - lo) / ((hi - lo) / n))), []).append((x, y))
    small = [p for b in pools.values() if len(b) < 6 for p in b]
    want = set()
    for b in [b for b in pools.values() if len(b) >= 6] + ([small] if len(small) >= 8 else []):
        mid = statistics.median(y for _, y in b)
        mad = 1.4826022185056018 * statistics.median(abs(y - mid) for _, y in b)
        want |= {(x, y) for x, y in b if abs(y - mid) / mad > 3.5}
    out = series.outliers(spark.createDataFrame(points, "x double, y double"))
    assert {(r["x"], r["y"]) for r in out.filter("is_outlier").collect()} == want


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_resample_like_numpy(spark, method):
    from shardwell.render.text import resampled

    rng = random.Random(2)
    points = [(float(x), rng.random()) for x in rng.sample(range(1000), 60)]
    got = [r["y"] for r in series.resample(spark.createDataFrame(points, "x double, y double"), 37, method).collect()]
    assert got == pytest.approx(resampled(points, 37, method))


def test_axis_numbers(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 2), dt.date(1970, 1, 3), dt.timedelta(minutes=1, milliseconds=500), True)], "t timestamp_ntz, d date, i interval day to second, b boolean")
    assert tuple(df.select(*[series.to_number(F.col(f.name), f.dataType) for f in df.schema.fields]).first()) == (86400.0, 172800.0, 60.5, 1.0)


def test_sorted(spark):
    df = spark.range(200).withColumn("down", -F.col("id")).withColumn("flat", F.lit(1)).withColumn("dent", F.when(F.col("id") == 150, 3).otherwise(F.col("id")))
    assert [is_sorted(df, c, "id").first()[0] for c in ("id", "down", "flat", "dent")] == [True, False, True, False]


def test_chart_kind():
    assert series.chart_kind("temporal", 0, False) == "line" and series.chart_kind("temporal", 1, True) == "scatter"
    assert series.chart_kind("numeric", 0, False) == "scatter" and series.chart_kind("numeric", 0, True) == "line"
    assert series.chart_kind("categorical", 0, True) == "scatter"


@pytest.mark.parametrize("accuracy", [10, 1000])
def test_exact_quantiles_like_numpy(spark, accuracy):
    import numpy as np

    from shardwell.operators.quantiles import exact_quantiles

    rng = random.Random(accuracy)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 400 + [1.0] * 399, "many": [rng.gauss(0, 9) for _ in range(3001)], None: [float(i) for i in range(10)], "odd": [math.inf, -math.inf, 0.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    found = {r["g"]: r["q"] for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", [0.0, 0.25, 0.5, 1.0], accuracy).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        if g != "odd":
            assert found[g] == pytest.approx(list(np.quantile(vs, [0.0, 0.25, 0.5, 1.0])))
    assert found["odd"][2] == 0.0


@pytest.mark.parametrize(("accuracy", "most"), [(10_000, 100_000), (20, 40), (100, 3)])
def test_column_medians_like_numpy(spark, accuracy, most):
    import numpy as np

    from shardwell.operators.quantiles import column_medians

    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), float(i % 7), 5.0, None if i % 3 else float(i), math.nan if i % 2 else 1.0, math.nan if i % 3 else 1.0, None, math.inf if i % 2 else -math.inf) for i in range(1201)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double").repartition(3)
    got = column_medians(df, [F.col(c) for c in df.columns], accuracy, most)
    assert got[:4] == [pytest.approx(np.median([r[k] for r in rows if r[k] is not None])) for k in range(4)]
    assert got[4] == 1.0 and math.isnan(got[5]) and got[6] is None and got[7] == -math.inf
    assert column_medians(df.limit(0), [F.col("a"), F.col("b")], accuracy, most) == [None, None]
