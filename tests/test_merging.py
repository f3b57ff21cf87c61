import pytest
from helpers import put, rows

from shardwell.operators.merge import MergeError
from shardwell.plans import compiling, merging
from shardwell.plans.merging import Options, Step, Strategy
from shardwell.sources.files import resolve


def test_append(spark, tmp_path):
    source, target = put(tmp_path / "s.csv", id=[1, 3], value=[10, 30]), put(tmp_path / "t.csv", id=[2, 1, 1], value=[20, 10, 10])
    merging.run(spark, source, target, Options(out=tmp_path / "o" / "out.csv"))
    assert rows(spark, tmp_path / "o" / "out.csv") == [(2, 20), (1, 10), (1, 10), (3, 30)]


def test_upsert_in_place(spark, tmp_path):
    source, target = put(tmp_path / "s.parquet", id=[2, 2, 4], value=[1, 2, 4]), put(tmp_path / "t.parquet", id=[1, 2], value=[10, 20])
    merging.run(spark, source, target, Options(Strategy.UPSERT, ("id",), inplace=True))
    assert rows(spark, target) == [(1, 10), (2, 2), (4, 4)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s.parquet", "t.parquet"]


def test_conflict_leaves_all_as_it_was(spark, tmp_path):
    source, target = put(tmp_path / "s.csv", id=[1], value=[2]), put(tmp_path / "t.csv", id=[1], value=[1])
    with pytest.raises(MergeError, match="Conflicting duplicate key"):
        merging.run(spark, source, target, Options(keys=("id",), out=tmp_path / "new" / "o.csv"))
    assert not (tmp_path / "new").exists() and rows(spark, target) == [(1, 1)]
    assert merging.run(spark, source, target, Options(keys=("id",), out=tmp_path / "o.csv"), dry=True).issues


def test_folders(spark, tmp_path):
    s, t, o = tmp_path / "s", tmp_path / "t", tmp_path / "o"
    put(s / "sales.csv", id=[2], value=[20])
    put(s / "sub" / "new.feather", id=[7], value=[70])
    put(t / "sales.parquet", id=[1], value=[10])
    put(t / "target_only.csv", id=[5], value=[50])
    options = Options(ignore_filetype=True, out=o)
    plan = merging.plan(resolve(s), resolve(t), options)
    assert [p.step for p in plan] == [Step.MERGE, Step.SOURCE_ONLY, Step.TARGET_ONLY]
    dry = merging.run(spark, s, t, options, dry=True)
    assert not dry.issues and not o.exists() and any("cast" in line and "insert_rows 1" in line for line in dry.lines)
    merging.run(spark, s, t, options)
    assert rows(spark, o / "sales.parquet") == [(1, 10), (2, 20)]
    assert rows(spark, o / "sub" / "new.feather") == [(7, 70)] and rows(spark, o / "target_only.csv") == [(5, 50)]


def test_failure_in_one_file_writes_none(spark, tmp_path):
    s, t = tmp_path / "s", tmp_path / "t"
    for name, value in (("a", [1]), ("b", ["text"])):
        put(s / f"{name}.csv", id=[9], value=value)
        put(t / f"{name}.parquet", id=[1], value=[1])
    before = (t / "a.parquet").read_bytes()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        merging.run(spark, s, t, Options(ignore_filetype=True, inplace=True))
    assert (t / "a.parquet").read_bytes() == before and sorted(p.name for p in t.iterdir()) == ["a.parquet", "b.parquet"]


def test_additive(spark, tmp_path):
    source, target = put(tmp_path / "s.csv", id=[2], value=[20], extra=["x"]), put(tmp_path / "t.csv", id=[1], value=[10])
    with pytest.raises(MergeError):
        merging.run(spark, source, target, Options(out=tmp_path / "o.csv"))
    merging.run(spark, source, target, Options(additive=True, out=tmp_path / "o.csv"))
    assert rows(spark, tmp_path / "o.csv") == [(1, 10, None), (2, 20, "x")]


def test_plan_errors(spark, tmp_path):
    a, b = put(tmp_path / "a.csv", id=[1]), put(tmp_path / "d" / "a.csv", id=[1])
    put(tmp_path / "d" / "x" / "a.csv", id=[1])
    with pytest.raises(MergeError, match="Ambiguous"):
        merging.plan(resolve(a), resolve(tmp_path / "d"), Options(inplace=True))
    with pytest.raises(MergeError, match="folder cannot"):
        merging.plan(resolve(tmp_path / "d"), resolve(a), Options(inplace=True))
    compiling.compile_dataset(spark, b, tmp_path / "c")
    with pytest.raises(MergeError, match="Compiled"):
        merging.plan(resolve(a), resolve(tmp_path / "c"), Options(inplace=True))
    for options in (Options(), Options(out=tmp_path, inplace=True), Options(Strategy.UPSERT, out=tmp_path), Options(additive=True, ignore_filetype=True, out=tmp_path)):
        with pytest.raises(MergeError):
            merging.check_options(options)
    with pytest.raises(MergeError, match="already exists"):
        merging.run(spark, a, b, Options(out=a))
    with pytest.raises(MergeError, match="Key columns"):
        merging.run(spark, a, b, Options(keys=("nothing",), out=tmp_path / "o.csv"))


def test_streaming_ingest(spark, tmp_path):
    from pyspark.sql import types as T

    from shardwell.streaming.ingest import current, ingest, watch

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.LongType())])
    inbox = tmp_path / "in"
    target = str(tmp_path / "table")

    def go():
        q = ingest(watch(spark, str(inbox), schema), target, str(tmp_path / "cp"), ["id"], "v").trigger(availableNow=True).start()
        q.awaitTermination(60)

    put(inbox / "1.parquet", id=[1, 1, 2], v=[1, 5, 2])
    go()
    put(inbox / "2.parquet", id=[2, 3], v=[9, 3])
    go()
    assert sorted(map(tuple, spark.read.parquet(current(spark, target)).collect())) == [(1, 5), (2, 9), (3, 3)]
