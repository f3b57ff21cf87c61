import datetime as dt
import json

import pytest
from helpers import put, rows

from shardwell.plans import compiling, diffing, merging, plotting, preview, transforming
from shardwell.plans.analysis import Analysis, Cache, Mode, analyse, build, schema_groups, type_changes
from shardwell.plans.diffing import Level
from shardwell.sources import files as files_module
from shardwell.sources.files import SOURCE_FILE, Kind, SourceError, read, resolve, write


def test_resolve(same, tmp_path):
    assert resolve(same).kind is Kind.FOLDER and resolve(same / "a.csv").kind is Kind.FILE
    with pytest.raises(SourceError, match="Source does not exist"):
        resolve(tmp_path / "nothing")
    (tmp_path / "x.txt").write_text("x")
    (tmp_path / "empty").mkdir()
    for bad in ("x.txt", "empty"):
        with pytest.raises(SourceError):
            resolve(tmp_path / bad)


def test_formats_share_a_schema(spark, same, drift):
    a = build(spark, resolve(same), Mode.STANDARD)
    assert [g.count for g in a.schemas] == [2] and a.schema_hash and a.row_count == 4
    assert (a.statistics["id"].mean, a.statistics["ts"].min, a.statistics["ts"].median) == (2.5, "2024-01-01", "2024-01-02T12:00:00")
    b = build(spark, resolve(drift), Mode.QUICK)
    assert [g.count for g in b.schemas] == [2, 1] and b.schema_hash is None and "Schema drift" in b.warnings[0] and b.statistics is None


def test_deep_profile(spark, tmp_path):
    put(tmp_path / "d" / "a.csv", id=[1, 2], amount=[9.5, 10.0], trade_date=[dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    put(tmp_path / "d" / "b.feather", id=[3, 4], amount=[12.0, 15.0], trade_date=["2024-01-03", "2024-01-04"])
    a = build(spark, resolve(tmp_path / "d"), Mode.DEEP)
    assert a.statistics["amount"].mean == 11.625
    assert sum(n for _, n in a.statistics["amount"].histogram) == 4
    assert set(a.column_hashes) == {"id", "amount", "trade_date"}
    assert type_changes(a.schemas) == {"trade_date": ["date", "string"]}


def test_broken_file_is_a_warning(spark, tmp_path):
    put(tmp_path / "d" / "good.parquet", id=[1, 2], value=[1.0, 2.0])
    (tmp_path / "d" / "bad.parquet").write_bytes(b"PAR1 no")
    a = build(spark, resolve(tmp_path / "d"), Mode.STANDARD)
    assert a.row_count == 2 and any("bad.parquet" in w for w in a.warnings)
    (tmp_path / "d" / "good.parquet").unlink()
    with pytest.raises(SourceError, match="failed to inspect any dataset files"):
        build(spark, resolve(tmp_path / "d"), Mode.QUICK)


def test_column_digest_depends_on_order(spark, tmp_path):
    of = lambda *v: build(spark, resolve(put(tmp_path / "x.csv", v=list(v))), Mode.DEEP_NO_HISTOGRAM).column_hashes["v"]
    assert of(1, 2, 3) == of(1, 2, 3) != of(1, 3, 2)


def test_cache(spark, same, tmp_path):
    cache, dataset = Cache(tmp_path / "cache"), resolve(same)
    first = analyse(spark, dataset, Mode.STANDARD, cache)
    assert analyse(None, dataset, Mode.STANDARD, cache) == Analysis.from_dict(json.loads(json.dumps(first.to_dict())))
    kept = next((tmp_path / "cache").glob("*.json"))
    kept.write_text("{broken")
    assert cache.get(dataset, Mode.STANDARD) is None and not kept.exists()
    put(same / "c.csv", id=[9], value=[1.0], ts=[dt.date(2024, 1, 9)])
    assert cache.get(dataset, Mode.STANDARD) is None


@pytest.mark.parametrize("suffix", [".csv", ".parquet", ".feather", ".arrow"])
def test_write_and_read(spark, tmp_path, suffix):
    df = spark.createDataFrame([(2, "b,\"c\"", 1.5, dt.date(2024, 1, 1)), (1, None, None, None)], "id bigint, s string, v double, d date")
    write(df, tmp_path / "deep" / f"x{suffix}")
    assert rows(spark, tmp_path / "deep" / f"x{suffix}") == [tuple(r) for r in df.collect()]
    assert [p.name for p in (tmp_path / "deep").iterdir()] == [f"x{suffix}"]


ODD = [(1, "a\nb", "x"), (2, "", None), (3, None, 'q"u,o\r\nte'), (4, "  lead ", '"'), (5, "null", "\\"), (6, "tail\n", "é")]


def test_csv_keeps_odd_values(spark, tmp_path):
    df = spark.createDataFrame(ODD, "id bigint, t string, u string")
    write(df, tmp_path / "odd.csv")
    found = read(spark, tmp_path / "odd.csv", ordered=True)
    assert found.drop("_order").schema == df.schema and [tuple(r) for r in found.orderBy("_order").drop("_order").collect()] == ODD
    write(read(spark, tmp_path / "odd.csv"), tmp_path / "again.csv")
    assert (tmp_path / "again.csv").read_bytes() == (tmp_path / "odd.csv").read_bytes()
    put(tmp_path / "plain.csv", id=[7], t=["p"], u=["q"])
    records = {f.relative: (f.rows, f.columns) for f in build(spark, resolve(tmp_path), Mode.QUICK).files}
    assert {k: v[0] for k, v in records.items()} == {"odd.csv": 6, "again.csv": 6, "plain.csv": 1} and len({v[1] for v in records.values()}) == 1


def test_hashes_and_counts_of_files(spark, tmp_path):
    import hashlib

    files = [put(tmp_path / n, v=list(range(k))) for n, k in (("a b.csv", 3), ("ä.parquet", 4), ("c.feather", 5), ("d.parquet", 0))]
    found = files_module.content_hashes(spark, files)
    assert found == {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in files} and files_module.content_hashes(spark, []) == {}
    assert {f.relative: f.rows for f in build(spark, resolve(tmp_path), Mode.QUICK).files} == {"a b.csv": 3, "ä.parquet": 4, "c.feather": 5, "d.parquet": 0}


def test_head_reads_no_more_than_it_needs(spark, tmp_path):
    for i in range(3):
        put(tmp_path / "h" / f"{i}.parquet", v=[i * 10 + k for k in range(4)])
    assert [r["v"] for r in preview.first_rows(spark, resolve(tmp_path / "h").files(), 6)] == [0, 1, 2, 3, 10, 11]
    (tmp_path / "h" / "1.parquet").write_bytes(b"broken")
    assert [r["v"] for r in preview.first_rows(spark, resolve(tmp_path / "h").files(), 3)] == [0, 1, 2]


def test_parts_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files_module, "PART_BYTES", 80_000)
    files_module.write_parts(spark.range(5000).coalesce(1), tmp_path / "parts", 40.0)
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == ["part-000.parquet", "part-001.parquet", "part-002.parquet"]


@pytest.fixture
def store(spark, tmp_path):
    """A folder by a URI that only Hadoop's file systems know."""
    (tmp_path / "store").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.shop{tmp_path.name}.link./data", f"file://{tmp_path / 'store'}")
    return f"viewfs://shop{tmp_path.name}/data", tmp_path / "store"


def test_paths_in_a_store(spark, store, tmp_path):
    uri, local = store
    put(local / "in" / "a.csv", id=[1, 2], value=[1.5, 2.5])
    put(local / "in" / "sub" / "b.parquet", id=[3], value=[3.5])
    dataset = resolve(f"{uri}/in/")
    assert dataset.kind is Kind.FOLDER and [dataset.relative(p) for p in dataset.files()] == ["a.csv", "sub/b.parquet"]
    a = build(spark, dataset, Mode.STANDARD)
    assert {f.relative: f.rows for f in a.files} == {"a.csv": 2, "sub/b.parquet": 1} and a.statistics["id"].mean == 2.0 and len(a.schemas) == 1
    done = compiling.compile_dataset(spark, f"{uri}/in", f"{uri}/out")
    assert done.analysis.row_count == 3 and resolve(f"{uri}/out").kind is Kind.COMPILED and (local / "out" / "data" / "part-000.parquet").exists()
    assert compiling.validate(spark, f"{uri}/out", f"{uri}/in").ok
    assert [r["id"] for r in preview.head_dataset(spark, resolve(f"{uri}/out"), 9)[0][1]] == [1, 2, 3]
    script = tmp_path / "t.py"
    script.write_text("def transform(df, context):\n    return df.filter('id <> 2')\n")
    transforming.transform(spark, f"{uri}/in", script, f"{uri}/changed")
    r = diffing.diff(spark, f"{uri}/in", f"{uri}/changed", keys=["id"])
    assert r.files["modified"] == ["a.csv", "sub/b.parquet"] and r.rows.removed == 1 and r.examples["removed"] == [{"key": {"id": 2}, "source": "a.csv"}]
    assert diffing.diff(spark, f"{uri}/in/a.csv", f"{uri}/in").files == {"unmodified": ["a.csv"]}
    with pytest.raises(SourceError, match="Source does not exist"):
        resolve(f"{uri}/nothing")
    with pytest.raises(SourceError, match="mounted"):
        write(spark.range(1), f"{uri}/x.feather")
    with pytest.raises(compiling.CompileError, match="already exists"):
        compiling.compile_dataset(spark, f"{uri}/in", f"{uri}/out")
    write(spark.createDataFrame([], "id bigint, value double"), f"{uri}/none.csv")
    assert (local / "none.csv").read_text() == "id,value\n"


def test_merging_in_a_store(spark, store):
    uri, local = store
    put(local / "s" / "a.csv", id=[2, 3], v=[20, 30])
    put(local / "s" / "new.csv", id=[9], v=[90])
    put(local / "t" / "a.csv", id=[1, 2], v=[10, 0])
    put(local / "t" / "keep.csv", id=[5], v=[50])
    options = merging.Options(merging.Strategy.UPSERT, ("id",), out=f"{uri}/o")
    merging.run(spark, f"{uri}/s", f"{uri}/t", options)
    assert rows(spark, local / "o" / "a.csv") == [(1, 10), (2, 20), (3, 30)]
    assert sorted(p.name for p in (local / "o").iterdir() if not p.name.startswith(".")) == ["a.csv", "keep.csv", "new.csv"]
    merging.run(spark, f"{uri}/s/a.csv", f"{uri}/t/a.csv", merging.Options(inplace=True))
    assert rows(spark, local / "t" / "a.csv") == [(1, 10), (2, 0), (2, 20), (3, 30)]


def test_compile(spark, drift, tmp_path):
    with pytest.raises(compiling.CompileError):
        compiling.compile_dataset(spark, drift, tmp_path / "out")
    done = compiling.compile_dataset(spark, drift, tmp_path / "out", schema=1)
    assert (done.coverage.total, done.coverage.compiled, done.coverage.other_schema, done.analysis.row_count) == (3, 2, 1, 4)
    dataset = resolve(tmp_path / "out")
    assert dataset.kind is Kind.COMPILED and [p.name for p in dataset.files()][0] == "part-000.parquet"
    assert {r[SOURCE_FILE] for r in spark.read.parquet(*map(str, dataset.files())).collect()} == {"a.csv", "b.feather"}
    found = compiling.validate(spark, tmp_path / "out", drift)
    assert found.ok and "c.csv" in found.warnings[0]
    put(drift / "a.csv", id=[1], value=[1.5])
    put(drift / "new.csv", id=[1], value=[1.5])
    errors = "\n".join(compiling.validate(spark, tmp_path / "out", drift).errors)
    assert "Row counts differ: a.csv (2 of 1)" in errors and "Files missing from the data: new.csv" in errors
    with pytest.raises(compiling.CompileError, match="already exists"):
        compiling.compile_dataset(spark, drift, tmp_path / "out", schema=1)
    assert analyse(spark, dataset, Mode.DEEP).statistics["id"].histogram == []  # what was stored


def test_head(spark, same):
    assert [tuple(r)[0] for r in preview.head_dataset(spark, resolve(same / "b.feather"), 1)[0][1]] == [3]
    assert [(n, [r["id"] for r in found]) for n, found in preview.head_dataset(spark, resolve(same), 5)] == [("a.csv", [1]), ("b.feather", [3])]
    with pytest.raises(SourceError):
        preview.head_dataset(spark, resolve(same), -1)


def test_file_diff(spark, tmp_path):
    left = put(tmp_path / "l.csv", customer_id=[1, 2], status=["a", "b"], balance=[1.0, 2.0])
    right = put(tmp_path / "r.csv", customer_id=[1, 2, 3], status=["a", "c", "d"], balance=[1.0, 2.0, 3.0])
    r = diffing.diff(spark, left, right, keys=["customer_id"])
    assert (r.rows.added, r.rows.removed, r.rows.updated, r.rows.unchanged) == (1, 0, 1, 1)
    assert r.metadata["row_count"] == (2, 3) and r.statistics["balance"]["mean"] == (1.5, 2.0)
    assert r.examples["updated"] == [{"key": {"customer_id": 2}, "deltas": [{"column": "status", "left": "b", "right": "c"}]}]
    assert diffing.diff(spark, left, left).summary == "No differences detected."


def test_folder_diff(spark, tmp_path):
    for side, extra in (("l", "a"), ("r", "z")):
        put(tmp_path / side / "a.csv", customer_id=[1, 2], status=["x", extra])
        put(tmp_path / side / "sub" / "b.csv", customer_id=[1], status=["same"])
        put(tmp_path / side / f"{extra}_only.csv", customer_id=[1], status=["s"])
    r = diffing.diff(spark, tmp_path / "l", tmp_path / "r", keys=["customer_id"])
    assert r.files == {"added": ["z_only.csv"], "removed": ["a_only.csv"], "modified": ["a.csv"], "matching": ["sub/b.csv"]}
    assert (r.rows.updated, r.rows.unchanged) == (1, 2) and r.examples["updated"][0]["source"] == "a.csv"
    assert diffing.diff(spark, tmp_path / "l", tmp_path / "r", Level.METADATA).statistics == {}


def test_file_and_folder_diff(spark, same, tmp_path):
    own = put(tmp_path / "a.csv", id=[1, 2], value=[1.5, 2.5], ts=[dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    assert diffing.diff(spark, own, same).files == {"unmodified": ["a.csv"]}
    put(own, id=[1], value=[9.0], ts=[dt.date(2024, 1, 1)])
    r = diffing.diff(spark, same, own)
    assert r.files == {"modified": ["a.csv"]} and r.metadata["row_count"] == (2, 1)
    assert diffing.diff(spark, put(tmp_path / "q.csv", id=[1]), same).files == {"missing": ["q.csv"]}
    put(same / "x" / "a.csv", id=[5])
    assert diffing.diff(spark, own, same).files == {"ambiguous": ["a.csv"]}


def test_compiled_diff(spark, same, tmp_path):
    for name in ("one", "two"):
        compiling.compile_dataset(spark, same, tmp_path / name)
    with pytest.raises(diffing.DiffError):
        diffing.diff(spark, tmp_path / "one", tmp_path / "two", keys=["id"])
    assert not diffing.diff(spark, tmp_path / "one", tmp_path / "two").statistics
    with pytest.raises(diffing.DiffError):
        diffing.diff(spark, tmp_path / "one", same)


def test_transform(spark, same, tmp_path):
    script = tmp_path / "t.py"
    script.write_text("from pyspark.sql import functions as F\ndef transform(df, context):\n    return df.filter('value > 2').withColumn('n', F.lit(context.metadata.row_count))\n")
    done = transforming.transform(spark, same, script, workers=2)
    assert done.path.name == "same_transformed"
    assert rows(spark, done.path / "a.csv") == [(2, 2.5, dt.date(2024, 1, 2), 2)] and len(rows(spark, done.path / "b.feather")) == 2
    script.write_text("def transform(df):\n    return 7\n")
    with pytest.raises(TypeError):
        transforming.transform(spark, same, script, tmp_path / "bad")
    assert not (tmp_path / "bad").exists()
    for text in ("x = 1\n", "def transform():\n    pass\n", "def transform(a, b, c):\n    pass\n"):
        script.write_text(text)
        with pytest.raises(transforming.TransformError):
            transforming.load(script)


def test_transform_of_compiled_data(spark, same, tmp_path):
    compiling.compile_dataset(spark, same, tmp_path / "c")
    script = transforming.scaffold(spark, same, tmp_path / "scaffold.py")
    assert "#      value: double" in script.read_text()
    done = transforming.transform(spark, tmp_path / "c", script, tmp_path / "c2")
    a = analyse(spark, resolve(done.path))
    assert a.row_count == 4 and a.statistics["id"].histogram


def test_plots(spark, tmp_path):
    path = put(tmp_path / "p" / "a.csv", x=[1, 2, 3, 3], y=[1.0, 2.0, None, 4.0], name=["u", "v", "w", "u"])
    put(tmp_path / "p" / "b.csv", other=[1.0])
    only = resolve(path)
    one = plotting.plot_dataset(spark, only, ["x", "y"], plotting.Options())[0]
    assert (one.kind, one.dropped, one.duplicates, one.points) == ("line", 1, 0, [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)])
    two = plotting.plot_dataset(spark, only, ["name", "y"], plotting.Options())[0]
    assert (two.kind, two.categories) == ("scatter", ["u", "v"])
    three = plotting.plot_dataset(spark, only, ["name", "y"], plotting.Options(aggregate_x="sum", kind="scatter"))[0]
    assert sorted(three.points) == [(0.0, 5.0), (1.0, 2.0)]
    h = plotting.plot_dataset(spark, resolve(tmp_path / "p"), ["y"], plotting.Options(kind="histogram"))[0]
    assert sum(n for _, n in h.bins) == 3 and "b.csv" in h.warnings[0]
    f = plotting.plot_dataset(spark, only, ["x", "y"], plotting.Options(filter="x<3"))[0]
    assert len(f.points) == 2
    with pytest.raises(plotting.PlotError, match="No plottable numeric values remain"):
        plotting.plot_dataset(spark, only, ["x", "name"], plotting.Options())
    for columns, options in ((["x"], plotting.Options()), (["x", "y"], plotting.Options(kind="histogram", aggregate_x="sum")), (["name", "y"], plotting.Options(kind="line")), (["x", "nothing"], plotting.Options())):
        with pytest.raises(plotting.PlotError):
            plotting.plot_dataset(spark, only, columns, options)


def test_a_line_keeps_all_points(spark, tmp_path, monkeypatch):
    n = 500
    path = put(tmp_path / "l.parquet", x=[i * 7 % n for i in range(n)] * 2, y=[float(i % 11) for i in range(n)] * 2)
    whole = {how: plotting.plot_dataset(spark, resolve(path), ["x", "y"], plotting.Options(kind="line", aggregate_x=how))[0] for how in (None, "mean", "median")}
    monkeypatch.setattr(plotting, "MOST_POINTS", 100)
    for how, before in whole.items():
        [plot] = plotting.plot_dataset(spark, resolve(path), ["x", "y"], plotting.Options(kind="line", aggregate_x=how))
        assert len(plot.points) < 100 and any("resampled" in w for w in plot.warnings)
        assert [tuple(r) for r in plot.line.collect()] == before.points and len(before.points) == (n if how else 2 * n)
        assert "InMemoryTableScan" not in plot.line._jdf.queryExecution().toString()


def test_temporal_histogram(spark, tmp_path):
    path = put(tmp_path / "t.parquet", at=[dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)])
    found = plotting.plot_dataset(spark, resolve(path), ["at"], plotting.Options(kind="histogram"))[0]
    assert found.bins[0][0].startswith("2024-01-01..") and sum(n for _, n in found.bins) == 4


def test_schema_group_order(spark, drift):
    assert [g.count for g in schema_groups(build(spark, resolve(drift), Mode.QUICK).files)] == [2, 1]


def test_arrow_source_reads_batches_and_types(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import ipc

    found = pa.table({"c": pa.array(["a", "b", "a"]).dictionary_encode(), "u": pa.array([1, 2, 2**40], pa.uint64()), "t": pa.array([1, 2, 3], pa.timestamp("ns")), "l": [[1], [], None]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, ipc.new_file(f, found.schema) as w:
        for i in range(3):
            w.write_table(found.slice(i, 1))
    df = read(spark, tmp_path / "x.arrow", ordered=True)
    assert df.rdd.getNumPartitions() == 3
    assert [r["c"] for r in df.orderBy("_order").collect()] == ["a", "b", "a"] and dict(df.dtypes)["u"] == "decimal(20,0)"
