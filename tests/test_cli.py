import pytest
from helpers import put, rows

from shardwell import cli


@pytest.fixture
def run(spark, capsys, tmp_path, monkeypatch):
    monkeypatch.setenv("SHARDWELL_CACHE", str(tmp_path / "cache"))

    def go(*args):
        code = cli.main([str(a) for a in args], spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    return go


def test_summary_and_schema(run, drift):
    code, out, _ = run("summary", drift, "--profile", "deep")
    assert code == 0 and "Schema Distribution" in out and "Histogram of value" in out and "Schema drift" in out
    code, out, _ = run("schema", drift)
    assert code == 0 and "Files that differ from schema 1\nc.csv" in out


def test_compile_transform_head(run, drift, tmp_path):
    assert run("compile", drift, "--output", tmp_path / "c")[0] == 1
    code, out, _ = run("compile", drift, "--output", tmp_path / "c", "--schema", 1, "--validate")
    assert code == 0 and "2 of 3 files" in out and "Validation passed" in out
    assert run("scaffold-transform", drift, "--output", tmp_path / "t.py")[0] == 0
    assert run("transform", tmp_path / "c", tmp_path / "t.py", tmp_path / "c2", "--workers", 2)[0] == 0
    code, out, _ = run("head", tmp_path / "c2", "--n", 2)
    assert code == 0 and "_source_file" not in out
    assert "_source_file" in run("head", tmp_path / "c2", "--showmeta")[1]


def test_diff(run, tmp_path):
    a, b = put(tmp_path / "a.csv", k=[1, 2], v=["x", "y"]), put(tmp_path / "b.csv", k=[1, 2], v=["x", "z"])
    code, out, _ = run("diff", a, b, "--on", "k")
    assert code == 0 and "~ k=2: v: y -> z" in out
    assert "No differences detected." in run("diff", a, a)[1]
    code, _, err = run("diff", a, b, "--on", "k", "--level", "schema")
    assert code == 1 and "Traceback" not in err and "full" in err


def test_plot(run, tmp_path):
    path = put(tmp_path / "p.csv", x=list(range(30)), y=[float(i % 7) for i in range(30)])
    for kind in ("auto", "line", "scatter", "histogram"):
        code, out, _ = run("plot", path, "x", "y", "--kind", kind)
        assert code == 0 and out
    code, _, err = run("plot", path, "x", "y", "--filter", "x=>1")
    assert code == 1 and "Invalid --filter expression" in err


def test_merge(run, spark, tmp_path):
    s, t = put(tmp_path / "s.csv", id=[1], v=[2]), put(tmp_path / "t.csv", id=[1], v=[1])
    code, out, _ = run("merge", s, t, "--out", tmp_path / "o.csv", "--on", "id", "--dry")
    assert code == 1 and "ISSUE" in out and not (tmp_path / "o.csv").exists()
    assert run("merge", s, t, "--out", tmp_path / "o.csv", "--on", "id", "--strategy", "upsert")[0] == 0
    assert rows(spark, tmp_path / "o.csv") == [(1, 2)]


def test_errors_are_one_line(run, tmp_path):
    code, out, err = run("summary", tmp_path / "nothing")
    assert code == 1 and err.startswith("Source does not exist") and err.count("\n") == 1
