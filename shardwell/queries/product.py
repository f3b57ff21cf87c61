"""The product's whole operations on files: merging, comparing, analysing, charting, and the command line."""

from __future__ import annotations

import contextlib
import io
import re
from pathlib import Path

from pyspark.sql import functions as F

from .. import cli
from ..plans import analysis, compiling, diffing, merging, plotting
from ..sources.files import read, resolve, write
from .merge import ALL, CTE, KEPT, LAST, _source, _target
from .registry import Registry, local_folder, table

QUERIES = Registry()


@QUERIES.add(f"{CTE} select k, v from t union all select distinct k, v from s where {ALL}")
def merge_run_append(spark, sf_dir):
    """A CSV file appended to a Parquet file, cast to its types."""
    folder = local_folder(spark, "append")
    write(_target(spark, sf_dir), folder / "t.parquet")
    write(_source(spark, sf_dir).drop("seq"), folder / "s.csv")
    [done] = merging.run(spark, folder / "s.csv", folder / "t.parquet", merging.Options(ignore_filetype=True, out=folder / "out" / "o.parquet")).written
    return read(spark, done)


@QUERIES.add(f"{CTE} select k, v from t where {KEPT} union all select k, v from {LAST}")
def merge_run_upsert(spark, sf_dir):
    """A file upserted into another in place; of rows of one key the last in the file counts."""
    folder = local_folder(spark, "upsert")
    write(_target(spark, sf_dir), folder / "t.feather")
    write(_source(spark, sf_dir).orderBy("seq").drop("seq"), folder / "s.feather")
    options = merging.Options(merging.Strategy.UPSERT, ("k",), inplace=True)
    assert merging.run(spark, folder / "s.feather", folder / "t.feather", options, dry=True).issues == []
    [done] = merging.run(spark, folder / "s.feather", folder / "t.feather", options).written
    return read(spark, done)


@QUERIES.add(
    "select 'a.csv' as file, count(*) as rows, sum(n_nationkey) as total, count(*) filter (where n_nationkey >= 15) as with_extra from nation "
    "union all select 'only_source.csv', count(*), sum(r_regionkey), 0 from region union all select 'sub/only_target.parquet', count(*), sum(s_suppkey), 0 from supplier"
)
def merge_run_folder(spark, sf_dir):
    """A folder merged into another with a column more: matched, new and untouched files."""
    folder = local_folder(spark, "folders")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    write(nation.filter("key < 15"), folder / "t" / "a.csv")
    write(nation.filter("key >= 15").withColumn("extra", F.lit("x")), folder / "s" / "a.csv")
    write(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key")), folder / "s" / "only_source.csv")
    write(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), folder / "t" / "sub" / "only_target.parquet")
    done = merging.run(spark, folder / "s", folder / "t", merging.Options(additive=True, out=folder / "o")).written
    out = []
    for path in done:
        df = read(spark, path)
        extra = F.count("extra") if "extra" in df.columns else F.lit(0)
        out.append((path.relative_to(folder.resolve() / "o").as_posix(), *df.agg(F.count("*"), F.sum("key"), extra).first()))
    return spark.createDataFrame(out, "file string, rows bigint, total bigint, with_extra bigint")


def _versions(spark, sf_dir) -> Path:
    """Two folders of order files: one changed, one equal, one gone and one new."""
    folder = local_folder(spark, "versions")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    part = lambda i: orders.filter(F.pmod("o_orderkey", F.lit(5)) == i)
    changed = part(0).filter("o_orderkey % 3 > 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    write(part(0), folder / "l" / "sub" / "changed.parquet")
    write(changed, folder / "r" / "sub" / "changed.parquet")
    for side in "lr":
        write(part(1), folder / side / "same.csv")
    write(part(2), folder / "l" / "gone.csv")
    write(part(3), folder / "r" / "new.csv")
    return folder


@QUERIES.add(
    """select 'file' as kind, * from (values ('sub/changed.parquet', 'modified', 0::bigint), ('same.csv', 'matching', 0), ('gone.csv', 'removed', 0), ('new.csv', 'added', 0)) v(name, what, n)
union all select 'rows', 'all', 'removed', count(*) from orders where o_orderkey % 5 = 0 and o_orderkey % 3 = 0
union all select 'rows', 'all', 'updated', count(*) from orders where o_orderkey % 5 = 0 and o_orderkey % 3 > 0 and o_orderkey % 2 = 0 and o_orderstatus <> 'X'
union all select 'rows', 'all', 'unchanged', count(*) from orders where o_orderkey % 5 = 1 or (o_orderkey % 5 = 0 and o_orderkey % 3 > 0 and not (o_orderkey % 2 = 0 and o_orderstatus <> 'X'))
union all select 'rows', 'all', 'added', 0
union all select 'example', 'sub/changed.parquet', 'removed', o_orderkey from (select o_orderkey from orders where o_orderkey % 15 = 0 order by 1 limit 3)"""
)
def diff_run_folders(spark, sf_dir):
    folder = _versions(spark, sf_dir)
    r = diffing.diff(spark, folder / "l", folder / "r", keys=["o_orderkey"], examples=3)
    out = [("file", name, status, 0) for status, names in r.files.items() for name in names]
    out += [("rows", "all", k, v) for k, v in vars(r.rows).items()]
    out += [("example", e["source"], "removed", e["key"]["o_orderkey"]) for e in r.examples["removed"]]
    return spark.createDataFrame(out, "kind string, name string, what string, n bigint")


@QUERIES.add(
    """select 'files' as pair, 'modified' as verdict, count(*) - count(*) filter (where o_orderkey % 3 > 0) as fewer_rows from orders where o_orderkey % 5 = 0
union all select 'file and folder', 'modified', count(*) - count(*) filter (where o_orderkey % 3 > 0) from orders where o_orderkey % 5 = 0
union all select 'same', 'identical', 0 union all select 'found', 'unmodified', 0 union all select 'lost', 'missing', 0"""
)
def diff_run_files(spark, sf_dir):
    """File with file and file with folder, at several levels."""
    folder = _versions(spark, sf_dir)
    old, new = folder / "l" / "sub" / "changed.parquet", folder / "r" / "sub" / "changed.parquet"
    out = []
    for pair, a, b, level in (("files", old, new, "full"), ("file and folder", old, folder / "r", "statistics"), ("same", old, old, "schema"), ("found", folder / "l" / "same.csv", folder / "r", "metadata"), ("lost", folder / "l" / "gone.csv", folder / "r", "metadata")):
        r = diffing.diff(spark, a, b, diffing.Level(level))
        before, after = r.metadata.get("row_count", (0, 0))
        out.append((pair, next(iter(r.files)), before - after))
    return spark.createDataFrame(out, "pair string, verdict string, fewer_rows bigint")


@QUERIES.add("select 'compiled rows' as what, cast((select count(*) from orders where o_orderkey % 5 = 0 and o_orderkey % 3 = 0) as bigint) as n union all select 'files told apart', 1 union all select 'provenance fields', 2")
def diff_run_compiled(spark, sf_dir):
    folder = _versions(spark, sf_dir)
    for side in "lr":
        compiling.compile_dataset(spark, folder / side / "sub", folder / f"c{side}")
    r = diffing.diff(spark, folder / "cl", folder / "cr")
    before, after = r.metadata["row_count"]
    return spark.createDataFrame([("compiled rows", before - after), ("files told apart", len(r.files["modified"])), ("provenance fields", len([k for k in r.provenance if k in ("source", "rows")]))], "what string, n bigint")


@QUERIES.add(
    "select c as column_name, n, round(lo, 6) as lo, round(hi, 6) as hi, round(mean, 6) as mean, n as in_histogram, true as kept from ("
    + " union all ".join(f"select '{c}' as c, count({c}) as n, cast(min({c}) as double) as lo, cast(max({c}) as double) as hi, avg({c}) as mean from orders" for c in ("o_orderkey", "o_totalprice"))
    + ")"
)
def analyse_run(spark, sf_dir):
    """A deep analysis of a folder of three formats, read again from its cache without Spark."""
    folder = local_folder(spark, "analysis")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    for i, name in enumerate(("a.csv", "b.parquet", "c/d.arrow")):
        write(orders.filter(F.pmod("o_orderkey", F.lit(3)) == i), folder / "data" / name)
    dataset, cache = resolve(folder / "data"), analysis.Cache(folder / "cache")
    found = analysis.analyse(spark, dataset, analysis.Mode.DEEP, cache)
    kept = analysis.analyse(None, dataset, analysis.Mode.DEEP, cache)
    out = [(n, found.row_count, round(float(s.min), 6), round(float(s.max), 6), round(s.mean, 6), sum(k for _, k in s.histogram), kept == found) for n, s in found.statistics.items()]
    return spark.createDataFrame(out, "column_name string, n bigint, lo double, hi double, mean double, in_histogram bigint, kept boolean")


@QUERIES.add("select user_id as x, round(avg(value), 6) as y from events where value > 10 group by 1")
def plot_run_line(spark, sf_dir):
    """A filtered line of means by x, sorted for the line: all its points, however many are drawn."""
    folder = local_folder(spark, "plot")
    write(table(spark, sf_dir, "events").select("user_id", "value"), folder / "events.parquet")
    [plot] = plotting.plot_dataset(spark, resolve(folder), ["user_id", "value"], plotting.Options(kind="line", aggregate_x="mean", filter="value > 10"))
    assert plot.kind == "line" and plot.points == sorted(plot.points)
    # scaled and rounded half away from zero, as the SQL's round does
    return plot.line.select(F.col("x").cast("bigint").alias("x"), (F.round(F.col("y") * 1e6) / 1e6).alias("y"))


@QUERIES.add("select cast(dense_rank() over (order by first) - 1 as double) as x, round(y, 6) as y, event_type as category from (select event_type, min(event_id) as first, sum(value) as y from events group by 1)")
def plot_run_categories(spark, sf_dir):
    """A scatter of sums by a categorical x, in order of first appearance."""
    folder = local_folder(spark, "plot")
    write(table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first"), F.sum("value").alias("value")).orderBy("first"), folder / "types.parquet")
    [plot] = plotting.plot_dataset(spark, resolve(folder / "types.parquet"), ["event_type", "value"], plotting.Options())
    assert plot.kind == "scatter"
    points = sorted([*plot.points, *plot.outliers])
    return spark.createDataFrame([(x, round(y, 6), plot.categories[int(x)]) for x, y in points], "x double, y double, category string")


@QUERIES.add(
    """select 'summary' as command, (select count(*) from nation) + (select count(*) from region) as fact union all select 'schema', 2 union all select 'compile', count(*) from nation
union all select 'scaffold-transform', 2 union all select 'transform', count(*) from nation union all select 'head', 4 union all select 'diff', count(*) from nation where n_regionkey = 1
union all select 'plot', count(*) from nation union all select 'merge', count(*) from nation union all select 'merge --dry', count(*) from nation where n_regionkey = 1 union all select 'error', 1"""
)
def command_line(spark, sf_dir):
    """Each command on small files: a number of what it prints or writes."""
    folder = local_folder(spark, "commands")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    write(nation, folder / "in" / "nation.csv")
    write(region, folder / "in" / "region.csv")
    write(nation.filter("n_regionkey <> 1"), folder / "part.csv")
    write(nation, folder / "nation.csv")

    def say(*args) -> tuple[int, str]:
        out = io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(out):
            code = cli.main([str(a) for a in args], spark)
        return code, out.getvalue()

    number = lambda pattern, text: int(re.search(pattern, text)[1])
    rows = lambda path: read(spark, path).count()
    found = {"summary": number(r"Rows\s+(\d+)", say("summary", folder / "in")[1]), "schema": len(re.findall(r"^Schema \d: 1 file", say("schema", folder / "in")[1], re.MULTILINE))}
    write(nation, folder / "one" / "nation.csv")
    found["compile"] = number(r"unreadable; (\d+) rows", say("compile", folder / "one", "--output", folder / "compiled", "--validate")[1])
    say("scaffold-transform", folder / "in", "--output", folder / "script.py")
    found["scaffold-transform"] = len(re.findall(r"^# \d+\. 1 file", (folder / "script.py").read_text(), re.MULTILINE))
    say("transform", folder / "nation.csv", folder / "script.py", folder / "transformed.csv")
    found["transform"] = rows(folder / "transformed.csv")
    found["head"] = len(say("head", folder / "nation.csv", "--n", "4")[1].strip().splitlines()) - 3
    found["diff"] = number(r"removed\s+(\d+)", say("diff", folder / "nation.csv", folder / "part.csv", "--on", "n_nationkey")[1].partition("Rows\n")[2])
    found["plot"] = sum(map(int, re.findall(r" (\d+)$", say("plot", folder / "nation.csv", "n_regionkey", "--kind", "histogram")[1].partition("Dropped")[2], re.MULTILINE))) - 0
    found["merge --dry"] = number(r"insert_rows (\d+)", say("merge", folder / "nation.csv", folder / "part.csv", "--out", folder / "m.csv", "--dry")[1])
    say("merge", folder / "nation.csv", folder / "part.csv", "--out", folder / "m.csv")
    found["merge"] = rows(folder / "m.csv")
    found["error"] = say("summary", folder / "nothing")[0]
    return spark.createDataFrame(list(found.items()), "command string, fact bigint")
