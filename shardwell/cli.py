"""The command line: summary, schema, compile, transform, scaffold-transform, diff, head, plot and merge.

A failure is one line on standard error and exit code 1.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from .plans import compiling, diffing, merging, plotting, preview, transforming
from .plans.analysis import Cache, Mode, analyse, build
from .render import text, views
from .session import session
from .sources.files import resolve
from .sources.paths import place

VERSION = "0.1.0"


def cache_folder() -> Path:
    return Path(os.environ.get("SHARDWELL_CACHE", Path.home() / ".cache" / "shardwell"))


def _positive(value: str) -> int:
    if int(value) < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return int(value)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shardwell", description="Inspect and maintain collections of tabular files.")
    top.add_argument("--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about, description=about)
        for path in paths:
            p.add_argument(path)
        return p

    p = command("summary", "Profile a file, folder or compiled dataset", "source")
    p.add_argument("--profile", choices=["quick", "standard", "deep"], default="standard")
    command("schema", "Show schema groups and drift", "source")
    p = command("compile", "Write the files of one schema as a Parquet dataset", "source")
    p.add_argument("--output", required=True)
    p.add_argument("--schema", type=int)
    p.add_argument("--interactive", action="store_true", help="ask for the schema if there are several")
    p.add_argument("--validate", action="store_true", help="hold the result against the source")
    p = command("transform", "Apply a Python transform to every file", "source", "script")
    p.add_argument("output", nargs="?")
    p.add_argument("--workers", type=_positive, default=1)
    p = command("scaffold-transform", "Write a transform to start from", "source")
    p.add_argument("--output", default="transform_template.py")
    p = command("diff", "Compare two datasets", "left", "right")
    p.add_argument("--level", choices=[x.value for x in diffing.Level], default="full")
    p.add_argument("--on", action="append", default=[], help="key column for row comparison; may repeat")
    p.add_argument("--row-examples", type=_positive, default=5)
    p = command("head", "Show the first rows", "source")
    p.add_argument("--n", "-n", type=int, default=5)
    p.add_argument("--showmeta", action="store_true")
    p = command("plot", "Draw a line, scatter or histogram chart", "source")
    p.add_argument("columns", nargs="+")
    p.add_argument("--kind", choices=["auto", "line", "scatter", "histogram"], default="auto")
    p.add_argument("--aggregate-x", choices=["mean", "median", "min", "max", "sum", "count"])
    p.add_argument("--interpolation", choices=["linear", "nearest"], default="linear")
    p.add_argument("--fail-on-x-duplicates", action="store_true")
    p.add_argument("--fail-on-x-unsorted", action="store_true")
    p.add_argument("--n", "-n", type=_positive)
    p.add_argument("--filter")
    p = command("merge", "Merge a file or folder into another", "source", "target")
    p.add_argument("--out")
    p.add_argument("--inplace", action="store_true")
    p.add_argument("--on", action="append", default=[])
    p.add_argument("--strategy", choices=["append", "upsert"], default="append")
    p.add_argument("--schema-evolution", choices=["strict", "allow-additive"], default="strict")
    p.add_argument("--ignore-filetype", action="store_true")
    p.add_argument("--dry", action="store_true", help="show the plan and write nothing")
    return top


def run(a: argparse.Namespace, spark, say=text.put) -> int:
    """Run a parsed command; the exit code."""
    s, cache = text.style(), Cache(cache_folder())
    match a.command:
        case "summary":
            say(views.summary(analyse(spark, resolve(a.source), Mode(a.profile), cache), s))
        case "schema":
            say(views.schema(analyse(spark, resolve(a.source), Mode.QUICK, cache), s))
        case "compile":
            return _compile(a, spark, say, s)
        case "transform":
            say(f"Transformed files written to {transforming.transform(spark, a.source, a.script, a.output, a.workers).path}")
        case "scaffold-transform":
            say(f"Transform scaffold written to {transforming.scaffold(spark, a.source, a.output)}")
        case "diff":
            say(views.diff(diffing.diff(spark, a.left, a.right, diffing.Level(a.level), a.on, a.row_examples, cache)))
        case "head":
            say(views.head(preview.head_dataset(spark, resolve(a.source), a.n), a.showmeta))
        case "plot":
            options = plotting.Options(None if a.kind == "auto" else a.kind, a.aggregate_x, a.fail_on_x_duplicates, a.fail_on_x_unsorted, a.filter, text.chart_width(), a.interpolation)
            say(views.plots(plotting.plot_dataset(spark, resolve(a.source), a.columns, options, a.n), method=a.interpolation, s=s))
        case "merge":
            options = merging.Options(merging.Strategy(a.strategy), tuple(a.on), a.schema_evolution == "allow-additive", a.ignore_filetype, place(a.out) if a.out else None, a.inplace)
            done = merging.run(spark, a.source, a.target, options, a.dry)
            say("\n".join(done.lines))
            if done.written:
                say("\n".join(f"Written {p}" for p in done.written))
            return int(bool(done.issues))
    return 0


def _compile(a: argparse.Namespace, spark, say, s: text.Style) -> int:
    number = a.schema
    if a.interactive and number is None:
        analysis = build(spark, resolve(a.source), Mode.QUICK)
        if len(analysis.schemas) > 1:
            say(views.schema(analysis, s))
            number = int(input(f"Schema 1..{len(analysis.schemas)}: "))
    done = compiling.compile_dataset(spark, a.source, a.output, number)
    c = done.coverage
    say(f"Compiled dataset written to {done.path}\n{c.compiled} of {c.total} files, {c.other_schema} of another schema, {c.unreadable} unreadable; {done.analysis.row_count} rows")
    if not a.validate:
        return 0
    found = compiling.validate(spark, done.path, a.source)
    for line in (*found.warnings, *found.errors):
        say(line)
    say("Validation passed" if found.ok else "Validation failed")
    return int(not found.ok)


def main(arguments: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(arguments)
    try:
        return run(a, spark or session())
    except Exception as e:  # the contract of the command line: a message, not a trace
        text.put(str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__, sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
