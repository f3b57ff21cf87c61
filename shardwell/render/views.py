"""What each command shows."""

from __future__ import annotations

from pyspark.sql import Row

from ..plans.analysis import Analysis, type_changes
from ..plans.diffing import Level, Report
from ..plans.plotting import Plot
from ..sources.files import SOURCE_FILE
from . import text as T

MOST_HISTOGRAMS, MOST_FILES = 10, 20
TEMPORAL = ("date", "timestamp", "timestamp_ntz", "time", "interval")


def _joined(parts: list[str]) -> str:
    return "\n\n".join(p for p in parts if p)


def _warnings(found: list[str]) -> str:
    return "Warnings\n" + "\n".join(f"- {w}" for w in found) if found else ""


def _number(value: float | None) -> str:
    return "" if value is None else f"{value:.3f}"


def _groups(a: Analysis, s: T.Style) -> list[str]:
    rows = [(f"Schema {i}", g.count, ", ".join(n for n, _ in g.columns)) for i, g in enumerate(a.schemas, 1)]
    return [T.grid("Schema Overview", ("Schema", "Files", "Columns"), rows, (1,)), "Schema Distribution\n" + T.bars([(r[0], r[1]) for r in rows], s=s)]


def summary(a: Analysis, s: T.Style = T.UNICODE) -> str:
    parts = [T.grid("Metadata", ("Field", "Value"), [("Files", a.source_file_count), ("Rows", a.row_count), ("Columns", a.column_count), ("Schemas", len(a.schemas)), ("Created", a.created_at)]), *_groups(a, s)]
    if a.statistics:
        deep = any(c.unique_estimate is not None for c in a.statistics.values())
        rows = []
        for name, c in a.statistics.items():
            rows.append([name, c.dtype, f"{c.null_rate * 100:.1f}", c.min, c.max, _number(c.mean), c.median, _number(c.stddev)] + [c.unique_estimate] * deep)
        parts.append(T.grid("Statistics", ["Column", "Type", "Null %", "Min", "Max", "Mean", "Median", "Std"] + ["Unique"] * deep, rows, (2, 5, 6, 7, 8)))
        if dates := [(n, c.min, c.max) for n, c in a.statistics.items() if c.dtype.startswith(TEMPORAL) and c.min is not None]:
            parts.append(T.grid("Date Ranges", ("Column", "Min", "Max"), dates))
        drawn = [(n, c.histogram) for n, c in a.statistics.items() if c.histogram][:MOST_HISTOGRAMS]
        parts += [f"Histogram of {n}\n" + T.bars(h, s=s) for n, h in drawn]
    return _joined([*parts, _warnings(a.warnings)])


def schema(a: Analysis, s: T.Style = T.UNICODE) -> str:
    parts = _groups(a, s)
    parts += [T.grid(f"Schema {i}: {g.count} file(s)", ("Column", "Type"), g.columns) for i, g in enumerate(a.schemas, 1)]
    if changes := type_changes(a.schemas):
        parts.append(T.grid("Type Changes", ("Column", "Types"), [(n, ", ".join(k)) for n, k in changes.items()]))
    if len(a.schemas) > 1:
        odd = [f.relative for f in a.files if f.error is None and f.columns != a.schemas[0].columns]
        rest = f"\nand {len(odd) - MOST_FILES} more" if len(odd) > MOST_FILES else ""
        parts.append("Files that differ from schema 1\n" + "\n".join(odd[:MOST_FILES]) + rest)
    return _joined([*parts, _warnings(a.warnings)])


def _key(key: dict) -> str:
    return ", ".join(f"{k}={v}" for k, v in key.items())


def diff(r: Report) -> str:
    full, schemas = r.level in (Level.FULL, Level.STATISTICS), r.level != Level.METADATA
    parts = []
    if shown := [(k, len(v), ", ".join(v[:5])) for k, v in r.files.items() if v and k != "matching"]:
        parts.append(T.grid("Files", ("Change", "Count", "Files"), shown, (1,)))
    if r.metadata:
        parts.append(T.grid("Metadata", ("Field", "Left", "Right"), [(k, *v) for k, v in r.metadata.items()]))
    if schemas and any(r.schemas.values()):
        rows = [("added", ", ".join(f"{n}: {t}" for n, t in c)) for c in r.schemas["added"]]
        rows += [("removed", ", ".join(f"{n}: {t}" for n, t in c)) for c in r.schemas["removed"]]
        rows += [("types", f"{n}: {'/'.join(a) or 'absent'} -> {'/'.join(b) or 'absent'}") for n, a, b in r.schemas["type_changes"]]
        parts.append(T.grid("Schemas", ("Change", "What"), rows))
    if full and r.statistics:
        parts.append(T.grid("Statistics", ("Column", "Statistic", "Left", "Right"), [(c, n, *v) for c, found in r.statistics.items() for n, v in found.items()]))
    if r.level == Level.FULL and r.column_hashes:
        parts.append(T.grid("Column contents", ("Column", "Change"), [(c, "added" if a is None else "removed" if b is None else "changed") for c, (a, b) in r.column_hashes.items()]))
    if r.provenance:
        parts.append(T.grid("Provenance", ("Field",), [(k,) for k in r.provenance]))
    if r.rows:
        parts.append(T.grid("Rows", ("Change", "Count"), [(k, v) for k, v in vars(r.rows).items()], (1,)))
        lines = [f"+ {_key(e['key'])}" for e in r.examples["added"]] + [f"- {_key(e['key'])}" for e in r.examples["removed"]]
        for e in r.examples["updated"]:
            lines.append(f"~ {_key(e['key'])}: " + "; ".join(f"{d['column']}: {d['left']} -> {d['right']}" for d in e["deltas"]))
        if lines:
            parts.append("Examples\n" + "\n".join(lines))
    return _joined([*parts, _warnings(r.warnings), "" if r.differs() else "No differences detected."])


def head(found: list[tuple[str, list[Row]]], show_meta: bool = False) -> str:
    parts = []
    for name, rows in found:
        if not rows:
            parts.append(f"{name}\n(no rows)")
            continue
        columns = [c for c in rows[0].__fields__ if show_meta or c != SOURCE_FILE]
        parts.append(T.grid(name, columns, [[r[c] for c in columns] for r in rows]))
    return _joined(parts)


def plots(found: list[Plot], width: int | None = None, method: str = "linear", s: T.Style = T.UNICODE) -> str:
    room = T.chart_width(width)
    parts = []
    for p in found:
        tick = T.time_tick if p.x_kind == "temporal" else T.number_tick
        if p.kind == "histogram":
            chart = T.bars(p.bins, width=40, room=room, s=s)
        elif p.kind == "line":
            chart = T.line(p.points, room, method=method, x_tick=tick, s=s)
        else:
            chart = T.scatter(p.points, p.outliers, room, x_tick=tick, s=s)
        facts = [("Source", p.source), ("Kind", p.kind), ("Rows", p.rows), ("Dropped", p.dropped)]
        if p.kind != "histogram":
            facts += [("Repeated x", p.duplicates), ("x", f"{p.x} ({p.x_kind})")]
        if p.outliers:
            facts.append(("Outliers", len(p.outliers)))
        title = f"Histogram of {p.x}" if p.kind == "histogram" else f"{p.y} by {p.x}"
        legend = "\n".join(f"{i} = {c}" for i, c in enumerate(p.categories[:20]))
        parts += [T.grid(title, ("Field", "Value"), facts), chart, legend, _warnings(p.warnings)]
    return _joined(parts)
