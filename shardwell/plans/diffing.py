"""Comparing two datasets: files, metadata, schemas, statistics and keyed rows."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from enum import StrEnum
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.rowdiff import DiffError, RowDiff, compare, compare_files
from ..sources.files import SOURCE_FILE, Dataset, Kind, content_hashes, metadata, read, read_all, resolve
from ..sources.paths import AnyPath
from .analysis import Analysis, Cache, Mode, analyse

COMPARED = ("null_rate", "unique_estimate", "min", "max", "mean", "median", "stddev")


class Level(StrEnum):
    METADATA = "metadata"
    SCHEMA = "schema"
    STATISTICS = "statistics"
    FULL = "full"


@dataclass
class RowSummary:
    added: int = 0
    removed: int = 0
    updated: int = 0
    unchanged: int = 0

    def __add__(self, other: RowSummary) -> RowSummary:
        return RowSummary(self.added + other.added, self.removed + other.removed, self.updated + other.updated, self.unchanged + other.unchanged)


@dataclass
class Report:
    level: str
    files: dict[str, list[str]] = field(default_factory=dict)  # added, removed, modified, matching, or one verdict
    metadata: dict[str, tuple] = field(default_factory=dict)
    column_hashes: dict[str, tuple] = field(default_factory=dict)
    schemas: dict[str, list] = field(default_factory=dict)  # added, removed, type_changes
    statistics: dict[str, dict[str, tuple]] = field(default_factory=dict)
    provenance: dict[str, tuple] = field(default_factory=dict)
    rows: RowSummary | None = None
    examples: dict[str, list] = field(default_factory=lambda: {"added": [], "removed": [], "updated": []})
    warnings: list[str] = field(default_factory=list)
    summary: str = ""

    def differs(self) -> bool:
        files = any(v for k, v in self.files.items() if k not in ("matching", "identical", "unmodified"))
        rows = self.rows is not None and bool(self.rows.added or self.rows.removed or self.rows.updated)
        return files or rows or any((self.metadata, self.column_hashes, any(self.schemas.values()), self.statistics, self.provenance))

    def to_dict(self) -> dict:
        return asdict(self)


def unlike(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return not math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a != b


def compare_analyses(left: Analysis, right: Analysis, report: Report) -> Report:
    """Differences of two analyses, put into the report."""
    for name in ("row_count", "column_count", "source_file_count", "schema_hash"):
        if getattr(left, name) != getattr(right, name):
            report.metadata[name] = (getattr(left, name), getattr(right, name))
    for name in sorted(left.column_hashes.keys() | right.column_hashes.keys()):
        pair = left.column_hashes.get(name), right.column_hashes.get(name)
        if pair[0] != pair[1]:
            report.column_hashes[name] = pair
    a, b = ({g.hash: g for g in x.schemas} for x in (left, right))
    kinds = [{n: {k for g in x.schemas for m, k in g.columns if m == n} for g in x.schemas for n, _ in g.columns} for x in (left, right)]
    report.schemas = {
        "added": [b[h].columns for h in b if h not in a],
        "removed": [a[h].columns for h in a if h not in b],
        "type_changes": [(n, sorted(kinds[0].get(n, ())), sorted(kinds[1].get(n, ()))) for n in sorted(kinds[0].keys() | kinds[1].keys()) if kinds[0].get(n) != kinds[1].get(n)],
    }
    one, two = left.statistics or {}, right.statistics or {}
    for name in sorted(one.keys() & two.keys()):
        pairs = {s: (getattr(one[name], s), getattr(two[name], s)) for s in COMPARED}
        if found := {s: p for s, p in pairs.items() if unlike(*p)}:
            report.statistics[name] = found
    report.warnings = sorted({*left.warnings, *right.warnings})
    return report


def inventory_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, status) from two (file, hash) frames: added, removed, modified or matching."""
    both = left.select("file", F.col("hash").alias("l")).join(right.select("file", F.col("hash").alias("r")), "file", "full_outer")
    status = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.col("l") == F.col("r"), "matching").otherwise("modified")
    return both.select("file", status.alias("status"))


def folder_inventory(spark: SparkSession, left: Dataset, right: Dataset) -> dict[str, list[str]]:
    """Files by relative path: see inventory_diff(). Files are told apart by size; only those of equal size that are not
    the same file on disk are hashed."""
    a, b = ({d.relative(p): p for p in d.files()} for d in (left, right))
    same_size = [n for n in a.keys() & b.keys() if a[n].stat().st_size == b[n].stat().st_size]
    one_file = {n for n in same_size if a[n].samefile(b[n])}
    hashes = content_hashes(spark, [p for n in same_size if n not in one_file for p in (a[n], b[n])])
    mark = lambda n, p: "one file" if n in one_file else hashes.get(str(p), f"{p.stat().st_size} bytes")
    frame = lambda files: spark.createDataFrame([(n, mark(n, p)) for n, p in files.items()], "file string, hash string")
    out: dict[str, list[str]] = {k: [] for k in ("added", "removed", "modified", "matching")}
    for r in inventory_diff(frame(a), frame(b)).collect():
        out[r["status"]].append(r["file"])
    return {k: sorted(v) for k, v in out.items()}


def _rows(report: Report, diff: RowDiff, keys: list[str], n: int) -> None:
    """Counts, and up to n examples of each kind in all. The join runs once: what changed is kept meanwhile."""
    counts = RowSummary(**diff.summary().first().asDict())
    report.rows = counts if report.rows is None else report.rows + counts
    room = {k: n - len(v) for k, v in report.examples.items()}
    if max(room.values()) <= 0 or not (counts.added or counts.removed or counts.updated):
        return
    changes = diff.changes()
    changes.joined.persist(StorageLevel.DISK_ONLY)
    for kind, rows in changes.examples(max(room.values())).items():
        for r in rows[: room[kind]]:
            example = {"key": {k: r[k] for k in keys}} | ({"source": r[SOURCE_FILE]} if SOURCE_FILE in diff.keys else {})
            report.examples[kind].append(example | ({"deltas": [d.asDict() for d in r["deltas"]]} if kind == "updated" else {}))
    changes.joined.unpersist()


def _folder_rows(spark: SparkSession, report: Report, left: Dataset, right: Dataset, analyses: tuple[Analysis, Analysis], keys: list[str], n: int) -> None:
    """Compare the rows of the files that both folders have: one join for all files that share their schemas."""
    columns = [{f.relative: f.columns for f in a.files if f.error is None} for a in analyses]
    groups: dict[tuple, list[str]] = {}
    for name in sorted({*report.files["matching"], *report.files["modified"]}):
        if name in columns[0] and name in columns[1]:
            groups.setdefault((columns[0][name], columns[1][name]), []).append(name)
    for names in groups.values():
        tagged = lambda d, names=names: read_all(spark, d, [d.path / name for name in names], tagged=True)
        _rows(report, compare_files(tagged(left), tagged(right), SOURCE_FILE, keys), keys, n)


@dataclass
class Match:
    status: str  # missing, ambiguous, unmodified, modified
    path: AnyPath | None = None


def match_in_folder(spark: SparkSession, file: AnyPath, folder: Dataset) -> Match:
    """The folder's file of the same base name; of several, the one with the same content if it is the only one."""
    same = [p for p in folder.files() if p.name == file.name]
    if not same:
        return Match("missing")
    hashes = content_hashes(spark, [file, *same])
    equal = [p for p in same if hashes[str(p)] == hashes[str(file)]]
    if len(same) > 1 and len(equal) != 1:
        return Match("ambiguous")
    return Match("unmodified", equal[0]) if equal else Match("modified", same[0])


def diff(spark: SparkSession, left: str | Path, right: str | Path, level: Level = Level.FULL, keys: list[str] | None = None, examples: int = 5, cache: Cache | None = None) -> Report:
    """Compare file with file, file with folder (either way round), folder with folder, or compiled with
    compiled. Keys ask for row comparison, which needs level full and is not for compiled datasets."""
    a, b = resolve(left), resolve(right)
    keys = keys or []
    if keys and level is not Level.FULL:
        raise DiffError("Row keys need --level full")
    report = Report(level)
    mode = Mode.STANDARD if level is Level.METADATA else Mode.DEEP_NO_HISTOGRAM

    def analysed(x: Dataset, y: Dataset) -> tuple[Analysis, Analysis]:
        both = analyse(spark, x, mode, cache), analyse(spark, y, mode, cache)
        compare_analyses(*both, report)
        return both

    kinds = a.kind, b.kind
    if kinds == (Kind.FILE, Kind.FILE):
        same = len(set(content_hashes(spark, [a.path, b.path]).values())) == 1
        report.files = {"identical" if same else "modified": [b.path.name]}
        analysed(a, b)
        if keys:
            _rows(report, compare(read(spark, a.path), read(spark, b.path), keys), keys, examples)
    elif set(kinds) == {Kind.FILE, Kind.FOLDER}:
        file, folder = (a, b) if a.kind is Kind.FILE else (b, a)
        found = match_in_folder(spark, file.path, folder)
        report.files = {found.status: [file.path.name]}
        if found.status == "modified":
            other = Dataset(found.path, Kind.FILE)
            pair = (file, other) if a.kind is Kind.FILE else (other, file)
            analysed(*pair)
            if keys:
                _rows(report, compare(read(spark, pair[0].path), read(spark, pair[1].path), keys), keys, examples)
    elif kinds == (Kind.FOLDER, Kind.FOLDER):
        report.files = folder_inventory(spark, a, b)
        if level is not Level.METADATA:
            both = analysed(a, b)
            if keys:
                _folder_rows(spark, report, a, b, both, keys, examples)
    elif kinds == (Kind.COMPILED, Kind.COMPILED):
        if keys:
            raise DiffError("Row keys are not supported for compiled datasets")
        report.files = folder_inventory(spark, a, b)
        analysed(a, b)
        one, two = ((metadata(d) or {}).get("compiled") or {} for d in (a, b))
        report.provenance = {k: (one.get(k), two.get(k)) for k in sorted(one.keys() | two.keys()) if one.get(k) != two.get(k)}
    else:
        raise DiffError(f"Cannot compare a {a.kind} with a {b.kind}")
    report.summary = "Differences found." if report.differs() else "No differences detected."
    return report


