"""Analysis of a dataset: file inventory, schema groups, profile, and its cache and JSON form."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from enum import StrEnum
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import histogram as H
from ..functions.ordinal import ORDER, with_ordinal
from ..functions.types import columns_of, is_numeric, signature
from ..operators.profile import digests, profile, profile_histogram
from ..sources.files import METADATA, Dataset, Kind, SourceError, csv_layout, metadata, read, read_all, rows_of
from ..sources.paths import AnyPath, place

VERSION = 1


class Mode(StrEnum):
    QUICK = "quick"
    STANDARD = "standard"
    DEEP = "deep"
    DEEP_NO_HISTOGRAM = "_deep_no_hist"


@dataclass(frozen=True)
class FileRecord:
    path: str
    relative: str
    columns: tuple[tuple[str, str], ...] = ()
    rows: int = 0
    error: str | None = None

    @property
    def schema_hash(self) -> str:
        return signature(self.columns)


@dataclass(frozen=True)
class SchemaGroup:
    columns: tuple[tuple[str, str], ...]
    hash: str
    count: int


@dataclass
class ColumnStatistics:
    dtype: str
    null_rate: float = 0.0
    unique_estimate: int | None = None
    min: str | None = None
    max: str | None = None
    mean: float | None = None
    median: str | None = None
    stddev: float | None = None
    histogram: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class Analysis:
    row_count: int
    column_count: int
    source_file_count: int
    schemas: list[SchemaGroup]
    statistics: dict[str, ColumnStatistics] | None = None
    column_hashes: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    created_at: str = ""
    schema_hash: str | None = None
    files: list[FileRecord] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self) | {"version": VERSION}

    @classmethod
    def from_dict(cls, found: dict) -> Analysis:
        if found.get("version") != VERSION:
            raise ValueError("another version of the analysis format")
        names = cls.__dataclass_fields__
        made = {k: v for k, v in found.items() if k in names}
        pairs = lambda c: tuple(tuple(x) for x in c)
        made["schemas"] = [SchemaGroup(pairs(s["columns"]), s["hash"], s["count"]) for s in found["schemas"]]
        made["files"] = [FileRecord(**(f | {"columns": pairs(f["columns"])})) for f in found.get("files", [])]
        if found.get("statistics") is not None:
            made["statistics"] = {k: ColumnStatistics(**(v | {"histogram": [tuple(h) for h in v["histogram"]]})) for k, v in found["statistics"].items()}
        return cls(**made)


def _reason(error: Exception) -> str:
    return str(error).strip().splitlines()[0][:200] if str(error).strip() else type(error).__name__


def inventory(spark: SparkSession, dataset: Dataset, side_by_side: int = 16) -> list[FileRecord]:
    """Schema and rows of each file; a file that cannot be read has its error instead.

    Schemas are looked up for several files side by side, and rows are counted in one job per format, which reads no
    column; only if that job meets a broken file are its files counted one by one."""
    paths = dataset.files()

    def schema(path: AnyPath) -> tuple | Exception:
        try:
            return columns_of(read(spark, path).schema)
        except Exception as e:  # a broken file of any kind is a finding, not a failure
            return e

    def count(path: AnyPath) -> int | Exception:
        try:
            return read(spark, path).count()
        except Exception as e:
            return e

    def count_all(group: list[AnyPath]) -> dict[AnyPath, int | Exception]:
        try:
            found = rows_of(spark, group)
        except Exception:  # some file breaks within
            return dict(zip(group, pool.map(count, group), strict=True))
        return {p: found.get(p, 0) for p in group}

    with ThreadPoolExecutor(side_by_side) as pool:
        schemas = dict(zip(paths, pool.map(schema, paths), strict=True))
        groups: dict[object, list[AnyPath]] = {}
        for p in paths:
            if not isinstance(schemas[p], Exception):
                groups.setdefault((p.suffix.lower(), p.suffix.lower() == ".csv" and csv_layout(spark, str(p))[1]), []).append(p)
        counts = {p: n for group in groups.values() for p, n in count_all(group).items()}
    out = []
    for p in paths:
        broken = next((x for x in (schemas[p], counts.get(p)) if isinstance(x, Exception)), None)
        out.append(FileRecord(str(p), dataset.relative(p), error=_reason(broken)) if broken else FileRecord(str(p), dataset.relative(p), schemas[p], counts[p]))
    return out


def schema_groups(files: list[FileRecord]) -> list[SchemaGroup]:
    """Schemas by how many files have them, most first, then by hash."""
    counts = Counter(f.columns for f in files if f.error is None)
    return sorted((SchemaGroup(c, signature(c), n) for c, n in counts.items()), key=lambda g: (-g.count, g.hash))


def type_changes(groups: list[SchemaGroup]) -> dict[str, list[str]]:
    """Columns that have several types over the groups."""
    kinds: dict[str, set[str]] = {}
    for g in groups:
        for name, kind in g.columns:
            kinds.setdefault(name, set()).add(kind)
    return {n: sorted(k) for n, k in sorted(kinds.items()) if len(k) > 1}


def column_statistics(df: DataFrame, mode: Mode) -> tuple[dict[str, ColumnStatistics], dict[str, str]]:
    """Statistics of all columns, and column digests if deep (then `df` has the order key)."""
    deep = mode in (Mode.DEEP, Mode.DEEP_NO_HISTOGRAM)
    plain = df.drop(ORDER)
    out: dict[str, ColumnStatistics] = {}
    for r in profile(plain, deep).collect() if plain.columns else []:
        out[r["column"]] = ColumnStatistics(r["dtype"], r["null_rate"], r["unique"], r["min"], r["max"], r["mean"], r["median"], r["stddev"])
    hashes: dict[str, str] = {}
    if deep and plain.columns:
        hashes = {r["column"]: r["digest"] for r in digests(with_ordinal(df), "_ordinal").collect()}
    if mode is Mode.DEEP:
        numeric = [f.name for f in plain.schema.fields if is_numeric(f.dataType) and out[f.name].min is not None]
        bins = profile_histogram(plain, numeric).orderBy("column", "bin").collect() if numeric else []
        for name in numeric:
            own = [r for r in bins if r["column"] == name]  # none if an extreme is infinite
            bounds = [*(r["low"] for r in own), *(r["high"] for r in own[-1:])]
            names = H.labels(bounds) if len(own) > 1 else [H.bound_label(b) for b in bounds[:1]]
            out[name].histogram = list(zip(names, (r["count"] for r in own), strict=True))
    return out, hashes


def build(spark: SparkSession, dataset: Dataset, mode: Mode) -> Analysis:
    files = inventory(spark, dataset)
    good = [f for f in files if f.error is None]
    if not good:
        raise SourceError("failed to inspect any dataset files: " + "; ".join(f"{f.relative}: {f.error}" for f in files[:5]))
    groups = schema_groups(files)
    warnings = [f"Could not read {f.relative}: {f.error}" for f in files if f.error]
    if len(groups) > 1:
        warnings.append(f"Schema drift: {len(groups)} schemas in {len(good)} files")
    analysis = Analysis(
        row_count=sum(f.rows for f in good),
        column_count=len({n for g in groups for n, _ in g.columns}),
        source_file_count=len(good),
        schemas=groups,
        warnings=warnings,
        created_at=dt.datetime.now(dt.timezone.utc).isoformat(),
        schema_hash=groups[0].hash if len(groups) == 1 else None,
        files=files,
    )
    if mode is not Mode.QUICK:
        deep = mode is not Mode.STANDARD
        df = read_all(spark, dataset, [place(f.path) for f in good], ordered=deep)
        analysis.statistics, analysis.column_hashes = column_statistics(df, mode)
    return analysis


class Cache:
    """Analyses as JSON files named by a fingerprint of the source's paths, sizes and times."""

    def __init__(self, folder: Path):
        self.folder = folder

    def key(self, dataset: Dataset, mode: Mode) -> str:
        parts = [str(dataset.path), dataset.kind, mode, str(VERSION)]
        watched = list(dataset.files()) + ([dataset.path / METADATA] if dataset.kind is Kind.COMPILED else [])
        for path in watched:
            stat = path.stat()
            parts.append(f"{path}:{stat.st_size}:{stat.st_mtime_ns}")
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()

    def get(self, dataset: Dataset, mode: Mode) -> Analysis | None:
        """The kept analysis; a file that cannot be read as one is deleted."""
        path = self.folder / f"{self.key(dataset, mode)}.json"
        try:
            return Analysis.from_dict(json.loads(path.read_text()))
        except FileNotFoundError:
            return None
        except (OSError, ValueError, KeyError, TypeError):
            path.unlink(missing_ok=True)
            return None

    def put(self, dataset: Dataset, mode: Mode, analysis: Analysis) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        path = self.folder / f"{self.key(dataset, mode)}.json"
        stage = path.with_suffix(".tmp")
        stage.write_text(json.dumps(analysis.to_dict()))
        stage.replace(path)


def analyse(spark: SparkSession, dataset: Dataset, mode: Mode = Mode.STANDARD, cache: Cache | None = None) -> Analysis:
    """The cached analysis if the source is unchanged; a compiled dataset's stored one whatever mode is asked,
    unless it cannot be read; else a new one."""
    if cache and (kept := cache.get(dataset, mode)):
        return kept
    analysis = None
    if dataset.kind is Kind.COMPILED and (found := metadata(dataset)):
        try:
            analysis = Analysis.from_dict(found["analysis"])
        except (KeyError, TypeError, ValueError):
            analysis = None
    analysis = analysis or build(spark, dataset, mode)
    if cache:
        cache.put(dataset, mode, analysis)
    return analysis
