"""Compiling a folder's files of one schema into a Parquet dataset with provenance, and validating one."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import DATA, METADATA, SOURCE_FILE, Dataset, Kind, metadata, read_all, resolve, write_parts
from ..sources.paths import AnyPath, place, remove
from .analysis import Analysis, FileRecord, Mode, SchemaGroup, build, inventory, schema_groups

PREVIEW = 5


class CompileError(ValueError):
    pass


@dataclass
class Coverage:
    total: int
    compiled: int
    other_schema: int
    unreadable: int


@dataclass
class Compiled:
    path: AnyPath
    schema: SchemaGroup
    coverage: Coverage
    analysis: Analysis


def choose(groups: list[SchemaGroup], number: int | None) -> SchemaGroup:
    """A schema group by its number from 1; without a number there must be just one group."""
    if number is None:
        if len(groups) > 1:
            raise CompileError(f"{len(groups)} schemas found; choose one with --schema 1..{len(groups)}")
        return groups[0]
    if not 1 <= number <= len(groups):
        raise CompileError(f"--schema must be between 1 and {len(groups)}")
    return groups[number - 1]


def coverage(files: list[FileRecord], chosen: SchemaGroup) -> Coverage:
    bad = sum(f.error is not None for f in files)
    used = sum(f.error is None and f.columns == chosen.columns for f in files)
    return Coverage(len(files), used, len(files) - bad - used, bad)


def tagged_union(spark: SparkSession, dataset: Dataset, files: list[FileRecord]) -> DataFrame:
    """The files' rows with SOURCE_FILE."""
    return read_all(spark, dataset, [place(f.path) for f in files], tagged=True)


def compile_dataset(spark: SparkSession, source: str | Path, output: str | Path, schema: int | None = None) -> Compiled:
    """Write the files of one schema to `output`/data and what is known of them to `output`/metadata.json.

    The output must not exist; a failure leaves none. Files below the output do not count as sources.
    """
    dataset, out = resolve(source), place(output)
    if out.exists():
        raise CompileError(f"Output already exists: {output}")
    files = [f for f in inventory(spark, dataset) if not place(f.path).is_relative_to(out)]
    groups = schema_groups(files)
    if not groups:
        raise CompileError("failed to inspect any dataset files")
    chosen = choose(groups, schema)
    used = [f for f in files if f.error is None and f.columns == chosen.columns]
    try:
        size, rows = sum(place(f.path).stat().st_size for f in used), sum(f.rows for f in used)
        write_parts(tagged_union(spark, dataset, used), out / DATA, size / max(rows, 1))
        analysis = build(spark, Dataset(out / DATA, Kind.FOLDER), Mode.STANDARD)
        cover = coverage(files, chosen)
        provenance = {"source": str(dataset.path), "schema_hash": chosen.hash, "columns": [list(c) for c in chosen.columns], "files": [f.relative for f in used], "rows": {f.relative: f.rows for f in used}, "coverage": asdict(cover)}
        (out / METADATA).write_text(json.dumps({"analysis": analysis.to_dict(), "compiled": provenance}, indent=1))
    except BaseException:
        remove(out)
        raise
    return Compiled(out, chosen, cover, analysis)


@dataclass
class Validation:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def _preview(names: set[str] | list[str]) -> str:
    names = sorted(names)
    return ", ".join(names[:PREVIEW]) + (f" and {len(names) - PREVIEW} more" if len(names) > PREVIEW else "")


def rows_by_file(df: DataFrame) -> DataFrame:
    """(file, rows) of compiled data: coverage and row counts in one aggregate."""
    return df.groupBy(F.col(SOURCE_FILE).alias("file")).agg(F.count("*").alias("rows"))


def validate(spark: SparkSession, compiled: str | Path, source: str | Path | None = None) -> Validation:
    """Hold compiled data against its provenance, or against the source's present files: columns, files and
    rows. Files of the source that were left out are a warning."""
    out, dataset = Validation(), resolve(compiled)
    known = (metadata(dataset) or {}).get("compiled") if dataset.kind is Kind.COMPILED else None
    if known is None:
        return Validation(["Not a compiled dataset with readable metadata"])
    data = read_all(spark, dataset)
    expected = {n for n, _ in known["columns"]} | {SOURCE_FILE}
    if lost := expected - set(data.columns):
        out.errors.append(f"Columns missing: {_preview(lost)}")
    if extra := set(data.columns) - expected:
        out.errors.append(f"Columns not in the source: {_preview(extra)}")
    wanted = dict(known["rows"])
    if source is not None:
        files = [f for f in inventory(spark, resolve(source)) if not place(f.path).is_relative_to(dataset.path)]
        chosen = [f for f in files if f.error is None and [list(c) for c in f.columns] == known["columns"]]
        wanted = {f.relative: f.rows for f in chosen}
        if skipped := {f.relative for f in files} - set(wanted):
            out.warnings.append(f"Source files left out: {_preview(skipped)}")
    if SOURCE_FILE in data.columns:
        found = {r["file"]: r["rows"] for r in rows_by_file(data).collect()}
        # a file without rows leaves none to be seen
        if missing := {f for f, n in wanted.items() if n} - set(found):
            out.errors.append(f"Files missing from the data: {_preview(missing)}")
        if unknown := set(found) - set(wanted):
            out.errors.append(f"Files that the source lacks: {_preview(unknown)}")
        if unlike := [f"{f} ({found[f]} of {wanted[f]})" for f in found if f in wanted and found[f] != wanted[f]]:
            out.errors.append(f"Row counts differ: {_preview(unlike)}")
    return out


