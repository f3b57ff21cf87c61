"""Merging files and folders: plan, validate, preview, execute.

Results are staged beside their destination first and moved into place when all are written. The moves are
single renames one after another: a crash between two of them leaves some files new and some old.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from enum import StrEnum
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.ordinal import ORDER
from ..functions.types import aligned, kinds_of
from ..operators import merge
from ..operators.merge import MergeError
from ..sources.files import SUFFIXES, Dataset, Kind, read, resolve, write
from ..sources.paths import AnyPath, copy, move, place


class Strategy(StrEnum):
    APPEND = "append"
    UPSERT = "upsert"


class Step(StrEnum):
    MERGE = "merge"
    SOURCE_ONLY = "source_only"
    TARGET_ONLY = "target_passthrough"


@dataclass(frozen=True)
class Options:
    strategy: Strategy = Strategy.APPEND
    keys: tuple[str, ...] = ()
    additive: bool = False
    ignore_filetype: bool = False
    out: AnyPath | None = None
    inplace: bool = False


@dataclass(frozen=True)
class Operation:
    step: Step
    source: AnyPath | None
    target: AnyPath | None
    destination: AnyPath


@dataclass
class Prepared:
    operation: Operation
    schema: T.StructType | None = None
    cast: bool = False
    issues: list[str] = field(default_factory=list)
    preview: dict[str, int] = field(default_factory=dict)


def check_options(o: Options) -> None:
    if (o.out is None) == (not o.inplace):
        raise MergeError("Choose exactly one of --out and --inplace")
    if o.strategy is Strategy.UPSERT and not o.keys:
        raise MergeError("Upsert needs key columns (--on)")
    if o.additive and o.ignore_filetype:
        raise MergeError("--schema-evolution allow-additive cannot be combined with --ignore-filetype")


def match_key(relative: str, ignore_filetype: bool) -> str:
    """What a source file and its target share: parent folders and stem, and the suffix unless ignored."""
    path = Path(relative)
    return (path.parent / path.stem).as_posix() + ("" if ignore_filetype else path.suffix.lower())


def _index(dataset: Dataset, ignore_filetype: bool, by_name: bool = False) -> dict[str, list[AnyPath]]:
    out: dict[str, list[AnyPath]] = {}
    for p in dataset.files():
        out.setdefault(match_key(p.name if by_name else dataset.relative(p), ignore_filetype), []).append(p)
    return out


def _only(paths: list[AnyPath], name: str) -> AnyPath:
    if len(paths) > 1:
        raise MergeError(f"Ambiguous match for {name}: {', '.join(map(str, paths))}")
    return paths[0]


def plan(source: Dataset, target: Dataset, o: Options) -> list[Operation]:
    """The operations of file into file, file into folder, or folder into folder, by destination."""
    if Kind.COMPILED in (source.kind, target.kind):
        raise MergeError("Compiled datasets cannot be merged")
    if source.kind is Kind.FOLDER and target.kind is Kind.FILE:
        raise MergeError("A folder cannot be merged into a file")
    out = place(o.out) if o.out else None
    if target.kind is Kind.FILE:
        if not o.ignore_filetype and source.path.suffix.lower() != target.path.suffix.lower():
            raise MergeError("File types differ; use --ignore-filetype")
        return [Operation(Step.MERGE, source.path, target.path, out or target.path)]
    if source.kind is Kind.FILE:
        found = _index(target, o.ignore_filetype, by_name=True).get(match_key(source.path.name, o.ignore_filetype))
        if not found:
            raise MergeError(f"No file in {target.path} matches {source.path.name}")
        path = _only(found, source.path.name)
        return [Operation(Step.MERGE, source.path, path, out or path)]
    theirs, ours = _index(target, o.ignore_filetype), _index(source, o.ignore_filetype)
    root = out or target.path
    steps = []
    for key, paths in ours.items():
        mine = _only(paths, key)
        if key in theirs:
            other = _only(theirs[key], key)
            steps.append(Operation(Step.MERGE, mine, other, root / target.relative(other)))
        else:
            steps.append(Operation(Step.SOURCE_ONLY, mine, None, root / source.relative(mine)))
    if not o.inplace:
        steps += [Operation(Step.TARGET_ONLY, None, p, root / target.relative(p)) for key, paths in theirs.items() if key not in ours for p in paths]
    return sorted(steps, key=lambda s: str(s.destination))


def _casts(op: Operation, o: Options) -> bool:
    """Text into a binary format: the source takes the target's types."""
    return o.ignore_filetype and op.source.suffix.lower() == ".csv" and op.target.suffix.lower() != ".csv"


def _source(spark: SparkSession, op: Operation, schema: T.StructType, cast: bool, ordered: bool = False) -> DataFrame:
    df = read(spark, op.source, ordered)
    if cast:
        kinds = {n: k for n, k in kinds_of(schema).items() if n in df.columns}
        df = aligned(df, kinds | ({ORDER: df.schema[ORDER].dataType} if ordered else {}))
    return df


def prepare(spark: SparkSession, operations: list[Operation], o: Options) -> list[Prepared]:
    """Each operation with its result schema, or with what stands against it."""
    out = []
    seen: set[AnyPath] = set()
    for op in operations:
        p = Prepared(op)
        out.append(p)
        if op.destination in seen:
            p.issues.append(f"Several results for {op.destination}")
        seen.add(op.destination)
        if op.destination.suffix.lower() not in SUFFIXES:
            p.issues.append(f"Unsupported file type: {op.destination.suffix or op.destination.name}")
        if op.destination.exists() and not (o.inplace and op.target == op.destination):
            p.issues.append(f"Destination already exists: {op.destination}")
        if op.step is not Step.MERGE:
            continue
        try:
            source, target = read(spark, op.source), read(spark, op.target)
            p.cast = _casts(op, o)
            if missing := [k for k in o.keys if k not in source.columns or k not in target.columns]:
                raise MergeError(f"Key columns not on both sides: {', '.join(missing)}")
            as_source = T.StructType([target.schema[f.name] if p.cast and f.name in target.columns else f for f in source.schema.fields])
            p.schema = merge.effective_schema(target.schema, as_source, o.additive)
        except Exception as e:  # an unreadable file is an issue of its operation
            p.issues.append(str(e).splitlines()[0])
    return out


def merged(spark: SparkSession, p: Prepared, o: Options) -> DataFrame:
    """The result of one merge in order: the target's rows, then the source's."""
    op = p.operation
    kinds = kinds_of(p.schema)
    target = read(spark, op.target, ordered=True)
    source = _source(spark, op, p.schema, p.cast, ordered=True)
    order = {ORDER: target.schema[ORDER].dataType}
    t, s = aligned(target, kinds | order), aligned(source, kinds | order)
    if o.strategy is Strategy.UPSERT:
        return merge.upsert(t, s, list(o.keys), ORDER)
    if o.keys:
        merge.check_conflicts(merge.append(t.drop(ORDER), s.drop(ORDER)), list(o.keys))
    return merge.append(t, s, order=ORDER)


def add_previews(spark: SparkSession, prepared: list[Prepared], o: Options) -> None:
    """What each merge would do, in counts; a conflict or a value that does not fit is an issue."""
    for p in prepared:
        if p.issues or p.schema is None:
            continue
        try:
            target, source = read(spark, p.operation.target), _source(spark, p.operation, p.schema, p.cast)
            counts = merge.preview_append(target, source, o.additive) if o.strategy is Strategy.APPEND else merge.preview_upsert(target, source, list(o.keys))
            p.preview = counts.first().asDict()
            if o.strategy is Strategy.APPEND and o.keys:
                merge.check_conflicts(merge.append(target, source, o.additive), list(o.keys))
        except Exception as e:
            p.issues.append(str(e).splitlines()[0])


def preview_line(p: Prepared) -> str:
    op = p.operation
    what = {Step.MERGE: f"merge {op.source} into {op.target}", Step.SOURCE_ONLY: f"copy new {op.source}", Step.TARGET_ONLY: f"keep {op.target}"}[op.step]
    counts = "".join(f", {k} {v}" for k, v in p.preview.items())
    cast = ", cast to the target's types" if p.cast else ""
    issues = "".join(f"; ISSUE: {i}" for i in p.issues)
    return f"{what} -> {op.destination}{cast}{counts}{issues}"


def execute(spark: SparkSession, prepared: list[Prepared], o: Options) -> list[AnyPath]:
    """Write every result to a staging folder, then move all into place. A failure before the moves changes nothing."""
    token = uuid.uuid4().hex
    staged: list[tuple[AnyPath, AnyPath]] = []
    made: set[AnyPath] = set()
    try:
        for p in prepared:
            op = p.operation
            parent = op.destination.parent
            while not parent.exists():
                made.add(parent)
                parent = parent.parent
            op.destination.parent.mkdir(parents=True, exist_ok=True)
            stage = op.destination.parent / f".merge-{token}-{op.destination.name}"
            staged.append((stage, op.destination))
            if op.step is Step.MERGE:
                write(merged(spark, p, o), stage)
            else:
                origin = op.source or op.target
                if origin.suffix.lower() == op.destination.suffix.lower():
                    copy(origin, stage)
                else:
                    write(read(spark, origin), stage)
        for stage, destination in staged:
            move(stage, destination)
    except BaseException:
        for stage, _ in staged:
            stage.unlink(missing_ok=True)
        for folder in sorted(made, key=lambda f: -len(f.parts)):
            if folder.exists() and not any(folder.iterdir()):
                folder.rmdir()
        raise
    return [d for _, d in staged]


@dataclass
class Merged:
    lines: list[str]
    issues: list[str]
    written: list[AnyPath] = field(default_factory=list)


def run(spark: SparkSession, source: str | Path, target: str | Path, o: Options, dry: bool = False) -> Merged:
    """Plan, validate and, unless dry or at issue, execute a merge. Issues stop a real run with MergeError."""
    check_options(o)
    prepared = prepare(spark, plan(resolve(source), resolve(target), o), o)
    if dry:
        add_previews(spark, prepared, o)
    issues = [i for p in prepared for i in p.issues]
    lines = [preview_line(p) for p in prepared]
    if dry:
        return Merged(lines, issues)
    if issues:
        raise MergeError("; ".join(issues))
    return Merged(lines, [], execute(spark, prepared, o))
