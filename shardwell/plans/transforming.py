"""User transforms: Python files with transform(df) or transform(df, context), and a scaffold for one."""

from __future__ import annotations

import importlib.util
import inspect
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.types import columns_of, signature
from ..sources.files import DATA, METADATA, Dataset, Kind, SourceError, is_compiled, metadata, read, resolve, write
from ..sources.paths import AnyPath, place, remove
from .analysis import Mode, build, inventory, schema_groups


class TransformError(ValueError):
    pass


@dataclass(frozen=True)
class FileMetadata:
    row_count: int
    schema_hash: str


@dataclass(frozen=True)
class Context:
    file_name: str
    file_path: str
    schema: dict[str, str]
    metadata: FileMetadata


def load(path: str | Path) -> Callable[[DataFrame, Context], DataFrame]:
    """The file's `transform`, called with the context if it takes two positional parameters."""
    found = Path(path).expanduser().resolve()
    if not found.is_file():
        raise TransformError(f"Transform file does not exist: {path}")
    spec = importlib.util.spec_from_file_location(f"shardwell_user_{uuid.uuid4().hex}", found)
    if spec is None or spec.loader is None:
        raise TransformError(f"Not a Python file: {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    f = getattr(module, "transform", None)
    if not callable(f):
        raise TransformError(f"{path} defines no transform(df) function")
    kinds = (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD)
    n = sum(p.kind in kinds for p in inspect.signature(f).parameters.values())
    if n not in (1, 2):
        raise TransformError("transform takes one or two positional parameters: df, or df and context")
    return f if n == 2 else lambda df, context: f(df)


def apply(f: Callable, df: DataFrame, context: Context) -> DataFrame:
    out = f(df, context)
    if not isinstance(out, DataFrame):
        raise TypeError(f"transform must return a DataFrame, not {type(out).__name__}")
    return out


def default_output(dataset: Dataset) -> AnyPath:
    """<name>_transformed beside the source, with the suffix of a file."""
    p = dataset.path
    return p.with_name(f"{p.stem}_transformed{p.suffix}") if dataset.kind is Kind.FILE else p.with_name(f"{p.name}_transformed")


@dataclass
class Transformed:
    path: AnyPath
    files: list[AnyPath] = field(default_factory=list)


def transform(spark: SparkSession, source: str | Path, script: str | Path, output: str | Path | None = None, workers: int = 1) -> Transformed:
    """Apply a user function to each file and write the result under the same layout. The output must not
    exist; a failure leaves none. A compiled dataset's metadata is made anew, with a deep profile."""
    dataset, f = resolve(source), load(script)
    out = place(output) if output else default_output(dataset)
    if out.exists():
        raise TransformError(f"Output already exists: {out}")
    single = dataset.kind is Kind.FILE
    if not single and out.suffix:
        raise TransformError("A file as output needs a file as source")
    if single and not out.suffix:
        out = out / dataset.path.name

    def one(path: AnyPath) -> AnyPath:
        df = read(spark, path)
        columns = columns_of(df.schema)
        context = Context(path.name, str(path), dict(columns), FileMetadata(df.count(), signature(columns)))
        target = out if single else out / path.relative_to(dataset.path)
        write(apply(f, df, context), target)
        return target

    try:
        if workers > 1:
            with ThreadPoolExecutor(workers) as pool:  # Spark runs the jobs of several threads side by side
                done = list(pool.map(one, dataset.files()))
        else:
            done = [one(p) for p in dataset.files()]
        if dataset.kind is Kind.COMPILED:
            known = (metadata(dataset) or {}).get("compiled") or {}
            analysis = build(spark, Dataset(out / DATA, Kind.FOLDER), Mode.DEEP)
            (out / METADATA).write_text(json.dumps({"analysis": analysis.to_dict(), "compiled": known | {"transformed_by": Path(script).name}}, indent=1))
            assert is_compiled(out)
    except BaseException:
        remove(out)
        raise
    return Transformed(out, done)


EXAMPLES = '''
# Each file comes as a Spark DataFrame; return a DataFrame. Some starting points:
#   df = df.withColumnRenamed("old", "new").drop("unused")
#   df = df.filter(F.col("value") > 0)
#   df = df.withColumn("value", F.col("value").cast("double"))
#   df = df.fillna({"value": 0.0})
#   df = df.withColumn("ts", F.try_to_timestamp("ts"))
#   df = df.distinct()
#   df = df.select("id", "value").orderBy("id")
#   df = df.withColumn("file", F.lit(context.file_name))
# context has file_name, file_path, schema (name -> type), metadata.row_count and metadata.schema_hash.


def transform(df, context):
    return df
'''


def scaffold(spark: SparkSession, source: str | Path, output: str | Path) -> Path:
    """Write a transform that changes nothing, with the observed schemas and examples as comments."""
    out = Path(output).expanduser()
    if out.exists():
        raise TransformError(f"Output already exists: {output}")
    dataset = resolve(source)
    groups = schema_groups(inventory(spark, dataset))
    if not groups:
        raise SourceError("failed to inspect any dataset files")
    lines = ['"""A transform for ' + dataset.path.name + '."""', "", "from pyspark.sql import functions as F  # noqa: F401", "", "# Schemas observed:"]
    for i, g in enumerate(groups, 1):
        lines.append(f"# {i}. {g.count} file(s)")
        lines += [f"#      {n}: {t}" for n, t in g.columns]
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("\n".join(lines) + "\n" + EXAMPLES)
    return out
