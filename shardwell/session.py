"""Session settings that the engine's results rest on."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # naive times become epoch seconds as they are
    "spark.sql.timestampType": "TIMESTAMP_NTZ",  # CSV times without zone stay naive
    "spark.sql.timeType.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}


def session(cores: str = "*", **more: str) -> SparkSession:
    """A local session for the command line; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("shardwell")
    defaults = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": os.environ.get("SHARDWELL_MEMORY", "4g"), "spark.log.level": "ERROR"}
    spark = builder.config(map=defaults | SETTINGS | more).getOrCreate()
    ship(spark)
    return spark


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (dots written as two underscores) that hold while a reader infers a schema."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share; a temporary one only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/shardwell-{what}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_shardwell_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="shardwell-ship-")) / "shardwell_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    context._shardwell_shipped = True
