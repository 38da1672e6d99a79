"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession


def build_session(name: str = "boutlab", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, or a local one in tests.

    A cluster that names none is an error: each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="boutlab-")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Point iterative training at the shared folder unless the cluster already did."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on, for sessions built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Rows have up to 160 columns: let methods the JIT would refuse fall back to smaller ones.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, for the Arrow functions that read pages."""
    _ship(spark.sparkContext)


@functools.cache
def _ship(context: SparkContext) -> None:
    """Once per application; a cluster that has the package installed finds the same code twice."""
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
