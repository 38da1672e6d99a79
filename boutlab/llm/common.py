"""What several operators of this package share."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, the word separator of all operators here; others are part of words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def ready_for_python(spark: SparkSession, rows: int = 512) -> None:
    """Let executors import this package, and hand them rows in batches of at most ``rows``.

    One text can have many megabytes, so batches are small.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    _ship_package(spark.sparkContext)


@functools.cache
def _ship_package(context: SparkContext) -> None:
    """Once per application; a cluster that has the package installed finds the same code twice."""
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def carried(docs: DataFrame) -> DataFrame:
    """The whole row as one column ``_row``, so that no name inside can clash with a working column."""
    return docs.select(F.struct("*").alias("_row"))


def unpacked(frame: DataFrame, names: Sequence[str], results: Sequence[str]) -> DataFrame:
    """Columns out of ``_row``, then the results; a result replaces a column of its name."""
    own = {c.lower() for c in results}
    kept = [F.col("_row")[c].alias(c) for c in names if c.lower() not in own]
    return frame.select(*kept, *results)
