"""A training-data pipeline over the table of documents, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlab.llm import line_templates, mixing, packing, quality_rules, simhash
from boutlab.sources.tables import read_table, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is good. A null or empty text is rejected; an empty table stays so."""
    return quality_rules.keep_good(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines, and ``n_chars``, where there is one, of what is left.

    A text that loses all lines becomes empty and stays; a null one stays null. Other columns are passed on
    as they are, whatever their names.
    """
    # All columns but the text, which would travel twice.
    others = F.struct(*[c for c in docs.columns if c != "text"])
    packed = docs.select("doc_id", "text", others.alias("_document"))
    cleaned = line_templates.drop_recurring_lines(packed)
    shorter = F.when(F.col("n_dropped") > 0, F.length("text").cast("long"))
    columns = []
    for c in docs.columns:
        own = F.col("text") if c == "text" else F.col("_document")[c]
        columns.append((F.coalesce(shorter, own) if c == "n_chars" else own).alias(c))
    return cleaned.select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that share 0.8 of their five-word shingles, the smallest doc_id's.

    Unlike texts stay even if they share or lack a doc_id; texts without words are one group.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the target weight of their source and shuffled; columns are those of ``docs``.

    A null source is the source ''; a null doc_id counts as ''; rows of one doc_id are repeated alike.
    """
    packed = docs.select("doc_id", "source", F.struct("*").alias("_document"))
    return mixing.mix(packed).select("_document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is its end alone; a null doc_id stays null."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("line dedup", drop_recurring_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]
# Token ids have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
