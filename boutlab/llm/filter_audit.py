"""How filters interact: what each one removes, at every step of every order of applying them.

A document is reduced to the filters it fails. For a matrix of such masks (0 where a filter fails,
infinite elsewhere) and one of the places of the filters in every order (the inverse permutations), the
min-plus product is the step that removes a document. Counts of equal masks are then scattered to steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from boutlab.llm.common import ready_for_python
from boutlab.operators.skew import lookup
from boutlab.sources.tables import stage

FILTERS = "ABCDE"
# Fixed values of the filters A to D.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUED = bytes(range(0x80, 0xC0))
WHITE = re.compile(rb"[\x20\x09-\x0D]")
# Bytes of a text that are cut into words at once.
BLOCK = 1 << 20

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, block by block; ``split`` knows the same white space as the filters."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            space = WHITE.search(data, end)
            end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def failed_filters(text: str) -> int:
    """Bits of the filters A to D that one text fails."""
    data = text.encode("utf-8")
    words, distinct = 0, set()
    for some in _words(data):
        words += len(some)
        distinct.update(some)
    characters = len(data) - _among(data, CONTINUED)
    return (
        (words < FEWEST_WORDS)
        | (100 * len(distinct) < LEAST_DISTINCT * words) << 1
        | (100 * _among(data, CAPITALS) > MOST_CAPITALS * characters) << 2
        | (_among(data, SYMBOLS) > 0) << 3
    )


def _among(data: bytes, wanted: bytes) -> int:
    return len(data) - len(data.translate(None, wanted))


@F.pandas_udf(IntegerType())
def failed(text: pd.Series) -> pd.Series:
    return text.map(failed_filters).astype("int32")


def filter_profiles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail exactly the filters in ``mask``.

    A to D are read from the text; E, a copy of a text with a smaller doc_id, needs no join: documents
    are counted by text, then the one with the smallest doc_id of all is taken off. Only checksums,
    masks and ids travel, and every count is added up before it does, so a text with any number of
    copies costs one row per task and part.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("_text"),
        failed(text).alias("mask"),
    )

    def marked(name: str) -> Column:
        return F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)

    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(marked("quality"), marked("toxic"))
    wanted = known.select("doc_id", F.col("quality").alias("good"), "toxic")
    joined = lookup(stage(rows, "failed_filters"), stage(wanted, "labels_by_id"), ["doc_id"], ["_text", "part"])
    group = ["_text", "mask", "part", "good", "toxic"]
    marks = {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    per_id = joined.withColumns(marks).groupBy(*group, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # min() passes over structs that are null: documents without an id are never first.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    per_text = per_id.groupBy(*group).agg(F.sum("n").alias("n"), first.alias("first"), nameless.alias("nameless"))
    # A text has few rows by now, one per part and pair of marks.
    least = F.min("first.doc_id").over(Window.partitionBy("_text"))
    originals = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("nameless")
    split = per_text.withColumn("least", least).withColumn("originals", originals)
    copy = 1 << FILTERS.index("E")
    return (
        split.withColumn(
            "_both",
            F.explode(
                F.array(
                    F.struct(F.col("mask"), F.col("originals").alias("n")),
                    F.struct((F.col("mask") + F.lit(copy)).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
                )
            ),
        )
        .filter("_both.n > 0")
        .groupBy("part", F.col("_both.mask").alias("mask"), "good", "toxic")
        .agg(F.sum("_both.n").alias("n"))
    )


def removal_steps(masks: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """The step, from 0, that removes each mask in each order; infinite where nothing does.

    The min-plus product of masks x filters with filters x orders.
    """
    orders = np.array(list(permutations(range(filters))))
    places = np.argsort(orders, axis=1).T.astype(float)
    fails = np.where(masks[:, None] >> np.arange(filters) & 1, 0.0, np.inf)
    return (fails[:, :, None] + places[None, :, :]).min(axis=1)


def audit_counts(mask: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """All orders and steps over documents given as counts of equal masks."""
    filters = len(FILTERS)
    orders = np.array(list(permutations(range(filters))))
    gone_at = removal_steps(mask)
    shape = (len(orders), filters)

    def scattered(weight: np.ndarray) -> np.ndarray:
        """Weights added up by order and removal step."""
        counts = np.zeros(shape, np.int64)
        row, order = np.nonzero(np.isfinite(gone_at))
        np.add.at(counts, (order, gone_at[row, order].astype(int)), weight[row])
        return counts

    removed = scattered(n)
    fails = mask[:, None] >> np.arange(filters) & 1
    failing = (fails * n[:, None]).sum(0)[orders]
    alone = np.array([n[mask == 1 << f].sum() for f in range(filters)])[orders]
    by_filter = np.zeros(filters, np.int64)
    np.add.at(by_filter, orders, removed)
    step = np.arange(1, filters + 1)
    return pd.DataFrame(
        {
            "filter_order": np.repeat(["".join(FILTERS[f] for f in o) for o in orders], filters),
            "step": np.tile(step, len(orders)).astype("int32"),
            "kept": (n.sum() - np.cumsum(removed, axis=1)).ravel(),
            "removed": removed.ravel(),
            # Those failing a filter are removed by it or were removed before.
            "redundant": (failing - removed).ravel(),
            "unique_fails": alone.ravel(),
            "good_lost": scattered(n * good).ravel(),
            "toxic_lost": scattered(n * toxic).ravel(),
            "shapley": by_filter[orders].ravel(),
        }
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with what that step removes and keeps.

    ``part`` is the language, null as the empty string. ``docs`` has doc_id, text and lang, ``labels``
    doc_id, quality and toxic. Steps count from 1; their filter is that letter of ``filter_order``.

    Texts are read once, by Arrow batches that give one small number per text; after that only counts
    travel, and each part ends as at most 128 counts, whose 600 rows one task makes.

    A null text counts as an empty one, which fails A alone and E as a copy. A null doc_id is neither
    smaller than another nor has a smaller one, and no label; rows with equal doc_id and text are no
    copies of each other. Several labels of one doc_id mark it if any does; null marks count as none. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    ready_for_python(docs.sparkSession, 256)

    def audit(counts: pd.DataFrame) -> pd.DataFrame:
        columns = [counts[c].to_numpy(np.int64) for c in ("mask", "good", "toxic", "n")]
        found = audit_counts(*columns)
        found.insert(0, "part", counts.part.iloc[0])
        return found

    return filter_profiles(docs, labels).groupBy("part").applyInPandas(audit, SCHEMA)


def audit_filters_sql() -> str:
    """The same in DuckDB, straight from the rules."""
    letters = ", ".join(f"('{f}')" for f in FILTERS)
    names = [f"f{i}" for i in range(1, len(FILTERS) + 1)]
    sources = ", ".join(f"letters AS t{i}(f{i})" for i in range(1, len(FILTERS) + 1))
    apart = " AND ".join(f"{a} <> {b}" for i, a in enumerate(names) for b in names[i + 1 :])
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT *, regexp_extract_all(text, '[^ \t-\r]+') AS words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
    min(doc_id) OVER (PARTITION BY text) AS least
  FROM texts
), marks AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < {FEWEST_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * capitals > {MOST_CAPITALS} * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN least < c.doc_id THEN 'E' ELSE '' END AS fails
  FROM counted c LEFT JOIN marks USING (doc_id)
), profiles AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM failing GROUP BY ALL
), letters(f) AS (VALUES {letters}), orders AS (
  SELECT {' || '.join(names)} AS filter_order FROM {sources} WHERE {apart}
), ranked AS (
  SELECT p.*, o.filter_order,
    (SELECT min(strpos(o.filter_order, x)) FROM (SELECT unnest(string_split(p.fails, '')) AS x) WHERE x <> '') AS gone
  FROM profiles p, orders o
), steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
    sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone = step AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM ranked, (SELECT unnest(range(1, {len(FILTERS) + 1}))::INT AS step)
  GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM steps
"""
