"""Stored tables: pending rows, look-ups by id, new ids, updates as new snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlab.operators.skew import ROWS_PER_SLOT, lookup, number_rows


def pending_bouts(bouts: DataFrame, cutoff) -> DataFrame:
    """Bouts after the cutoff without totals."""
    return bouts.filter(
        (F.col("bout_date") > F.lit(cutoff).cast("date"))
        & F.col("r_totals_id").isNull()
        & F.col("b_totals_id").isNull()
    )


def pending_quotes(quotes: DataFrame, cutoff) -> DataFrame:
    """Quotes after the cutoff that no bout has."""
    return quotes.filter(
        (F.col("quote_date") > F.lit(cutoff).cast("date")) & F.col("bout_id").isNull()
    )


def bouts_by_date(bouts: DataFrame) -> DataFrame:
    return bouts.orderBy("bout_date", "bout_id")


def lookup_by_id(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of a table for a batch of ids; ids without a row stay with NULLs."""
    return lookup(keys, table, [key], keys.columns)


def natural_order(*columns: str) -> Column:
    """A number spread evenly over any natural key, to order rows by."""
    digits = F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8)
    return F.conv(digits, 16, 10).cast("long")


def append_with_keys(
    existing: DataFrame,
    new_rows: DataFrame,
    key: str,
    order: Sequence[str],
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """New rows with ids following the greatest stored one, along a unique order.

    Rows are cut for numbering by the first two order columns; ``natural_order`` spreads any key evenly.
    """
    last = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
    return number_rows(new_rows, order, key, last, rows_per_slot)


def append_with_child_keys(
    existing: DataFrame,
    children: DataFrame,
    new_rows: DataFrame,
    key: str,
    child_key: str,
    order: Sequence[str],
    names: Sequence[str],
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """New rows with an id, and one id for each of their children, from one numbering.

    The row in place n takes id last + n and its children the n-th run of ``len(names)`` ids behind the
    greatest stored child's, in columns ``names``: a child's id needs no shuffle of its own.
    """
    last = children.agg(F.coalesce(F.max(child_key), F.lit(0)).cast("long")).scalar()
    first = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
    numbered = number_rows(new_rows, order, "_place", -1, rows_per_slot)
    place = F.col("_place")
    keys = {key: first + 1 + place}
    keys |= {name: last + 1 + place * len(names) + i for i, name in enumerate(names)}
    return numbered.withColumns(keys).drop("_place")


def overlay_update(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A new snapshot: rows named in ``changes`` take its values, NULLs included.

    ``changes`` is unique on ``key``. Columns only ``changes`` has are added.
    """
    names = [c for c in changes.columns if c != key]
    given = changes.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in names]
    )

    def merged(c):
        if c not in names:
            return F.col(c)
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    added = [F.col(f"_new_{c}").alias(c) for c in names if c not in base.columns]
    return base.join(given, key, "left").select(*[merged(c) for c in base.columns], *added)


def latest_one(table: DataFrame, key: str, value, order: str) -> DataFrame:
    """The newest row of one key."""
    return table.filter(F.col(key) == F.lit(value)).orderBy(F.desc(order)).limit(1)
