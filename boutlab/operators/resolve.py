"""Names to ids, duplicates, aliases, and the look-ups done before a refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlab.operators.skew import lookup
from boutlab.operators.totals import complete, unpivot
from boutlab.schema import NAME_ALIASES, SHARED_NAMES


def min_id_per_name(table: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    return table.groupBy(name).agg(F.min(key).alias(key))


def duplicate_names(table: DataFrame, name: str = "name") -> DataFrame:
    return table.groupBy(name).agg(F.count(F.lit(1)).alias("copies")).filter("copies >= 2")


def rows_with_duplicate_names(table: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """Rows whose name another row has too.

    The copies of a name are never brought together: the set of repeated names is the small side.
    """
    repeated = duplicate_names(table, name).select(name)
    return lookup(table, repeated, [name], [key], "left_semi")


def drop_duplicate_names(
    table: DataFrame, key: str = "id", name: str = "name", protected: Sequence[str] = SHARED_NAMES
) -> DataFrame:
    """Keep the row with the least id per name; every row of a protected name; no NULL names lost.

    The kept ids are unique, so matching them back meets no hot key.
    """
    kept = min_id_per_name(table, key, name).filter(F.col(name).isNotNull()).select(key)
    spared = F.col(name).isNull() | F.col(name).isin(*protected)
    # Decide by membership instead of splitting the table in two scans.
    marked = table.join(kept.withColumn("_kept", F.lit(True)), key, "left")
    return marked.filter(F.col("_kept") | spared).drop("_kept")


def alias_table(spark: SparkSession) -> DataFrame:
    """The built-in alternative spellings."""
    return spark.createDataFrame(list(NAME_ALIASES.items()), "raw_name string, name string")


def resolve_aliases(
    frame: DataFrame, columns: Sequence[str], aliases: DataFrame, key: str
) -> DataFrame:
    """Replace a name by its alias target where there is one."""
    found = frame
    for column in columns:
        known = aliases.select(F.col("raw_name").alias(column), F.col("name").alias("_alias"))
        found = lookup(found, known, [column], [key]).withColumn(
            column, F.coalesce("_alias", column)
        ).drop("_alias")
    return found.select(*frame.columns)


def resolve_names(bouts: DataFrame, competitors: DataFrame, key: str = "bout_id") -> DataFrame:
    """Ids of both corners by name: the least id of a repeated name, NULL for unknown names."""
    ids = min_id_per_name(competitors)
    found = bouts.drop("r_id", "b_id")
    for side in ("r", "b"):
        one = ids.select(F.col("name").alias(f"{side}_name"), F.col("id").alias(f"{side}_id"))
        found = lookup(found, one, [f"{side}_name"], [key])
    return found


def without_ids(bouts: DataFrame) -> DataFrame:
    return bouts.filter(F.col("r_id").isNull()).select("bout_id", "r_name", "b_name")


def without_odds(bouts: DataFrame) -> DataFrame:
    return bouts.filter(F.col("quote_id").isNull()).select(
        "bout_id", "r_name", "b_name", "bout_date"
    )


def missing_names(bouts: DataFrame) -> DataFrame:
    """Names of red corners nobody could resolve."""
    return bouts.filter(F.col("r_id").isNull()).select(F.col("r_name").alias("name")).distinct()


def search_names(directory: DataFrame, wanted: DataFrame, key: str = "entry_id") -> DataFrame:
    """Directory entries whose first and last name make a wanted name, whatever the case."""
    full = F.lower(F.concat_ws(" ", "first_name", "last_name"))
    names = wanted.select(F.lower("name").alias("_full")).distinct()
    return lookup(directory.withColumn("_full", full), names, ["_full"], [key], "left_semi").drop(
        "_full"
    )


def bout_legs_of(bouts: DataFrame) -> DataFrame:
    def side(me, other):
        return {
            "competitor_id": f"{me}_id",
            "opponent_id": f"{other}_id",
            "totals_id": f"{me}_totals_id",
        }

    return unpivot(complete(bouts), ["bout_id", "bout_date"], side)


def bouts_of_competitor(bouts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Complete bouts of each wanted competitor before its date: ``wanted(competitor_id, before)``.

    ``wanted`` holds one row per competitor; the bouts are spread so a busy competitor is no problem.
    """
    legs = bout_legs_of(bouts)
    return lookup(legs, wanted, ["competitor_id"], ["bout_id"], "inner").filter(
        F.col("bout_date") < F.col("before")
    ).drop("before")


def last_bout_date(bouts: DataFrame, before: Column) -> DataFrame:
    """Date of the last complete bout of every competitor under a bound."""
    return (
        bout_legs_of(bouts)
        .filter(F.col("bout_date") < before)
        .groupBy("competitor_id")
        .agg(F.max("bout_date").alias("last_date"))
    )


def value_counts(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
