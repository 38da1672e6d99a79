"""Raw texts of whole tables to typed columns, each job one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlab.functions import text
from boutlab.schema import MAX_ROUNDS


def sentinels_to_null(raw: DataFrame) -> DataFrame:
    """Height and reach need an inch mark, weight needs its unit, an empty stance is none."""
    return raw.withColumns(
        {
            "height": text.only_with_mark("height", *text.INCH_MARKS),
            "weight": text.only_with_mark("weight", *text.POUND_MARKS),
            "reach": text.only_with_mark("reach", *text.INCH_MARKS),
            "stance": text.text_or_null("stance"),
        }
    )


def measures_to_numbers(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "height": text.height_inches("height"),
            "weight": text.leading_number("weight"),
            "reach": text.leading_number("reach"),
        }
    )


def reach_from_height(competitors: DataFrame) -> DataFrame:
    return competitors.withColumn("reach", F.coalesce("reach", "height"))


def require_attributes(competitors: DataFrame) -> DataFrame:
    """Without height, weight or stance a competitor is not usable."""
    return competitors.dropna(subset=["height", "weight", "stance"])


def clean_competitors(raw: DataFrame) -> DataFrame:
    """Raw competitor texts to the competitor table."""
    typed = measures_to_numbers(sentinels_to_null(raw)).withColumns(
        {
            "date_of_birth": text.to_day("date_of_birth", "birth"),
            "gender": text.gender("bout_class"),
        }
    )
    return require_attributes(reach_from_height(typed)).drop("bout_class")


def rounds_to_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Round cells (``round``, ``text``) to one row with landed and attempted of rounds 1 to 5.

    A round without a cell gives NULLs.
    """
    pivoted = (
        cells.select(
            *keys,
            "round",
            text.landed("text").alias("landed"),
            text.attempted("text").alias("attempted"),
        )
        .groupBy(*keys)
        .pivot("round", list(range(1, MAX_ROUNDS + 1)))
        .agg(F.max("landed").alias("landed"), F.max("attempted").alias("attempted"))
    )
    return pivoted.select(
        *keys,
        *[
            F.col(f"{n}_{part}").alias(f"round_{n}_sig_str_{part}")
            for n in range(1, MAX_ROUNDS + 1)
            for part in ("landed", "attempted")
        ],
    )
