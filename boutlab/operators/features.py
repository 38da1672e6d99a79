"""Wide model rows: one row per bout with both corners' totals and attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlab.functions.text import american_odds, class_name, label_number, label_of, pounds
from boutlab.operators.resolve import resolve_names
from boutlab.operators.skew import ROWS_PER_SLOT, lookup
from boutlab.operators.totals import pair_up, running_totals
from boutlab.schema import (
    CORNER_FEATURES,
    CORNERS,
    FEATURES,
    TEXT_FEATURES,
    TOTAL_COLUMNS,
    VOCABULARY,
)

BODY = ("stance", "height", "reach")


def project_features(frame: DataFrame, side: str, passing: Sequence[str] = ()) -> DataFrame:
    """The 75 columns of one corner, renamed with its prefix."""
    return frame.selectExpr(*passing, *[f"{c} AS {side}_{c}" for c in CORNER_FEATURES])


def attach_competitors(bouts: DataFrame, competitors: DataFrame, day: str, key: str) -> DataFrame:
    """Attributes of both corners, age in days on the day of the bout, gender of the red corner."""
    found = bouts
    for side in CORNERS:
        gender = ["gender"] if side == CORNERS[0] else []
        one = competitors.selectExpr(
            f"id AS {side}_id",
            *[f"{c} AS {side}_{c}" for c in BODY],
            f"date_of_birth AS _{side}_born",
            *gender,
        )
        found = lookup(found, one, [f"{side}_id"], [key])
    return found.withColumns(
        {f"{side}_age": F.date_diff(day, f"_{side}_born") for side in CORNERS}
    ).drop(*[f"_{side}_born" for side in CORNERS])


def matchup_join(pairs: DataFrame, totals: DataFrame, competitors: DataFrame, key: str) -> DataFrame:
    """Both corners' totals and attributes for pairs of competitors.

    ``pairs`` has the key, ``r_id``, ``b_id``, ``r_totals_id``, ``b_totals_id`` and ``bout_date``.
    A missing totals row or competitor leaves NULLs.
    """
    found = pairs
    for side in CORNERS:
        one = totals.selectExpr(
            f"totals_id AS {side}_totals_id", *[f"{c} AS {side}_{c}" for c in TOTAL_COLUMNS]
        )
        found = lookup(found, one, [f"{side}_totals_id"], [key])
    return attach_competitors(found, competitors, "bout_date", key)


def training_dataset(
    bouts: DataFrame,
    stats: DataFrame,
    competitors: DataFrame,
    as_of: str = "before",
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """152 features, label and odds per bout.

    ``as_of='before'`` takes the totals each corner brought into the bout; ``'after'`` includes the
    bout itself, and so gives the result away. ``bouts`` carries ``weight``, ``r_odds`` and ``b_odds``.
    """
    if as_of not in ("before", "after"):
        raise ValueError("as_of is 'before' or 'after'")
    totals = running_totals(
        bouts, stats, TOTAL_COLUMNS, rows_per_slot, before=as_of == "before"
    )
    rows = bouts.select(
        "bout_id",
        "bout_date",
        "r_id",
        "b_id",
        "weight",
        "win_method",
        american_odds("r_odds").alias("r_odds"),
        american_odds("b_odds").alias("b_odds"),
        label_of("winner", "r_name", "b_name").alias("winner"),
    ).join(pair_up(totals, TOTAL_COLUMNS), "bout_id")
    wide = attach_competitors(rows, competitors, "bout_date", "bout_id")
    return wide.select(
        "bout_id", "bout_date", "win_method", *FEATURES, "winner", "r_odds", "b_odds"
    )


def no_draws(dataset: DataFrame) -> DataFrame:
    return dataset.filter(F.col("winner") != "DRAW")


def no_overturned(dataset: DataFrame) -> DataFrame:
    return dataset.filter(~F.coalesce(F.col("win_method").contains("Overturned"), F.lit(False)))


def with_odds(dataset: DataFrame) -> DataFrame:
    return dataset.filter(F.col("r_odds").isNotNull() & F.col("b_odds").isNotNull())


def all_bouts(dataset: DataFrame) -> DataFrame:
    return dataset


VARIANTS = {
    "no_draws": no_draws,
    "no_overturned": no_overturned,
    "with_odds": with_odds,
    "all_bouts": all_bouts,
}


def dummy_name(column: str, value: str) -> str:
    return f"{column}_{value.replace(' ', '_')}"


def one_hot_columns(column: str) -> dict[str, Column]:
    """A 0/1 column per value of the fixed vocabulary; NULL gives zeros everywhere."""
    return {
        dummy_name(column, v): F.coalesce((F.col(column) == v).cast("int"), F.lit(0))
        for v in VOCABULARY[column]
    }


NUMERIC_FEATURES = [c for c in FEATURES if c not in TEXT_FEATURES]
MODEL_COLUMNS = NUMERIC_FEATURES + [
    dummy_name(c, v) for c in TEXT_FEATURES for v in VOCABULARY[c]
]


def one_hot(frame: DataFrame, columns: Sequence[str] = TEXT_FEATURES) -> DataFrame:
    dummies = {}
    for c in columns:
        dummies |= one_hot_columns(c)
    return frame.withColumns(dummies).drop(*columns)


def align_dummies(frame: DataFrame, expected: Sequence[str] = tuple(MODEL_COLUMNS)) -> DataFrame:
    """The model's columns in the model's order, whichever dummies the input has."""
    return frame.select(
        *[F.col(c) if c in frame.columns else F.lit(0).alias(c) for c in expected]
    )


def encode_label(frame: DataFrame, column: str = "winner") -> DataFrame:
    return frame.withColumn("label", label_number(column))


def cut_date(dataset: DataFrame, day: str, share: float) -> DataFrame:
    """The first day on which at least ``share`` of the rows have happened.

    Counts rows per day first, so what is ordered is one small row per day.
    """
    per_day = dataset.filter(F.col(day).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.orderBy(day))
    everything = F.sum("n").over(Window.partitionBy())
    reached = per_day.select(day, so_far.alias("so_far"), everything.alias("total"))
    return reached.filter(F.col("so_far") >= F.lit(share) * F.col("total")).agg(F.min(day))


def split_ordered(
    dataset: DataFrame, day: str = "bout_date", share: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """The first days with ``share`` of the rows to train on, the later days to test on."""
    cut = cut_date(dataset, day, share).scalar()
    return dataset.filter(F.col(day) <= cut), dataset.filter(F.col(day) > cut)


def is_test_row(key: str, seed: int = 0, parts: int = 4) -> Column:
    """A quarter of the rows, chosen by a hash of the row's id: the same on every run."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % parts == 0


def split_random(dataset: DataFrame, key: str = "bout_id", seed: int = 0):
    test = is_test_row(key, seed)
    return dataset.filter(~test), dataset.filter(test)


def column_mean_std(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of the columns: one row of two arrays.

    The columns travel as one vector through one aggregate, not as hundreds of SQL aggregates.
    A column with NULLs has no mean, as a NaN would have none.
    """
    vectors = VectorAssembler(
        inputCols=list(columns), outputCol="_vector", handleInvalid="keep"
    ).transform(frame.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    found = vectors.agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_vector")).alias("s")
    ).select(
        vector_to_array("s.mean").alias("means"),
        vector_to_array("s.variance").alias("variances"),
        F.col("s.count").alias("n"),
    )
    # The summary divides by n - 1.
    return found.selectExpr("means", "transform(variances, v -> sqrt(v * (n - 1) / n)) AS stds")


def mean_std_rows(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same, one row per column."""
    names = F.array(*[F.lit(c) for c in columns]).alias("feature")
    return column_mean_std(frame, columns).select(
        F.inline(F.arrays_zip(names, F.col("means").alias("mean"), F.col("stds").alias("std")))
    ).toDF("feature", "mean", "std")


def standardize(train: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the training mean, divide by the training deviation; a constant column becomes 0.

    The statistics are a single row, fetched once as a scalar subquery.
    """
    fitted = column_mean_std(train, columns).selectExpr("struct(*) AS s").scalar()
    staged = rows.withColumn("_s", fitted)
    scaled = {
        c: f"if(_s.stds[{i}] = 0, if({c} IS NULL, NULL, 0D), try_divide({c} - _s.means[{i}], _s.stds[{i}])) AS {c}"
        for i, c in enumerate(columns)
    }
    return staged.selectExpr(*[scaled.get(c, c) for c in rows.columns])


def upcoming_pairs(
    card: DataFrame, competitors: DataFrame, newest: DataFrame, key: str = "card_id"
) -> DataFrame:
    """Card rows with ids and the ids of the newest totals, NULL where unknown."""
    found = resolve_names(card, competitors, key)
    for side in CORNERS:
        one = newest.selectExpr(f"competitor_id AS {side}_id", f"totals_id AS {side}_totals_id")
        found = lookup(found, one, [f"{side}_id"], [key])
    return found


_KNOWN = " AND ".join(f"{side}_{c} IS NOT NULL" for side in CORNERS for c in ("id", "totals_id"))


def predictable_only(pairs: DataFrame) -> DataFrame:
    """Bouts whose competitors are both known and have both fought before."""
    return pairs.filter(_KNOWN)


def not_predictable(pairs: DataFrame) -> DataFrame:
    return pairs.filter(f"NOT ({_KNOWN})")


def upcoming_features(
    card: DataFrame, day: Column, competitors: DataFrame, newest: DataFrame
) -> DataFrame:
    """The model's columns for a card that has not been fought: newest totals, weight from class."""
    pairs = predictable_only(upcoming_pairs(card, competitors, newest)).select(
        "card_id",
        "r_name",
        "b_name",
        "r_id",
        "b_id",
        "r_totals_id",
        "b_totals_id",
        pounds(class_name("weight_class")).alias("weight"),
        day.alias("bout_date"),
    )
    return matchup_join(pairs, newest, competitors, "card_id").select(
        "card_id", "r_name", "b_name", *FEATURES
    )

