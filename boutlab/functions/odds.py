"""What a one-unit bet returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payout(odds: Column) -> Column:
    """Units won on a correct pick at American odds."""
    odds = odds.cast("double")
    return F.when(odds > 0, odds / 100).otherwise(F.abs(F.try_divide(F.lit(100.0), odds)))


def units(label: Column, prediction: Column, r_odds: Column, b_odds: Column) -> Column:
    """Gain of one bet: the payout when right (0 for a draw), -1 when wrong.

    NULL where there was no bet: no known result or pick, or no odds for the corner picked.
    """
    won = F.when(prediction == 0, payout(r_odds)).when(prediction == 1, payout(b_odds)).otherwise(F.lit(0.0))
    return F.when(label.isNull() | prediction.isNull() | won.isNull(), None).otherwise(
        F.when(label == prediction, won).otherwise(F.lit(-1.0))
    )
