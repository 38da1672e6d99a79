"""Weak supervision: labelers vote or abstain, expectation-maximisation learns how reliable each is.

Votes are integer columns: 1 for, -1 against, 0 abstains. Only the counts of the distinct vote
patterns reach the driver, at most 3 to the power of the number of labelers, however many rows voted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABELERS = 10


@dataclass(frozen=True)
class LabelModel:
    """Share of true rows, and for each labeler how often it votes for and against, among true and
    false rows. Both rates count all rows of the class, so a labeler may vote one way only."""

    labelers: tuple[str, ...]
    prior: float
    true_rates: tuple[tuple[float, float], ...]
    false_rates: tuple[tuple[float, float], ...]

    def weights(self) -> list[tuple[float, float]]:
        """What a vote for and a vote against add to the log odds; an abstention adds nothing."""
        return [
            (math.log(t[0] / f[0]), math.log(t[1] / f[1]))
            for t, f in zip(self.true_rates, self.false_rates, strict=True)
        ]

    def posterior(self) -> Column:
        """Probability that a row is true, given its votes."""
        total = F.lit(_log_odds(self.prior))
        for name, (plus, minus) in zip(self.labelers, self.weights(), strict=True):
            vote = F.col(name)
            total = total + F.when(vote > 0, plus).when(vote < 0, minus).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def fit_label_model(
    votes: DataFrame,
    labelers: Sequence[str],
    prior: float,
    accuracy: float = 0.9,
    rounds: int = 50,
    weight: str | None = None,
) -> LabelModel:
    """Estimate the model by expectation-maximisation, starting from ``prior`` and ``accuracy``.

    ``weight`` names a column that says how many rows a row stands for.

    A vote never counts for the opposite of what it says, so that the two classes cannot swap places.
    100 rows at the starting rates are added to the counts, so that a table of few rows stays near
    them; one without rows leaves them as they are.
    """
    if len(labelers) > MOST_LABELERS:
        raise ValueError(f"more than {MOST_LABELERS} labelers: too many vote patterns")
    patterns = [
        (tuple(r[name] for name in labelers), r["_rows"])
        for r in votes.groupBy(*labelers).agg(F.sum(weight or F.lit(1)).alias("_rows")).collect()
    ]
    start = ((accuracy / 2, (1 - accuracy) / 2), ((1 - accuracy) / 2, accuracy / 2))
    model = LabelModel(
        tuple(labelers), prior, (start[0],) * len(labelers), (start[1],) * len(labelers)
    )
    for _ in range(rounds):
        model = _step(model, patterns, prior, start)
    return model


def _step(model: LabelModel, patterns, prior: float, start) -> LabelModel:
    added, weights = 100.0, model.weights()
    mass = [added * (1 - prior), added * prior]
    voted = [[[x * m for x in rates] for rates, m in ((start[1], mass[0]), (start[0], mass[1]))] for _ in weights]
    for votes, rows in patterns:
        odds = _log_odds(model.prior)
        for v, (plus, minus) in zip(votes, weights, strict=True):
            odds += plus if v > 0 else minus if v < 0 else 0.0
        p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        for truth, share in ((0, (1 - p) * rows), (1, p * rows)):
            mass[truth] += share
            for j, v in enumerate(votes):
                if v:
                    voted[j][truth][0 if v > 0 else 1] += share
    rates = [[[_within(x / m, 0.001, 0.999) for x in one] for one, m in zip(j, mass, strict=True)] for j in voted]
    # rates[j][truth] = (for, against): equal where the data say the opposite of the vote.
    trues = tuple((max(t[0], f[0]), min(t[1], f[1])) for f, t in rates)
    return LabelModel(
        model.labelers, _within(mass[1] / sum(mass), 0.02, 0.98), trues, tuple((f[0], f[1]) for f, _ in rates)
    )


def _within(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))
