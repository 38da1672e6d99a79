"""Boosted trees for two classes and for several at once.

Several classes: every round fits one regression tree per class on what is left of the label after the class's
probability, all classes sharing one softmax; the leaves then take a Newton step on the shared loss. A finished
model is one stage of trees and one of SQL, so it saves, loads and scores like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame

from boutlab.plans.trees import Binned, Softmax, TwoClasses, binned, fit


def softmax(margins: str) -> str:
    """Shares that add up to one, as SQL over an array column."""
    raised = f"transform({margins}, m -> exp(m - array_max({margins})))"
    return f"transform({raised}, e -> e / aggregate({raised}, 0D, (a, x) -> a + x))"


def log_priors(rows: DataFrame, classes: int) -> list[float]:
    """Logarithms of the class shares, the margins before the first tree."""
    counts = dict.fromkeys(range(classes), 0)
    counts |= {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    return [math.log(max(counts[c], 1e-9) / total) if total else 0.0 for c in range(classes)]


def leaf_value(residual: float, curvature: float, classes: int) -> float:
    """The Newton step of one leaf: a class's summed residuals over their summed curvature."""
    if abs(curvature) < 1e-150:
        return 0.0
    return (classes - 1) / classes * residual / curvature


def fit_softmax_trees(
    train: DataFrame,
    before: Sequence,
    classes: int = 3,
    maxIter: int = 100,
    maxDepth: int = 8,
    stepSize: float = 0.01,
    seed: int = 0,
    checkpoint_every: int = 10,
) -> PipelineModel:
    """A model behind the stages ``before``, which make ``features``; ``label`` counts from 0.

    All columns are asked at every split and no rows are left out, so nothing is drawn by ``seed``. Margins are
    stored as ``trees`` says; ``checkpoint_every`` is not needed any more.
    """
    prepared = Pipeline(stages=list(before)).fit(train)
    rows = prepared.transform(train).select("features", "label")
    priors = log_priors(rows, classes)
    layers = fit(binned(rows, classes), Softmax(stepSize, tuple(priors), leaf_value), maxIter, maxDepth)
    return PipelineModel(stages=[*prepared.stages, layers, _softmax_stage(priors, maxIter)])


def fit_two_class_trees(data: Binned, before: Sequence, maxIter: int = 100, maxDepth: int = 5, stepSize: float = 0.1, seed: int = 0) -> PipelineModel:
    """Boosted trees for labels 0 and 1 behind the stages ``before``; see ``fit_softmax_trees`` for ``seed``."""
    layers = fit(data, TwoClasses(stepSize), maxIter, maxDepth)
    return PipelineModel(stages=[*before, layers, _two_class_stage()])


def _two_class_stage() -> SQLTransformer:
    """Probabilities and prediction from the sum of all trees, half the logarithm of the odds."""
    share = "1D / (1D + exp(2D * _sums[0]))"
    return SQLTransformer(
        statement=f"SELECT *, CAST(_sums[0] > 0 AS DOUBLE) AS prediction, array({share}, 1D - {share}) AS _probabilities FROM __THIS__"
    )


def _softmax_stage(priors: Sequence[float], rounds: int) -> SQLTransformer:
    """Margins, probabilities, prediction and the leaf of every tree."""
    classes = range(len(priors))
    margins = ", ".join(f"{priors[k]!r}D + _sums[{k}]" for k in classes)
    leaves = ", ".join(f"_leaves[{turn * len(priors) + k}] AS _leaf_{turn}_{k}" for turn in range(rounds) for k in classes)
    return SQLTransformer(
        statement=f"""SELECT *, CAST(array_position(_probabilities, array_max(_probabilities)) - 1 AS DOUBLE) AS prediction, {leaves}
        FROM (SELECT *, {softmax('_margins')} AS _probabilities FROM (SELECT *, array({margins}) AS _margins FROM __THIS__))"""
    )
