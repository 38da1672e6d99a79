"""Classifiers on wide rows, trained and applied by Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlab.functions.text import label_number
from boutlab.operators.features import (
    MODEL_COLUMNS,
    NUMERIC_FEATURES,
    column_mean_std,
    dummy_name,
)
from boutlab.plans.boosting import fit_softmax_trees, fit_two_class_trees
from boutlab.plans.network import fit_network, network_rows
from boutlab.plans.trees import Binned, binned
from boutlab.schema import LABELS, TEXT_FEATURES, VOCABULARY
from boutlab.session import ensure_checkpoints
from boutlab.sources.tables import stage

# The settings stated as best.
GBT = {"maxIter": 1000, "maxDepth": 3, "stepSize": 0.01, "seed": 0}
FOREST = {"numTrees": 100, "maxDepth": 10, "seed": 0}
MLP = {"maxIter": 28, "hidden": [8], "seed": 0}
SOFTMAX = {"maxIter": 100, "maxDepth": 8, "stepSize": 0.01, "seed": 0}
NETWORK = {"maxIter": 28, "hidden": (8,), "alpha": 0.1, "seed": 0}
GRID_DEPTHS = (3, 8, 10)
NETWORK_GRID = {"maxIter": (100, 1000, 2000), "hidden": ((10, 10), (100,), (100, 100)), "alpha": (0.0001, 0.001, 0.1, 1.0)}
FOLDS = 5
SCALED_COLUMNS = [f"_z_{c}" for c in MODEL_COLUMNS]


def labelled(dataset: DataFrame) -> DataFrame:
    """Rows a model can learn from: a known winner, as a number, and every numeric column known."""
    return dataset.withColumn("label", label_number("winner").cast("double")).dropna(
        subset=["label", *NUMERIC_FEATURES]
    )


def unlabelled(dataset: DataFrame) -> DataFrame:
    """The rows ``labelled`` leaves out: no known winner, or a numeric column that is unknown."""
    known = label_number("winner").isNotNull()
    for c in NUMERIC_FEATURES:
        known = known & F.col(c).isNotNull()
    return dataset.filter(~known)


def dummy_stage() -> SQLTransformer:
    """Indicator columns from the fixed vocabulary; saved with the model, so scoring uses the same."""
    dummies = [
        f"CAST({c} <=> '{v}' AS INT) AS {dummy_name(c, v)}"
        for c in TEXT_FEATURES
        for v in VOCABULARY[c]
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(dummies)} FROM __THIS__")


def scaling_stage(train: DataFrame) -> SQLTransformer:
    """(x - mean) / population deviation of the training rows; a constant column becomes 0.

    Fetches one row of two numbers per model column.
    """
    fitted = column_mean_std(dummy_stage().transform(train), MODEL_COLUMNS).first()
    found = {c: pair for c, *pair in zip(MODEL_COLUMNS, fitted["means"], fitted["stds"])}

    def scaled(c):
        mean, std = found[c]
        return f"({c} - {mean!r}D) / {std!r}D AS _z_{c}" if std else f"0D AS _z_{c}"

    columns = ", ".join(scaled(c) for c in MODEL_COLUMNS)
    return SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")


def _vector_stage(prefix: str = "") -> VectorAssembler:
    return VectorAssembler(inputCols=[prefix + c for c in MODEL_COLUMNS], outputCol="features")


def gbt_pipeline(**settings) -> Pipeline:
    return Pipeline(stages=[dummy_stage(), _vector_stage(), GBTClassifier(**(GBT | settings))])


def train_gbt(train: DataFrame, **settings) -> PipelineModel:
    """Boosted trees for Red against Blue."""
    ensure_checkpoints(train.sparkSession)
    return gbt_pipeline(**settings).fit(train)


def prepare_gbt(train: DataFrame) -> tuple[Binned, list]:
    """Stored bins of boosted trees on these rows, and the stages that make their columns."""
    before = [dummy_stage(), _vector_stage()]
    return binned(PipelineModel(stages=before).transform(train).select("features", "label"), 2), before


def fit_prepared_gbt(prepared: tuple[Binned, list], **settings) -> PipelineModel:
    """The trees of ``train_gbt``, but for splits of equal gain, without a job per level where rows are few."""
    rows, before = prepared
    return fit_two_class_trees(rows, before, **(GBT | settings))


def train_gbt_multiclass(train: DataFrame, **settings) -> PipelineModel:
    """Boosted trees with a DRAW class: one tree per class and round on a shared softmax."""
    return fit_softmax_trees(train, [dummy_stage(), _vector_stage()], len(LABELS), **(SOFTMAX | settings))


def prepare_network(train: DataFrame) -> tuple[DataFrame, list]:
    """Stored inputs of networks on these rows, standardised, and the stages that make them."""
    before = [dummy_stage(), scaling_stage(train)]
    return network_rows(train, before, SCALED_COLUMNS), before


def fit_prepared_network(prepared: tuple[DataFrame, list], classes: int = 2, **settings) -> PipelineModel:
    rows, before = prepared
    return fit_network(rows, before, SCALED_COLUMNS, classes, **(NETWORK | settings))


def train_network(train: DataFrame, classes: int = 2, **settings) -> PipelineModel:
    """A network with an L2 penalty ``alpha`` on standardised columns; the scaling travels with the model."""
    return fit_prepared_network(prepare_network(train), classes, **settings)


def train_gbt_one_against_rest(train: DataFrame, **settings) -> PipelineModel:
    """One binary model per class, kept in one pipeline."""
    ensure_checkpoints(train.sparkSession)
    stages = [dummy_stage(), _vector_stage()]
    rows = train
    for c in range(len(LABELS)):
        rows = rows.withColumn(f"_is_{c}", (F.col("label") == c).cast("double"))
        one = GBTClassifier(
            labelCol=f"_is_{c}", predictionCol=f"_prediction_{c}", **(GBT | settings)
        )
        stages.append(one.setProbabilityCol(f"_probability_{c}").setRawPredictionCol(f"_raw_{c}"))
    return Pipeline(stages=stages).fit(rows)


def train_random_forest(train: DataFrame, **settings) -> PipelineModel:
    ensure_checkpoints(train.sparkSession)
    forest = RandomForestClassifier(**(FOREST | settings))
    return Pipeline(stages=[dummy_stage(), _vector_stage(), forest]).fit(train)


def train_mlp(train: DataFrame, classes: int = 2, **settings) -> PipelineModel:
    """One hidden layer on standardised columns; the scaling travels with the model."""
    settings = MLP | settings
    layers = [len(MODEL_COLUMNS), *settings.pop("hidden"), classes]
    net = MultilayerPerceptronClassifier(layers=layers, solver="l-bfgs", **settings)
    stages = [dummy_stage(), scaling_stage(train), _vector_stage("_z_"), net]
    return Pipeline(stages=stages).fit(train)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``prediction``, ``probabilities`` (one per class) and ``confidence``."""
    scored = model.transform(rows)
    if "_probabilities" in scored.columns:
        scored = scored.withColumn("probabilities", F.col("_probabilities"))
    elif "prediction" in scored.columns:
        scored = scored.withColumn("probabilities", vector_to_array("probability"))
    else:
        shares = F.array(
            *[vector_to_array(f"_probability_{c}")[1] for c in range(len(LABELS))]
        )
        scored = scored.withColumn("_shares", shares).withColumn(
            "probabilities",
            F.expr("transform(_shares, s -> s / aggregate(_shares, 0D, (a, x) -> a + x))"),
        )
        best = F.array_position("probabilities", F.array_max("probabilities")) - 1
        scored = scored.withColumn("prediction", best.cast("double"))
    return scored.withColumn("confidence", F.array_max("probabilities")).select(
        *rows.columns, "prediction", "probabilities", "confidence"
    )


def name_winners(scored: DataFrame) -> DataFrame:
    """The predicted winner's name on the row it was predicted for."""
    winner = (
        F.when(F.col("prediction") == 0, F.col("r_name"))
        .when(F.col("prediction") == 1, F.col("b_name"))
        .otherwise(LABELS[2])
    )
    return scored.select("card_id", "r_name", "b_name", winner.alias("winner"), "confidence")


def predict_upcoming(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Picks for the bouts of a card whose numeric columns are all known.

    A weight class without pounds, say, leaves a bout that no model can place.
    """
    return name_winners(score(model, features.dropna(subset=NUMERIC_FEATURES)))


def not_placed(features: DataFrame) -> DataFrame:
    """The bouts of a card that ``predict_upcoming`` leaves out, as some numeric column is unknown."""
    known = F.lit(True)
    for c in NUMERIC_FEATURES:
        known = known & F.col(c).isNotNull()
    return features.filter(~known)


def with_folds(train: DataFrame, key: str = "bout_id", folds: int = FOLDS) -> DataFrame:
    """Fold numbers from a hash of the row id, so a recomputed task puts a row in the same fold."""
    return train.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))


def _fold_accuracies(train: DataFrame, depths: Sequence[int], folds: int, parallelism: int, **settings) -> list[list[float]]:
    """Per depth the accuracy of every fold; rows are put into bins once per fold, and several depths fitted at once."""
    dealt = stage(with_folds(train, folds=folds), "folds")
    found = [[] for _ in depths]

    def accuracy(prepared, measured, depth) -> float:
        scored = score(fit_prepared_gbt(prepared, **settings, maxDepth=int(depth)), measured)
        return scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]

    with ThreadPoolExecutor(parallelism) as pool:
        waiting = []
        for fold in range(folds):
            measured, learnt = dealt.filter(F.col("fold") == fold), dealt.filter(F.col("fold") != fold).drop("fold")
            for rows, name in ((learnt, "train"), (measured, "validation")):
                if rows.isEmpty():
                    raise ValueError(f"The {name} data at fold {fold} is empty.")
            prepared = prepare_gbt(learnt)
            waiting.append([pool.submit(accuracy, prepared, measured, depth) for depth in depths])
        for one in waiting:
            for shares, future in zip(found, one, strict=True):
                shares.append(future.result())
    return found


def grid_search(
    train: DataFrame,
    depths: Sequence[int] = GRID_DEPTHS,
    folds: int = FOLDS,
    parallelism: int = 4,
    **settings,
) -> tuple[PipelineModel, DataFrame]:
    """Best model over tree depths, and the mean accuracy of every depth."""
    settings.pop("maxDepth", None)
    means = [sum(one) / len(one) for one in _fold_accuracies(train, depths, folds, parallelism, **settings)]
    rows = [(int(d), float(m)) for d, m in zip(depths, means, strict=True)]
    table = train.sparkSession.createDataFrame(rows, "max_depth int, mean_accuracy double")
    best = max(range(len(means)), key=lambda i: means[i])
    return fit_prepared_gbt(prepare_gbt(train), **settings, maxDepth=int(depths[best])), table


@dataclass(frozen=True)
class Search:
    """``table``: per point its settings, the accuracy in every fold, their mean, and why it failed if so."""

    best: PipelineModel | None
    table: DataFrame


def search(
    train: DataFrame,
    fit: Callable[..., PipelineModel],
    grid: dict[str, Sequence],
    folds: int = FOLDS,
    key: str = "bout_id",
    prepare: Callable[[DataFrame], object] | None = None,
    **fixed,
) -> Search:
    """Cross-validate every point of a grid of several settings, and fit the best on all rows.

    ``fit`` prepares its columns on the rows it is given, so a fold's scaling never sees the rows it is
    measured on. What all points share can be left to ``prepare``: it is given the rows once per fold, and
    ``fit`` what it makes of them. Folds come from a hash of the row's id and are the same for every point. A
    point that fails is reported with its error and never chosen. Points are few; each is a job over all rows.
    """
    spark = train.sparkSession
    prepare = prepare or (lambda rows: rows)
    dealt = stage(with_folds(train, key, folds), "folds")
    points = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    shares, errors = [[] for _ in points], [None] * len(points)
    expected = (PySparkException, ValueError, ArithmeticError)
    for fold in range(folds):
        left, measured = [i for i, error in enumerate(errors) if error is None], dealt.filter(F.col("fold") == fold)
        try:
            ready = prepare(dealt.filter(F.col("fold") != fold).drop("fold")) if left else None
        except expected as failed:
            for i in left:
                errors[i] = str(failed).splitlines()[0]
            break
        for i in left:
            try:
                scored = score(fit(ready, **fixed, **points[i]), measured)
                shares[i].append(scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
            except expected as failed:
                errors[i] = str(failed).splitlines()[0]
    found = []
    for settings, accuracy, error in zip(points, shares, errors, strict=True):
        known = [s for s in accuracy if s is not None]
        found.append((json.dumps(settings), accuracy, sum(known) / len(known) if known and error is None else None, error))
    schema = "settings string, fold_accuracy array<double>, mean_accuracy double, error string"
    table = spark.createDataFrame(found, schema)
    ranked = [(f[2], -i) for i, f in enumerate(found) if f[2] is not None]
    if not ranked:
        return Search(None, table)
    chosen = json.loads(found[-max(ranked)[1]][0])
    return Search(fit(prepare(train), **fixed, **chosen), table)


def grid_search_network(train: DataFrame, grid: dict[str, Sequence] = NETWORK_GRID, folds: int = FOLDS, **fixed) -> Search:
    """The search over networks: iterations, hidden layers and penalties; rows are scaled once per fold."""
    return search(train, fit_prepared_network, grid, folds, prepare=prepare_network, **fixed)


def cross_val_score(
    train: DataFrame, folds: int = FOLDS, parallelism: int = 4, **settings
) -> DataFrame:
    """Mean accuracy over the folds."""
    depth = settings.pop("maxDepth", GBT["maxDepth"])
    (shares,) = _fold_accuracies(train, [depth], folds, parallelism, **settings)
    return train.sparkSession.createDataFrame([(sum(shares) / len(shares),)], "mean_accuracy double")


def importances(model: PipelineModel) -> DataFrame:
    """Importance of every model column."""
    spark = SparkSession.active()
    values = next(s for s in reversed(model.stages) if hasattr(s, "featureImportances")).featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(MODEL_COLUMNS, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_importances(model: PipelineModel, n: int = 10) -> DataFrame:
    return importances(model).orderBy(F.desc("importance"), "feature").limit(n)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
