import datetime
import os
import random
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from boutlab.plans import boosting, models, refresh, trees
from boutlab.sources import tables
from checks import queries


@pytest.fixture(scope="module")
def drawn(spark):
    """Rows of three classes without equal gains: no two columns part them alike."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6))
    x[:, 5] = np.round(x[:, 5])
    score = x[:, 0] + x[:, 1] ** 2 / 2 - x[:, 5] + rng.normal(size=3000)
    rows = [(i, a.tolist(), float((s > 0) + (s > 1))) for i, (a, s) in enumerate(zip(x, score, strict=True))]
    frame = spark.createDataFrame(rows, "id int, x array<double>, label double").repartition(5)
    return tables.stage(frame.withColumn("features", array_to_vector("x")), "drawn")


def two(drawn):
    return drawn.withColumn("label", (F.col("label") > 0).cast("double"))


def test_two_class_trees_are_those_of_spark(drawn):
    rows = two(drawn)
    theirs = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.2, seed=0).fit(rows)
    mine = boosting.fit_two_class_trees(trees.binned(rows, 2), [], maxIter=12, maxDepth=3, stepSize=0.2)
    both = theirs.transform(rows).select("id", vector_to_array("probability").alias("p"), F.col("prediction").alias("q"))
    found = mine.transform(rows).select("id", "_probabilities", "prediction").join(both, "id").collect()
    assert len(found) == 3000 and all(r["prediction"] == r["q"] for r in found)
    assert all(r["_probabilities"] == pytest.approx(r["p"], abs=1e-9) for r in found)


@pytest.mark.parametrize("classes", [2, 3])
def test_a_job_per_level_grows_the_same_trees(drawn, monkeypatch, classes):
    """Margins are stored every second round here, and only the last of them stay until the end."""
    rows = drawn if classes == 3 else two(drawn)
    removed = []

    def fitted():
        if classes == 3:
            return boosting.fit_softmax_trees(rows, [], 3, maxIter=5, maxDepth=3, stepSize=0.3)
        return boosting.fit_two_class_trees(trees.binned(rows, 2), [], maxIter=5, maxDepth=3, stepSize=0.3)

    alone = fitted()
    monkeypatch.setattr(trees, "ALONE", 0)
    monkeypatch.setattr(trees, "ROUNDS", 2)
    monkeypatch.setattr(trees, "remove", lambda spark, path: removed.append(path) or tables.remove(spark, path))
    spread = fitted()
    first, second = ({r["id"]: r for r in m.transform(rows).select("id", "_leaves", "_sums").collect()} for m in (alone, spread))
    for i, r in first.items():
        assert r["_leaves"] == second[i]["_leaves"]
        assert r["_sums"] == pytest.approx(second[i]["_sums"])
    assert len(removed) == 2 and not any(os.path.exists(p.removeprefix("file:")) for p in removed)


def test_limits_come_from_all_rows():
    """Few values are all parted; of many, bins hold about as many rows, also after counts were put together."""
    assert trees.thresholds_of(np.array([1.0, 2, 5]), np.array([4, 1, 1])).tolist() == [1.5, 3.5]
    assert trees.thresholds_of(np.array([7.0]), np.array([9])).tolist() == []
    rng, seen = random.Random(1), []
    values, counts = np.empty(0), np.empty(0)
    for _ in range(40):
        some = np.array([rng.gauss(0, 1) for _ in range(1000)])
        seen.append(some)
        values, counts = trees.merged(np.append(values, some), np.append(counts, np.ones(1000)), counted=2000, kept=1000)
    assert counts.sum() == 40_000 and len(values) <= 2000
    limits = trees.thresholds_of(values, counts)
    held = np.bincount(np.searchsorted(limits, np.concatenate(seen)))
    assert len(held) == 32 and held.min() > 1100 and held.max() < 1400


def test_rows_without_telling_columns_get_the_mean(spark, monkeypatch):
    rows = spark.createDataFrame([([1.0], float(i % 4 == 0)) for i in range(40)], "x array<double>, label double")
    rows = rows.withColumn("features", array_to_vector("x"))
    for alone in (1000, 0):
        monkeypatch.setattr(trees, "ALONE", alone)
        model = boosting.fit_two_class_trees(trees.binned(rows, 2), [], maxIter=1, maxDepth=2)
        assert [r["_sums"] for r in model.transform(rows).select("_sums").distinct().collect()] == [[-0.5]]
    with pytest.raises(ValueError, match="labels are 0 to 1"):
        trees.binned(rows.withColumn("label", F.lit(2.0)), 2)
    with pytest.raises(ValueError, match="no rows"):
        trees.binned(rows.limit(0), 2)


def bare(name):
    return queries.QUERIES[name].__wrapped__


def test_searches_train_all_rounds(monkeypatch):
    """The settings of the library: 1,000 rounds, for three depths in the grid."""
    seen = []

    def fold_accuracies(train, depths, folds, parallelism, **settings):
        seen.append((list(depths), folds, models.GBT | settings))
        raise InterruptedError

    monkeypatch.setattr(models, "_fold_accuracies", fold_accuracies)
    monkeypatch.setattr(queries, "_train", lambda g: None)
    for name in ("cross_val_score", "grid_search"):
        with pytest.raises(InterruptedError):
            bare(name)(None)
    assert seen == [([3], 5, models.GBT), ([3, 8, 10], 5, models.GBT)] and models.GBT["maxIter"] == 1000


def test_three_class_query_trains_all_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "_stored_dataset", lambda g: spark.range(1).selectExpr("id AS bout_id", "'Red' AS winner"))
    monkeypatch.setattr(models, "labelled", lambda rows: rows)
    monkeypatch.setattr(models, "fit_softmax_trees", lambda *a, **settings: asked.append(settings))
    g = MagicMock(spark=spark, folder="whole rounds")
    queries._fitted(g, "softmax")
    assert [(s["maxIter"], s["maxDepth"]) for s in asked] == [(100, 8)]


def test_full_refresh_query_leaves_models_their_settings(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(refresh, "full_refresh", lambda *a, **settings: asked.append(settings) or MagicMock())
    monkeypatch.setattr(queries.fx, "last_day", lambda bouts: F.lit(datetime.date(2024, 1, 30)))
    for name in ("bout_pages", "event_pages", "listing_pages", "linked_bouts", "aliases"):
        monkeypatch.setattr(queries.fx, name, MagicMock())
    monkeypatch.setattr(tables, "stage", MagicMock())
    monkeypatch.setattr(queries.evaluate, "model_comparison", MagicMock())
    bare("full_refresh")(MagicMock(spark=spark))
    assert asked == [{}]


def test_grid_is_as_good_as_its_folds_say(spark, drawn, monkeypatch):
    """Accuracy of every fold is that of trees fitted on the others; a depth alone has the same mean."""
    rows = two(drawn).withColumnRenamed("id", "bout_id")
    monkeypatch.setattr(models, "prepare_gbt", lambda train: (trees.binned(train, 2), []))
    settings = {"maxIter": 3, "stepSize": 0.3}
    best, table = models.grid_search(rows, depths=(1, 4), folds=3, **settings)
    found = {r["max_depth"]: r["mean_accuracy"] for r in table.collect()}
    dealt, shares = models.with_folds(rows, folds=3), []
    for fold in range(3):
        model = boosting.fit_two_class_trees(trees.binned(dealt.filter(F.col("fold") != fold), 2), [], maxDepth=4, **settings)
        measured = model.transform(dealt.filter(F.col("fold") == fold)).select("label", "prediction").collect()
        shares.append(sum(r["label"] == r["prediction"] for r in measured) / len(measured))
    assert found[4] == pytest.approx(sum(shares) / 3) and found[4] > found[1]
    alone = models.cross_val_score(rows, folds=3, maxDepth=4, **settings).first()["mean_accuracy"]
    assert alone == pytest.approx(found[4])
    assert best.stages[0].getOrDefault("classes") == 1
    with pytest.raises(ValueError, match="fold 0 is empty|fold 1 is empty"):
        models.grid_search(rows.filter("bout_id = 1"), depths=(1,), folds=2, **settings)
