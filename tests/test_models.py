import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlab.operators.features import NUMERIC_FEATURES
from boutlab.plans import models, network
from boutlab.session import scratch_path
from boutlab.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    """Rows whose winner follows from one column; every other numeric column is constant."""
    rng = random.Random(5)
    drawn = [(i, rng.randrange(100), rng.choice(["male", "female"])) for i in range(240)]
    frame = spark.createDataFrame(drawn, "bout_id long, r_wins long, gender string")
    others = {c: F.lit(1) for c in NUMERIC_FEATURES if c != "r_wins"}
    others |= {"r_stance": F.lit("Switch"), "b_stance": F.lit(None).cast("string")}
    winner = F.when(F.col("r_wins") >= 60, "Red").when(F.col("r_wins") >= 20, "Blue").otherwise("DRAW")
    built = frame.withColumns(others | {"winner": winner, "r_name": F.lit("Ann"), "b_name": F.lit("Bea")})
    return tables.stage(models.labelled(built), "model_rows")


def check(scored, classes, floor):
    found = scored.collect()
    assert all(len(r["probabilities"]) == classes for r in found)
    assert all(sum(r["probabilities"]) == pytest.approx(1) for r in found)
    assert all(r["confidence"] == max(r["probabilities"]) for r in found)
    assert sum(r["label"] == r["prediction"] for r in found) / len(found) > floor


def test_boosted_trees_learn_save_and_load(spark, rows):
    two = rows.filter("winner <> 'DRAW'")
    model = models.train_gbt(two, maxIter=3, stepSize=0.3)
    check(models.score(model, two), 2, 0.95)
    path = scratch_path(spark, "model")
    models.save_model(model, path)
    again = models.score(models.load_model(path), two)
    assert again.exceptAll(models.score(model, two)).isEmpty()
    top = models.top_importances(model, 3).collect()
    assert top[0]["feature"] == "r_wins" and len(top) == 3


def _log_loss(model, rows):
    share = F.get("probabilities", F.col("label").cast("int"))
    return models.score(model, rows).agg(-F.avg(F.log(F.greatest(share, F.lit(1e-15))))).first()[0]


def test_softmax_trees_beat_one_against_the_rest(spark, rows):
    settings = {"maxIter": 12, "maxDepth": 2, "stepSize": 0.3}
    model = models.train_gbt_multiclass(rows, checkpoint_every=5, **settings)
    check(models.score(model, rows), 3, 0.95)
    assert _log_loss(model, rows) < _log_loss(models.train_gbt_one_against_rest(rows, **settings), rows)
    path = scratch_path(spark, "softmax")
    models.save_model(model, path)
    assert models.score(models.load_model(path), rows).exceptAll(models.score(model, rows)).isEmpty()


def test_first_round_takes_newton_steps(rows):
    """After one round of single splits, margins are priors plus the step of the leaf, counted by hand."""
    model = models.train_gbt_multiclass(rows, maxIter=1, maxDepth=1, stepSize=0.5)
    found = model.transform(rows).select("label", "_margins", *[f"_leaf_0_{k}" for k in range(3)]).collect()
    prior = [sum(r["label"] == k for r in found) / len(found) for k in range(3)]
    for k in range(3):
        for leaf in {r[f"_leaf_0_{k}"] for r in found}:
            mine = [r for r in found if r[f"_leaf_0_{k}"] == leaf]
            left = [(r["label"] == k) - prior[k] for r in mine]
            step = 2 / 3 * sum(left) / sum(abs(x) * (1 - abs(x)) for x in left)
            assert all(r["_margins"][k] == pytest.approx(math.log(prior[k]) + 0.5 * step) for r in mine)


def test_three_classes(rows):
    # Most trees of a forest never see the one telling column: ask for more than the biggest class.
    biggest = rows.groupBy("label").count().agg(F.max("count")).first()[0] / rows.count()
    forest = models.train_random_forest(rows, numTrees=15, maxDepth=5)
    check(models.score(forest, rows), 3, biggest + 0.1)


def test_network_scales_with_the_training_rows(rows):
    two = rows.filter("winner <> 'DRAW'")
    model = models.train_mlp(two)
    check(models.score(model, two), 2, 0.9)
    # One row alone gets the same answer as among the others.
    alone = models.score(model, two.orderBy("bout_id").limit(1)).first()
    among = models.score(model, two).orderBy("bout_id").first()
    assert alone["prediction"] == among["prediction"]


def test_gradient_equals_finite_differences(spark):
    rng = np.random.default_rng(1)
    layers, x, label = [3, 4, 2, 3], rng.normal(size=(50, 3)), rng.integers(0, 3, 50)
    weights = network.first_weights(layers, 2)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, label, strict=True)], "x array<double>, label int")
    whole, slope = network.over_rows(rows.repartition(4), layers)(weights)
    loss, gradient = network.loss_and_gradient(weights, layers, x, label)
    assert whole == pytest.approx(loss / 50) and np.allclose(slope, gradient / 50)
    extra, bend = network.penalty(weights, layers, 0.3, 50)

    def total(w):
        return network.loss_and_gradient(w, layers, x, label)[0] / 50 + network.penalty(w, layers, 0.3, 50)[0]

    for i in range(len(weights)):
        step = np.zeros(len(weights))
        step[i] = 1e-6
        assert (total(weights + step) - total(weights - step)) / 2e-6 == pytest.approx((slope + bend)[i], abs=1e-6)


def test_larger_penalty_gives_smaller_weights():
    rng = np.random.default_rng(3)
    layers, x = [4, 5, 2], rng.normal(size=(200, 4))
    label = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int)
    norms, losses = [], []
    for alpha in (0.0, 1.0, 100.0):
        def evaluate(w, alpha=alpha):
            loss, gradient = network.loss_and_gradient(w, layers, x, label)
            extra, slope = network.penalty(w, layers, alpha, 200)
            return loss / 200 + extra, gradient / 200 + slope

        start = network.first_weights(layers, 0)
        fitted = network.lbfgs(evaluate, start, 200)
        norms.append(sum((m**2).sum() for m, _ in network.split_weights(fitted, layers)))
        losses.append(evaluate(start)[0] - evaluate(fitted)[0])
    assert norms[0] > norms[1] > norms[2] and min(losses) > 0


def test_penalised_network_learns_saves_and_loads(spark, rows):
    model = models.train_network(rows, 3, hidden=(6,), maxIter=25, alpha=0.01)
    check(models.score(model, rows), 3, 0.9)
    path = scratch_path(spark, "network")
    models.save_model(model, path)
    assert models.score(models.load_model(path), rows).exceptAll(models.score(model, rows)).isEmpty()
    # The SQL stage gives what the arithmetic of the fit gives.
    layers = [len(network_inputs(model, rows)[0][0]), 6, 3]
    found = model.transform(rows).select("_layer_0", "_layer_1", "_layer_2", "_probabilities").collect()
    assert all(len(r["_layer_0"]) == layers[0] and len(r["_layer_1"]) == 6 for r in found)
    for r in found[:20]:
        z = np.exp(np.array(r["_layer_2"]) - max(r["_layer_2"]))
        assert np.allclose(z / z.sum(), r["_probabilities"])


def network_inputs(model, rows):
    return [(r["_layer_0"],) for r in model.transform(rows).select("_layer_0").limit(1).collect()]


def test_folds_are_scaled_on_their_own_and_failures_reported(rows):
    two = rows.filter("winner <> 'DRAW'")
    seen = []

    def fit(train, depth):
        if depth < 0:
            raise ValueError("no such depth")
        seen.append(models.scaling_stage(train).getStatement())
        return models.train_gbt(train, maxIter=1, maxDepth=depth)

    done = models.search(two, fit, {"depth": (1, -1, 2)}, folds=3)
    table = {json.loads(r["settings"])["depth"]: r for r in done.table.collect()}
    assert table[-1]["mean_accuracy"] is None and "no such depth" in table[-1]["error"]
    for depth in (1, 2):
        assert len(table[depth]["fold_accuracy"]) == 3 and table[depth]["mean_accuracy"] > 0.5
        assert table[depth]["mean_accuracy"] == pytest.approx(sum(table[depth]["fold_accuracy"]) / 3)
    # Means of the folds differ from each other and from those of all rows, which the last fit sees.
    assert len(set(seen)) == 4
    assert models.score(done.best, two).count() == two.count()
    assert models.search(two, fit, {"depth": (-1,)}, folds=2).best is None


def test_network_grid(rows):
    two = rows.filter("winner <> 'DRAW'")
    done = models.grid_search_network(two, {"hidden": ((2,), (3, 2)), "alpha": (0.01,)}, folds=2, maxIter=4)
    assert done.table.count() == 2 and done.table.filter("error IS NULL AND size(fold_accuracy) = 2").count() == 2


def test_grid_reports_every_depth(rows):
    two = rows.filter("winner <> 'DRAW'")
    best, table = models.grid_search(two, depths=(1, 2), folds=3, maxIter=1)
    found = table.collect()
    assert [r["max_depth"] for r in found] == [1, 2]
    assert all(0.5 < r["mean_accuracy"] <= 1 for r in found)
    assert models.score(best, two).count() == two.count()


def test_winner_is_named_on_its_own_row(spark, rows):
    two = rows.filter("winner <> 'DRAW'")
    model = models.train_gbt(two, maxIter=3, stepSize=0.3)
    card = two.withColumn("card_id", F.col("bout_id"))
    picks = models.predict_upcoming(model, card).join(two.selectExpr("bout_id AS card_id", "winner AS truth"), "card_id")
    right = picks.filter("winner = if(truth = 'Red', 'Ann', 'Bea')").count()
    assert right / picks.count() > 0.95


def test_card_rows_with_unknown_columns_get_no_pick(rows):
    two = rows.filter("winner <> 'DRAW'")
    model = models.train_gbt(two, maxIter=1)
    card = two.withColumn("card_id", F.col("bout_id")).withColumn(
        "weight", F.when(F.col("bout_id") % 2 == 0, F.col("weight"))
    )
    picks = models.predict_upcoming(model, card).collect()
    assert picks and all(r["card_id"] % 2 == 0 for r in picks)


def test_layers_are_as_plain_sums_and_do_not_depend_on_batches(spark):
    """What SQL over one number at a time gives, bit by bit; an unknown input leaves the hidden units at zero."""
    rng = np.random.default_rng(4)
    layers = [5, 7, 3]
    weights, x = network.first_weights(layers, 1), rng.normal(size=(3000, 5))
    drawn = [(i, [None if i % 97 == 5 and j == 2 else v for j, v in enumerate(row)]) for i, row in enumerate(x.tolist())]
    frame = spark.createDataFrame(drawn, "i long, x array<double>").repartition(3)
    model = models.PipelineModel(stages=network.network_stages(weights, layers, "x"))
    found = {r["i"]: r for r in model.transform(frame).select("i", "_layer_1", "_layer_2", "_probabilities").collect()}
    assert len(found) == 3000
    for i, row in drawn:
        below = row
        for at, (matrix, offset) in enumerate(network.split_weights(weights, layers)):
            units = []
            for k, total in enumerate(offset.tolist()):
                for value, factor in zip(below, matrix[:, k].tolist(), strict=True):
                    total = None if total is None or value is None else total + value * factor
                units.append(total if at else 0.0 if total is None else max(0.0, total))
            below = units
            assert found[i][f"_layer_{at + 1}"] == below
        assert sum(found[i]["_probabilities"]) == pytest.approx(1)
    # A network without hidden layers has no result for such a row.
    alone = models.PipelineModel(stages=network.network_stages(network.first_weights([5, 3], 1), [5, 3], "x"))
    none = {r["i"] for r in alone.transform(frame).filter("prediction IS NULL").collect()}
    assert none == {i for i in range(3000) if i % 97 == 5}
    assert alone.transform(frame.limit(0)).count() == 0


def test_rows_are_scaled_once_per_fold(rows, monkeypatch):
    """Four points over two folds, and the best point on all rows: three scalings, not nine."""
    calls, scaling = [], models.scaling_stage
    monkeypatch.setattr(models, "scaling_stage", lambda train: calls.append(1) or scaling(train))
    two = rows.filter("winner <> 'DRAW'")
    grid = {"hidden": ((2,), (3,)), "alpha": (0.01, 0.1)}
    done = models.grid_search_network(two, grid, folds=2, maxIter=2)
    assert len(calls) == 3
    one = models.search(two, models.train_network, {"hidden": ((3,),), "alpha": (0.1,)}, folds=2, maxIter=2).table.first()
    same = next(r for r in done.table.collect() if r["settings"] == one["settings"])
    # Tasks end in any order, so sums differ in their last digits.
    assert same["fold_accuracy"] == pytest.approx(one["fold_accuracy"], abs=0.02)
