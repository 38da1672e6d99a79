import datetime as dt

import data
import pytest
from pyspark.sql import functions as F

from boutlab.operators import evaluate, features
from boutlab.schema import FEATURES, STANCES
from boutlab.sources import tables

PEOPLE = "id long, name string, weight int, height int, reach int, stance string, date_of_birth date, gender string"


@pytest.fixture(scope="module")
def dataset(spark):
    rows, stats = data.make(seed=21, bouts=120, people=8)
    bouts, corner = data.frames(spark, rows, stats)
    people = spark.createDataFrame(
        [(i, f"user {i}", 155, 70, 71, STANCES[i % 5], dt.date(1990, 1, i), "male") for i in range(1, 9)], PEOPLE
    )
    priced = bouts.withColumns(
        {
            "weight": F.lit(155),
            "r_odds": F.when(F.col("bout_id") % 3 > 0, F.lit("+120")),
            "b_odds": F.when(F.col("bout_id") % 3 > 0, F.lit("-140")),
        }
    )
    built = features.training_dataset(priced, corner, people)
    return tables.stage(built, "test_dataset"), rows, stats


def test_dataset_shows_what_was_known_before_the_bout(dataset):
    frame, rows, stats = dataset
    _, before = data.fold(rows, stats)
    assert len(FEATURES) == 152
    for row in frame.collect():
        for side in "rb":
            known = before[row["bout_id"], side]
            assert all(row[f"{side}_{c}"] == known[c] for c in ("wins", "opponent_wins", "td_evaded", "reversals"))


def test_variants(dataset):
    frame, rows, _ = dataset
    assert features.no_draws(frame).count() == sum(1 for r in rows if r[7])
    assert features.with_odds(frame).count() == sum(1 for r in rows if r[0] % 3 > 0)
    assert features.all_bouts(frame).count() == len(rows)
    overturned = frame.withColumn("win_method", F.expr("if(bout_id < 5, 'Overturned', if(bout_id < 9, NULL, 'KO/TKO'))"))
    assert features.no_overturned(overturned).count() == len(rows) - 5


def test_csv_round_trip(spark, dataset):
    from boutlab.session import scratch_path

    frame, *_ = dataset
    path = scratch_path(spark, "csv")
    tables.export_dataset(frame, path)
    back = tables.read_feature_csv(spark, path)
    assert back.columns == frame.columns
    assert back.exceptAll(frame.select(*[F.col(f.name).cast(f.dataType) for f in back.schema])).isEmpty()


def test_unknown_values_give_zero_dummies_and_order_is_fixed(spark):
    frame = spark.createDataFrame([("male", "Switch", None), (None, "odd", "Orthodox")], "gender string, r_stance string, b_stance string")
    rows = features.one_hot(frame).collect()
    assert rows[0]["gender_male"] == rows[0]["r_stance_Switch"] == 1
    assert sum(rows[0]) == 2 and sum(rows[1]) == 1
    aligned = features.align_dummies(features.one_hot(frame), features.MODEL_COLUMNS[-4:] + ["r_wins"])
    assert aligned.columns == features.MODEL_COLUMNS[-4:] + ["r_wins"]


def test_constant_columns_scale_to_zero_and_nulls_stay(spark):
    rows = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, 6.0, 5.0)], "id long, x double, c double")
    found = features.standardize(rows, rows, ["x", "c"]).orderBy("id").collect()
    deviation = (8 / 3) ** 0.5
    assert [r["x"] for r in found] == pytest.approx([-2 / deviation, 0, 2 / deviation])
    assert [r["c"] for r in found] == [0, 0, 0]
    extra = spark.createDataFrame([(4, None, None)], "id long, x double, c double")
    assert features.standardize(rows, extra, ["x", "c"]).first()[1:] == (None, None)


def test_splits_cover_everything_once(spark):
    days = spark.range(100).selectExpr("id AS bout_id", "date_add(DATE'2024-01-01', CAST(id div 30 AS INT)) AS bout_date")
    train, test = features.split_ordered(days)
    assert (train.count(), test.count()) == (90, 10)
    train, test = features.split_random(days)
    assert train.count() + test.count() == 100 and train.join(test, "bout_id").isEmpty()
    again, _ = features.split_random(days.repartition(7))
    assert again.exceptAll(train).isEmpty()


def test_report_and_confusion(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(2, 0)]
    scored = spark.createDataFrame(pairs, "label int, prediction int")
    lines = {r["class"]: r for r in evaluate.classification_report(scored).collect()}
    assert lines["0"]["precision"] == pytest.approx(5 / 7) and lines["0"]["recall"] == pytest.approx(5 / 7)
    assert lines["2"]["precision"] == lines["2"]["f1"] == 0 and lines["2"]["support"] == 1
    assert lines["accuracy"]["f1"] == pytest.approx(8 / 12)
    assert lines["macro avg"]["recall"] == pytest.approx((5 / 7 + 3 / 4 + 0) / 3)
    assert lines["weighted avg"]["recall"] == pytest.approx(8 / 12)
    table = {r["label"]: tuple(r)[1:] for r in evaluate.confusion_matrix(scored).collect()}
    assert table == {0: (5, 2, 0), 1: (1, 3, 0), 2: (1, 0, 0)}
    assert evaluate.correct_incorrect(scored).first()[:] == (8, 4)


def test_report_leaves_classes_that_never_occur_out_of_the_macro_average(spark):
    scored = spark.createDataFrame([(0, 0), (1, 1)], "label int, prediction int")
    lines = {r["class"]: r for r in evaluate.classification_report(scored).collect()}
    assert lines["macro avg"]["f1"] == 1


def test_report_lines(spark):
    picks = spark.createDataFrame([("Ann", "Bea", "Bea", 0.71549)], "r_name string, b_name string, winner string, confidence double")
    assert tables.report_lines(picks).first()[0] == "Fight: Ann vs Bea Winner: Bea, Confidence: 71.5%"
