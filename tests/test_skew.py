import pytest
from pyspark.sql import functions as F

from boutlab.operators import skew


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_task", [1_000_000, 10])
def test_spread_lookup_equals_plain_join(spark, how, rows_per_task, no_broadcast):
    facts = spark.range(400).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 11 = 0 THEN NULL ELSE id % 20 END AS k"
    )
    table = spark.range(15).selectExpr("id AS k", "id * 100 AS v")
    found = skew.lookup(facts, table, ["k"], ["id"], how, rows_per_task)
    plain = facts.join(table, ["k"], how)
    columns = plain.columns
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(
        map(tuple, plain.collect()), key=repr
    )


def test_hot_lookup_key_lands_in_many_copies(spark, no_broadcast):
    facts = spark.range(1000).selectExpr("id", "1 AS k")
    table = spark.range(3).selectExpr("id AS k", "id AS v")
    plan = skew.spread_lookup(facts, table, ["k"], ["id"], "left", 50)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_copy" in text
    assert plan.count() == 1000


@pytest.mark.parametrize("rows_per_slot", [1_000_000, 7])
def test_numbers_follow_the_order(spark, rows_per_slot):
    # A third of the rows share one value of the first column.
    frame = spark.range(300).selectExpr("IF(id % 3 = 0, 50, id) AS day", "(id * 37) % 300 AS tie")
    numbered = skew.number_rows(frame, ["day", "tie"], "n", 1000, rows_per_slot)
    rows = sorted((r["day"], r["tie"], r["n"]) for r in numbered.collect())
    assert [n for *_, n in rows] == list(range(1001, 1301))


def test_running_sum_with_and_without_cuts(spark):
    frame = spark.range(500).selectExpr("id % 2 AS k", "id AS at", "id AS tie", "id * 3 AS v")
    plain = skew.find_slots(frame, "k", ("at", "tie"))
    cut = skew.find_slots(frame, "k", ("at", "tie"), 20)
    assert not plain.cut and cut.cut
    one = skew.running_sums(frame, plain, ["v"])
    two = skew.running_sums(frame, cut, ["v"])
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_hot_rows_are_broadcast_and_the_plain_plan_has_one_window(spark):
    frame = spark.range(100).selectExpr("id % 2 AS k", "id AS at", "id AS tie", "id AS v")
    plan = skew.running_sums(frame, skew.find_slots(frame, "k", ("at", "tie")), ["v"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window [") == 1 and "Join" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_date_and_timestamp_orders(spark):
    frame = spark.range(50).select(
        F.lit(1).alias("k"), F.expr("date_add(DATE'2024-01-01', CAST(id AS INT))").alias("at"), F.col("id").alias("v")
    )
    slots = skew.find_slots(frame, "k", ("at", "v"), 5)
    found = skew.running_sums(frame.withColumn("w", F.col("v")), slots, ["w"])
    assert all(r["w"] == r["v"] * (r["v"] + 1) // 2 for r in found.collect())
