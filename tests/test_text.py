import datetime as dt

import pytest
from pyspark.sql import functions as F

from boutlab.functions import odds, text
from boutlab.operators import standardize


def one(spark, expression, value):
    frame = spark.createDataFrame([(value,)], "t string")
    return frame.select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "function, value, expected",
    [
        (text.landed, "109 of 156", 109),
        (text.attempted, "109 of 156", 156),
        (text.landed, "51 of 69 - 74%", 51),
        (text.attempted, "51 of 69 - 74%", 69),
        (text.landed, "---", None),
        (text.attempted, "---", None),
        (text.clock_seconds, "3:44", 224),
        (text.clock_seconds, "--", None),
        (text.height_inches, "6' 4\"", 76),
        (text.height_inches, "6' 4&quot;", 76),
        (text.height_inches, "5' 11\"", 71),
        (text.height_inches, "--", None),
        (text.leading_number, "205 lbs.", 205),
        (text.leading_number, '76"', 76),
        (text.leading_number, "--", None),
        (text.american_odds, "+150", 150),
        (text.american_odds, "-175 (extra text)", -175),
        (text.american_odds, "even", None),
        (text.gender, "Women's Flyweight", "female"),
        (text.gender, "Flyweight", "male"),
        (text.class_name, "Women's Flyweight", "flyweight"),
        (text.class_name, "Light Heavyweight", "light heavyweight"),
        (text.pounds, "catch weight", 140),
        (text.pounds, "light heavyweight", 205),
        (text.pounds, "openweight", None),
        (text.plain_letters, "Łukasz Jiří-Straße Ærø Ñandú", "Lukasz Jiri Strasse AEro Nandu"),
        (text.last_name, "Ana Maria Lopez", "Lopez"),
        (text.text_or_null, "  ", None),
        (text.text_or_null, "</li>", None),
        (text.text_or_null, " Switch ", "Switch"),
    ],
)
def test_parsers(spark, function, value, expected):
    assert one(spark, function, value) == expected


@pytest.mark.parametrize(
    "kind, value, expected",
    [
        ("card", "September 02, 2023", dt.date(2023, 9, 2)),
        ("birth", "Sep 12, 1992", dt.date(1992, 9, 12)),
        ("quote", "09.02.2023", dt.date(2023, 9, 2)),
        ("quote", "no date", None),
    ],
)
def test_dates(spark, kind, value, expected):
    assert one(spark, lambda c: text.to_day(c, kind), value) == expected


def test_labels(spark):
    rows = [("", "a", "b"), ("a", "a", "b"), ("b", "a", "b"), ("c", "a", "b")]
    frame = spark.createDataFrame(rows, "w string, r string, b string")
    label = text.label_of("w", "r", "b")
    found = [tuple(r) for r in frame.select(label, text.label_number(label)).collect()]
    assert found == [("DRAW", 2), ("Red", 0), ("Blue", 1), (None, None)]


def test_bets_pay_favourites_without_sign_and_wrong_picks_cost_one(spark):
    rows = [
        (0, 0, 150, -200, 1.5), (0, 0, -200, 150, 0.5), (1, 1, 150, -250, 0.4), (1, 1, -250, 120, 1.2),
        (2, 2, None, None, 0.0), (0, 1, 150, -200, -1.0), (0, 0, None, None, None), (0, 1, None, None, None),
        (0, 0, 0, 0, None), (0, 1, None, -200, -1.0), (0, 1, 150, None, None), (None, 0, 150, -200, None),
        (0, 2, None, None, -1.0), (0, None, 150, -200, None),
    ]
    frame = spark.createDataFrame(rows, "label int, prediction int, r int, b int, expected double")
    won = odds.units(F.col("label"), F.col("prediction"), F.col("r"), F.col("b"))
    for row in frame.withColumn("won", won).collect():
        assert row["won"] == row["expected"]


def test_raw_competitors_are_cleaned_or_dropped(spark):
    raw = [
        (1, "A", "6' 4&quot;", "205 lbs.", "--", "Orthodox", "Sep 12, 1992", "Heavyweight"),
        (2, "B", "--", "205 lbs.", '76"', "Orthodox", "Sep 12, 1992", "Heavyweight"),
        (3, "C", "5' 2\"", "--", '60"', "Switch", "--", "Women's Strawweight"),
        (4, "D", "5' 2\"", "115 lbs.", '60"', "", "Sep 12, 1992", "Women's Strawweight"),
        (5, "E", "5' 2\"", "115 lbs.", '63"', "Switch", "--", "Women's Strawweight"),
    ]
    columns = "id long, name string, height string, weight string, reach string, stance string, date_of_birth string, bout_class string"
    found = standardize.clean_competitors(spark.createDataFrame(raw, columns)).orderBy("id").collect()
    assert [(r["id"], r["height"], r["weight"], r["reach"], r["gender"], r["date_of_birth"]) for r in found] == [
        (1, 76, 205, 76, "male", dt.date(1992, 9, 12)),
        (5, 62, 115, 63, "female", None),
    ]


def test_absent_rounds_are_null(spark):
    cells = spark.createDataFrame([(1, 1, "3 of 4 - 75%"), (1, 2, "0 of 0 - 0%")], "k long, round int, text string")
    row = standardize.rounds_to_columns(cells, ["k"]).first()
    assert (row["round_1_sig_str_landed"], row["round_2_sig_str_attempted"]) == (3, 0)
    assert row["round_3_sig_str_landed"] is None and row["round_5_sig_str_attempted"] is None
