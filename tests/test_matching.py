import datetime as dt

import pytest
from pyspark.sql import functions as F

from boutlab.operators import quotes, resolve, snapshots

DAY = dt.date(2023, 9, 2)
BOUTS = [(1, "Ann A", "Bea B", DAY), (2, "Bea B", "Ann A", DAY), (3, "Cat C", "Dot D", DAY), (4, "Eve E", None, DAY)]
QUOTES = [
    (10, "Bea Bee", "Ann A", "-150", "+130", "Flyweight", DAY, None),
    (11, "Ann A", "Bea B", "+140", "-160", "Flyweight", DAY, None),
    (12, "Dot D", "Cat C", "-300", "+240", "Women's Strawweight", DAY, None),
    (13, "Dot D", "Cat C", "-300", "+240", "Flyweight", DAY + dt.timedelta(1), 99),
]


@pytest.fixture()
def tables(spark):
    bouts = spark.createDataFrame(BOUTS, "bout_id long, r_name string, b_name string, bout_date date")
    given = spark.createDataFrame(
        QUOTES,
        "quote_id long, left_name string, right_name string, left_odds string, right_odds string, "
        "weight_class string, quote_date date, bout_id long",
    )
    aliases = spark.createDataFrame([("Bea Bee", "Bea B")], "raw_name string, name string")
    return bouts, given, resolve.resolve_aliases(given, ["left_name", "right_name"], aliases, "quote_id")


def test_quotes_meet_the_first_bout_of_the_pair(tables):
    bouts, _, resolved = tables
    found = {r["quote_id"]: r["bout_id"] for r in quotes.match_quotes(resolved, bouts).collect()}
    assert found == {10: 1, 11: 1, 12: 3}
    assert [r["quote_id"] for r in quotes.unmatched_quotes(resolved, bouts).collect()] == [13]
    half = resolved.filter("quote_id <> 13").withColumn("left_name", F.lit(None).cast("string"))
    assert quotes.unmatched_quotes(half, bouts).count() == half.count() > 0


def test_matching_is_the_same_when_nothing_can_be_broadcast(tables, no_broadcast):
    bouts, _, resolved = tables
    found = {r["quote_id"]: r["bout_id"] for r in quotes.match_quotes(resolved, bouts).collect()}
    assert found == {10: 1, 11: 1, 12: 3}


def test_odds_follow_resolved_names(tables):
    bouts, _, resolved = tables
    oriented = quotes.orient_quotes(quotes.match_quotes(resolved, bouts), bouts)
    found = {r["quote_id"]: (r["r_odds"], r["b_odds"]) for r in oriented.collect()}
    # Quote 10 names the blue corner first and under another spelling.
    assert found == {10: ("+130", "-150"), 11: ("+140", "-160"), 12: ("+240", "-300")}


def test_newest_quote_wins_and_both_tables_are_linked(tables):
    bouts, given, resolved = tables
    oriented = quotes.orient_quotes(quotes.match_quotes(resolved, bouts), bouts)
    new_bouts, new_quotes = quotes.link_quotes_and_bouts(given, bouts, oriented)
    found = {r["bout_id"]: (r["quote_id"], r["r_odds"], r["weight"]) for r in new_bouts.collect()}
    assert found == {1: (11, "+140", 125), 2: (None, None, None), 3: (12, "+240", 115), 4: (None, None, None)}
    assert {r["quote_id"]: r["bout_id"] for r in new_quotes.collect()} == {10: 1, 11: 1, 12: 3, 13: 99}


def test_weight_by_pair_sets_every_bout_of_the_pair(spark, tables):
    bouts, *_ = tables
    weights = spark.createDataFrame(
        [("Bea B", "Ann A", DAY, "lightweight"), ("Dot D", "Cat C", DAY, "unheard of")],
        "one_name string, other_name string, day date, weight_class string",
    )
    start = bouts.selectExpr("*", "1 AS weight")
    found = {r["bout_id"]: r["weight"] for r in quotes.update_weight_by_pair(start, weights).collect()}
    assert found == {1: 155, 2: 155, 3: None, 4: 1}


def test_names_resolve_to_the_least_id(spark, tables):
    bouts, *_ = tables
    people = spark.createDataFrame([(9, "Ann A"), (5, "Ann A"), (7, "Bea B"), (8, None)], "id long, name string")
    found = {r["bout_id"]: (r["r_id"], r["b_id"]) for r in resolve.resolve_names(bouts, people).collect()}
    assert found == {1: (5, 7), 2: (7, 5), 3: (None, None), 4: (None, None)}


def test_duplicates_keep_least_id_protected_and_nameless_rows(spark):
    people = spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, "b"), (4, "p"), (5, "p"), (6, None), (7, None)], "id long, name string"
    )
    assert {r["id"] for r in resolve.drop_duplicate_names(people, protected=["p"]).collect()} == {1, 3, 4, 5, 6, 7}
    assert {r["id"] for r in resolve.rows_with_duplicate_names(people).collect()} == {1, 2, 4, 5}


def test_names_are_found_whatever_the_case(spark):
    directory = spark.createDataFrame([(1, "Ann", "Ames"), (2, "Bo", "Ames")], "entry_id long, first_name string, last_name string")
    wanted = spark.createDataFrame([("ANN ames",)], "name string")
    assert [r["entry_id"] for r in resolve.search_names(directory, wanted).collect()] == [1]


def test_builtin_aliases_are_one_to_one(spark):
    table = resolve.alias_table(spark)
    assert table.count() == table.select("raw_name").distinct().count() == 36


def test_overlay_writes_nulls_and_keeps_other_rows(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, v string, w int")
    changes = spark.createDataFrame([(2, None, "new")], "id long, v string, x string")
    found = {r["id"]: tuple(r)[1:] for r in snapshots.overlay_update(base, changes, "id").collect()}
    assert found == {1: ("a", 10, None), 2: (None, 20, "new")}


def test_ids_follow_the_greatest_and_start_at_one(spark):
    new = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "at long, v string")
    old = spark.createDataFrame([(41,), (7,)], "id long")
    found = {r["v"]: r["id"] for r in snapshots.append_with_keys(old, new, "id", ["at"]).collect()}
    assert found == {"a": 42, "b": 43, "c": 44}
    empty = snapshots.append_with_keys(old.limit(0), new, "id", ["at"])
    assert sorted(r["id"] for r in empty.collect()) == [1, 2, 3]
