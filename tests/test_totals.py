import random

import pytest
from pyspark.sql import functions as F

import data
from boutlab.operators import totals
from boutlab.operators.skew import find_slots
from boutlab.schema import STAT_COLUMNS, TOTAL_COLUMNS


@pytest.mark.parametrize("rows_per_slot", [1_000_000, 5])
@pytest.mark.parametrize("hot", [None, 2])
def test_totals_equal_a_sequential_fold(spark, rows_per_slot, hot):
    rows, stats = data.make(seed=3, hot=hot)
    bouts, corner = data.frames(spark, rows, stats)
    after, before = data.fold(rows, stats)
    found = totals.running_totals(bouts, corner, rows_per_slot=rows_per_slot)
    assert data.as_dict(found) == after
    entering = totals.previous_totals(bouts, corner, rows_per_slot=rows_per_slot)
    assert data.as_dict(entering) == before


def test_bouts_at_one_moment_are_cut_by_id(spark):
    rows, stats = data.make(seed=4, hot=1, same_moment=True)
    bouts, corner = data.frames(spark, rows, stats)
    assert data.as_dict(totals.running_totals(bouts, corner, rows_per_slot=4)) == data.fold(rows, stats)[0]


def test_hot_competitor_is_cut_until_slots_are_small(spark):
    # 300 bouts within one hour of a year: one cut in time is not enough.
    frame = spark.range(300).selectExpr(
        "1L AS competitor_id",
        "IF(id = 0, TIMESTAMP_NTZ'2023-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 10)) AS bout_ts",
        "id AS bout_id",
    )
    slots = find_slots(frame, "competitor_id", ("bout_ts", "bout_id"), 20)
    from boutlab.operators.skew import add_slots

    sizes = add_slots(frame, slots).groupBy("_slot").count()
    assert len(slots.levels) > 1
    assert sizes.agg(F.max("count")).first()[0] <= 20
    ordered = add_slots(frame, slots).orderBy("bout_ts", "bout_id").select("_slot").collect()
    numbers = [r[0] for r in ordered]
    assert numbers == sorted(numbers)


def test_row_order_does_not_matter(spark):
    rows, stats = data.make(seed=5)
    after = data.fold(rows, stats)[0]
    random.Random(0).shuffle(rows)
    random.Random(1).shuffle(stats)
    assert data.as_dict(totals.running_totals(*data.frames(spark, rows, stats))) == after


@pytest.mark.parametrize("rows_per_slot", [1_000_000, 4])
def test_increment_equals_full_recompute(spark, rows_per_slot):
    rows, stats = data.make(seed=6, hot=3)
    bouts, corner = data.frames(spark, rows, stats)
    middle = sorted(r[1] for r in rows)[35]
    old, new = bouts.filter(F.col("bout_ts") <= F.lit(middle)), bouts.filter(F.col("bout_ts") > F.lit(middle))
    stored = totals.running_totals(old, corner)
    # Ids grow along time here, as they do in a stored table.
    order = {key: i for i, key in enumerate(sorted(((r[1], r[0]) for r in rows)))}
    ranks = spark.createDataFrame([(k[1], v) for k, v in order.items()], "bout_id long, rank long")
    seed = totals.latest_totals(
        stored.join(ranks, "bout_id").withColumn("totals_id", F.col("rank") * 2 + (F.col("corner") == "b").cast("int"))
    )
    grown = totals.running_totals(new, corner, seed=seed, rows_per_slot=rows_per_slot)
    after = data.fold(rows, stats)[0]
    found = data.as_dict(grown)
    assert found and all(found[k] == after[k] for k in found)
    assert len(found) == 2 * new.count()


def test_first_bout_starts_from_zeros_and_wins_match_losses(spark):
    bouts, corner = data.frames(spark, *data.make(seed=7))
    entering = data.as_dict(totals.previous_totals(bouts, corner))
    after = data.as_dict(totals.running_totals(bouts, corner))
    assert sum(not any(v.values()) for v in entering.values()) >= 6
    gained = {m: sum(after[k][m] - entering[k][m] for k in after) for m in ("wins", "losses", "draws")}
    assert gained["wins"] == gained["losses"]
    assert gained["draws"] % 2 == 0


def test_unknown_winner_is_rejected_and_counts_nowhere(spark):
    rows, stats = data.make(seed=8, bouts=10)
    rows[4] = (*rows[4][:7], "somebody else", *rows[4][8:])
    bouts, corner = data.frames(spark, rows, stats)
    assert [r["bout_id"] for r in totals.rejected(bouts).collect()] == [rows[4][0]]
    kept = [r for r in rows if r[7] != "somebody else"]
    assert data.as_dict(totals.running_totals(bouts, corner)) == data.fold(kept, stats)[0]


def test_bout_without_statistics_still_counts_for_the_record(spark):
    rows, stats = data.make(seed=9, bouts=12)
    bouts, corner = data.frames(spark, rows, stats)
    some = corner.filter("bout_id <> 3")
    zeroed = [s if s[1] != 3 else (*s[:4], *[0] * len(STAT_COLUMNS)) for s in stats]
    assert data.as_dict(totals.running_totals(bouts, some)) == data.fold(rows, zeroed)[0]


@pytest.mark.parametrize("rows_per_slot", [1_000_000, 4])
def test_pending_bouts_start_from_the_totals_before_them(spark, rows_per_slot):
    rows, stats = data.make(seed=21, bouts=90, hot=3)
    bouts, corner = data.frames(spark, rows, stats)
    # Stored bouts lie before, between and after the pending ones.
    old, new = bouts.filter("bout_id % 3 = 0"), bouts.filter("bout_id % 3 <> 0")
    stored = totals.running_totals(old, corner).withColumn(
        "totals_id", F.col("bout_id") * 2 + (F.col("corner") == "b").cast("int")
    )
    expected = data.fold(rows, stats, data.as_dict(stored))[0]
    found = totals.totals_since_stored(new, corner, stored, rows_per_slot=rows_per_slot)
    assert dict(found.dtypes)["competitor_id"] == "bigint"
    assert data.as_dict(found) == expected


@pytest.mark.parametrize("rows_per_slot", [1_000_000, 3])
def test_previous_bout_is_strictly_before(spark, rows_per_slot):
    rows, stats = data.make(seed=10, bouts=80, hot=2)
    bouts, _ = data.frames(spark, rows, stats)
    probes = [(i, 1 + i % 7, rows[i % len(rows)][1]) for i in range(60)]
    frame = spark.createDataFrame(probes, "probe_id long, competitor_id long, probe_ts timestamp_ntz")
    # Every ninth bout has no totals yet, so it is no previous bout.
    bouts = bouts.withColumns({f"{c}_totals_id": F.expr("if(bout_id % 9 = 0, NULL, bout_id)") for c in "rb"})
    found = {r["probe_id"]: r["previous_bout_id"] for r in totals.previous_bout(bouts, frame, rows_per_slot).collect()}
    for probe, who, at in probes:
        earlier = [(r[1], r[0]) for r in rows if who in (r[3], r[4]) and r[1] < at and r[0] % 9]
        assert found[probe] == (max(earlier)[1] if earlier else None)
    assert len(found) == len(probes)


def test_mirror_shows_the_other_corner(spark):
    bouts, corner = data.frames(spark, *data.make(seed=11, bouts=5))
    mirrored = totals.opponent_mirror(corner, ["sig_str_landed"])
    rows = {(r["bout_id"], r["corner"]): r for r in mirrored.collect()}
    for (bout, side), row in rows.items():
        other = rows[bout, "b" if side == "r" else "r"]
        assert row["opponent_sig_str_landed"] == other["sig_str_landed"]
        assert row["opponent_competitor_id"] == other["competitor_id"]


def test_only_needed_inputs_are_read(spark):
    bouts, corner = data.frames(spark, *data.make(seed=12, bouts=5))
    plan = totals.running_totals(bouts, None, ["wins"])
    assert plan.count() == 10
    assert set(TOTAL_COLUMNS) >= {"wins"}
