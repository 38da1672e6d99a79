"""Career totals: what every competitor has done and met, bout by bout.

A *leg* is one corner's view of one bout. Legs carry per-bout increments under the names of the
totals, so a running sum per competitor turns them into totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlab.functions.text import clock_seconds, label_of
from boutlab.operators.skew import (
    ROWS_PER_SLOT,
    Slots,
    find_slots,
    lookup,
    running_last,
    running_sums,
)
from boutlab.schema import (
    CATEGORIES,
    CORNERS,
    OPPONENT_BEFORE,
    ROUND_SECONDS,
    STAT_COLUMNS,
    TOTAL_COLUMNS,
)

ORDER = ("bout_ts", "bout_id")
LEG_KEYS = ["bout_id", "bout_ts", "bout_date", "corner", "competitor_id", "opponent_id"]
CARRIED = list(OPPONENT_BEFORE.values())


def bout_seconds(finish_round="finish_round", finish_time="finish_time"):
    return (F.col(finish_round) - 1) * ROUND_SECONDS + clock_seconds(finish_time)


def zero_fill(stats: DataFrame) -> DataFrame:
    """Rounds that were not fought count as zero."""
    return stats.fillna(0, [c for c in STAT_COLUMNS if c in stats.columns])


def countable(bouts: DataFrame) -> DataFrame:
    """Bouts with two known competitors and a winner that is one of them, or nobody."""
    return bouts.filter(
        F.col("r_id").isNotNull()
        & F.col("b_id").isNotNull()
        & label_of("winner", "r_name", "b_name").isNotNull()
    )


def complete(bouts: DataFrame) -> DataFrame:
    """Bouts with both competitors and both totals rows known."""
    return bouts.filter(
        "r_id IS NOT NULL AND b_id IS NOT NULL AND r_totals_id IS NOT NULL AND b_totals_id IS NOT NULL"
    )


def rejected(bouts: DataFrame) -> DataFrame:
    """Bouts whose winner is neither corner."""
    return bouts.filter(label_of("winner", "r_name", "b_name").isNull())


def unpivot(frame: DataFrame, passing: Sequence[str], side) -> DataFrame:
    """Two rows per bout: ``side(me, other)`` maps the columns of corner ``me`` to SQL texts.

    One conditional per column compiles better than two structs of all columns would.
    """
    r, b = CORNERS
    red, blue = side(r, b), side(b, r)
    return frame.withColumn("corner", F.explode(F.array(F.lit(r), F.lit(b)))).selectExpr(
        *passing, "corner", *[f"if(corner = '{r}', {red[n]}, {blue[n]}) AS {n}" for n in red]
    )


def pair_up(legs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per bout with the columns of both corners, prefixed ``r_`` and ``b_``.

    One pass and one shuffle, where joining the two corners would read the legs twice.
    """
    return legs.groupBy("bout_id").agg(
        *[
            F.expr(f"max(CASE WHEN corner = '{side}' THEN {c} END) AS {side}_{c}")
            for side in CORNERS
            for c in columns
        ]
    )


def opponent_mirror(stats: DataFrame, columns: Sequence[str] = tuple(STAT_COLUMNS)) -> DataFrame:
    """Every corner row next to what the other corner did in the same bout (``opponent_*``)."""
    kept = ["competitor_id", *columns]

    def side(me, other):
        own = {c: f"{me}_{c}" for c in kept}
        met = {f"opponent_{c}": f"{other}_{c}" for c in kept}
        return own | met

    return unpivot(pair_up(stats, kept), ["bout_id"], side)


def _marked(bouts: DataFrame) -> DataFrame:
    return countable(bouts).select(
        "bout_id", "bout_ts", "bout_date", "r_id", "b_id", "championship_fight",
        label_of("winner", "r_name", "b_name").alias("_label"),
        bout_seconds().alias("_seconds"),
    )


def _whole(name: str) -> str:
    return f"coalesce(CAST({name} AS BIGINT), 0)"


def _identity(me, other) -> dict[str, str]:
    return {"competitor_id": f"{me}_id", "opponent_id": f"{other}_id"}


def _from_bout(me, other) -> dict[str, str]:
    """Increments the bout row alone tells: result, title bout, time fought."""
    winner = {"r": "Red", "b": "Blue"}
    return {
        "wins": f"CAST(_label = '{winner[me]}' AS BIGINT)",
        "losses": f"CAST(_label = '{winner[other]}' AS BIGINT)",
        "draws": "CAST(_label = 'DRAW' AS BIGINT)",
        "championship_fights": _whole("championship_fight"),
        "fight_time": "CAST(_seconds AS BIGINT)",
    }


def _from_opponent(me, other) -> dict[str, str]:
    """Increments that are the opponent's own totals before the bout."""
    return {total: f"{other}_{name}" for total, name in OPPONENT_BEFORE.items()}


def _from_stats(me, other) -> dict[str, str]:
    """Increments counted from both corners' statistics; rounds not fought count as zero."""
    found = {}
    for c in CATEGORIES:
        met = _whole(f"{other}_{c}_landed")
        found[f"{c}_landed"] = _whole(f"{me}_{c}_landed")
        found[f"{c}_attempted"] = _whole(f"{me}_{c}_attempted")
        found[f"{c}_absorbed"] = met
        found[f"{c}_evaded"] = f"{_whole(f'{other}_{c}_attempted')} - {met}"
    for mine, theirs, name in (
        ("ctrl_time", "opponent_ctrl_time", "ctrl_time"),
        ("kd_landed", "kd_absorbed", "kd_landed"),
        ("subs_attempted", "subs_evaded", "subs_attempted"),
    ):
        found[mine] = _whole(f"{me}_{name}")
        found[theirs] = _whole(f"{other}_{name}")
    found["reversals"] = _whole(f"{me}_reversals")
    return found


def record_legs(bouts: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    """Legs with the increments the bout row alone tells."""

    def side(me, other):
        found = _from_bout(me, other)
        names = found if measures is None else measures
        return _identity(me, other) | {m: found[m] for m in names}

    return unpivot(_marked(bouts), ["bout_id", "bout_ts", "bout_date"], side)


def career_slots(bouts: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> Slots:
    """Competitors with too many bouts for one task."""
    legs = unpivot(bouts, ORDER, lambda me, other: {"competitor_id": f"{me}_id"})
    return find_slots(legs, "competitor_id", ORDER, rows_per_slot)


def _accumulate(legs, bouts, slots, measures, seed=None, before=False):
    """Running sums per competitor, on top of stored totals where a seed is given."""
    if seed is None:
        return running_sums(legs, slots, measures, before)
    # Stored totals go in front of the competitor's legs as a row without a bout.
    met = record_legs(bouts, []).select("competitor_id").distinct()
    stored = seed.join(met, "competitor_id", "left_semi").selectExpr(
        "competitor_id", *[f"CAST({m} AS BIGINT) AS {m}" for m in measures]
    )
    seeded = legs.unionByName(stored, allowMissingColumns=True)
    return running_sums(seeded, slots, measures, before).filter(F.col("bout_id").isNotNull())


def opponents_before(bouts: DataFrame, slots: Slots, seed: DataFrame | None = None) -> DataFrame:
    """Per bout, each corner's own record and fight time entering it (``r_*``, ``b_*``)."""
    legs = record_legs(bouts, CARRIED)
    return pair_up(_accumulate(legs, bouts, slots, CARRIED, seed, before=True), CARRIED)


def bout_legs(
    bouts: DataFrame,
    stats: DataFrame | None,
    measures: Sequence[str],
    slots: Slots,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Legs with the increments of the wanted totals; only the inputs they need are read.

    Both inputs meet the bout on ``bout_id``, one shuffle each, before it is split into legs.
    """
    wide = _marked(bouts)
    parts = [_from_bout]
    if set(measures) & set(OPPONENT_BEFORE):
        wide = wide.join(opponents_before(bouts, slots, seed), "bout_id", "left")
        parts.append(_from_opponent)
    needed = _stats_needed(measures)
    if needed:
        wide = wide.join(pair_up(stats, needed), "bout_id", "left")
        parts.append(_from_stats)

    def side(me, other):
        found = {}
        for part in parts:
            found |= part(me, other)
        return _identity(me, other) | {m: found[m] for m in measures}

    return unpivot(wide, ["bout_id", "bout_ts", "bout_date"], side)


def _stats_needed(measures: Sequence[str]) -> list[str]:
    """Statistics columns behind the wanted totals."""
    sources = {
        "opponent_ctrl_time": ["ctrl_time"],
        "kd_absorbed": ["kd_landed"],
        "subs_evaded": ["subs_attempted"],
    }
    for c in CATEGORIES:
        sources[f"{c}_absorbed"] = [f"{c}_landed"]
        sources[f"{c}_evaded"] = [f"{c}_attempted", f"{c}_landed"]
    wanted = {s for m in measures for s in sources.get(m, [m])}
    return [c for c in STAT_COLUMNS if c in wanted]


def running_totals(
    bouts: DataFrame,
    stats: DataFrame | None = None,
    measures: Sequence[str] = tuple(TOTAL_COLUMNS),
    rows_per_slot: int = ROWS_PER_SLOT,
    seed: DataFrame | None = None,
    before: bool = False,
) -> DataFrame:
    """Totals after each bout (``before=True``: entering it), one row per corner.

    ``seed`` holds each competitor's totals stored so far when ``bouts`` is only the increment.
    """
    measures = list(measures)
    slots = career_slots(bouts, rows_per_slot)
    legs = bout_legs(bouts, stats, measures, slots, seed)
    return _accumulate(legs, bouts, slots, measures, seed, before)


def previous_totals(
    bouts: DataFrame,
    stats: DataFrame | None = None,
    measures: Sequence[str] = tuple(TOTAL_COLUMNS),
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """The totals a competitor brings into each bout: those of the bout before, else zeros."""
    return running_totals(bouts, stats, measures, rows_per_slot, before=True)


def previous_bout(
    bouts: DataFrame, probes: DataFrame, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Latest complete bout of a competitor strictly before a moment, for any moments.

    Complete bouts know both competitors and both totals rows.

    ``probes`` has ``probe_id``, ``competitor_id`` and ``probe_ts``. Bouts and probes are laid on one
    time line per competitor; at the same moment a probe comes before a bout.
    """
    history = unpivot(
        complete(bouts),
        ["bout_ts AS at", "1L AS place", "bout_id"],
        lambda me, other: {"competitor_id": f"{me}_id"},
    ).selectExpr(
        "competitor_id",
        "at",
        "place",
        "bout_id AS tie",
        "struct(at AS previous_ts, bout_id AS previous_bout_id, corner AS previous_corner) AS previous",
    )
    asked = probes.filter("competitor_id IS NOT NULL").selectExpr(
        "competitor_id", "probe_ts AS at", "0L AS place", "probe_id AS tie", "NULL AS previous"
    )
    line = history.unionByName(asked)
    # Of two bouts at one moment the one with the higher id is the later.
    order = ("at", "place", "tie")
    slots = find_slots(line.select("competitor_id", *order), "competitor_id", order, rows_per_slot)
    return (
        running_last(line, slots, "previous")
        .filter("place = 0")
        .selectExpr("tie AS probe_id", "competitor_id", "at AS probe_ts", "previous.*")
    )


def totals_since_stored(
    pending: DataFrame,
    stats: DataFrame,
    stored: DataFrame,
    measures: Sequence[str] = tuple(TOTAL_COLUMNS),
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Totals after each pending bout, on top of the latest stored totals strictly before it.

    Stored and pending rows are laid on one line per competitor, a pending one first where both are
    at one moment. The stored rows before a pending leg are counted; legs with the same count form a segment,
    which starts from the totals of its last stored row. Segments are then what competitors are
    to ``running_totals``, so own and opponents' values follow the same rule.
    """
    legs = unpivot(
        countable(pending), ORDER, lambda me, other: {"competitor_id": f"{me}_id"}
    )
    met = legs.select("competitor_id").distinct()
    known = stored.join(met, "competitor_id", "left_semi")
    line = legs.selectExpr(
        "competitor_id", "bout_ts", "0L AS place", "bout_id", "corner", "0L AS segment", "NULL AS totals_id"
    ).unionByName(
        known.selectExpr(
            "competitor_id", "bout_ts", "1L AS place", "bout_id", "corner", "1L AS segment", "totals_id"
        )
    )
    order = ("bout_ts", "place", "bout_id")
    slots = find_slots(line.select("competitor_id", *order), "competitor_id", order, rows_per_slot)
    counted = running_sums(line, slots, ["segment"]).withColumn(
        "key", F.concat_ws(":", F.col("competitor_id").cast("string"), F.col("segment").cast("string"))
    )
    keys = pair_up(counted.filter("place = 0"), ["key"])
    keyed = pending.join(keys, "bout_id").withColumns({"r_id": F.col("r_key"), "b_id": F.col("b_key")})
    needed = counted.filter("place = 0").select("key").distinct()
    starts = counted.filter("place = 1").select("totals_id", "key").join(needed, "key", "left_semi")
    seed = stored.select("totals_id", *measures).join(starts, "totals_id").withColumnRenamed("key", "competitor_id")
    grown = running_totals(keyed.drop("r_key", "b_key"), stats, measures, rows_per_slot, seed)
    kind = pending.schema["r_id"].dataType
    plain = {
        c: F.substring_index(c, ":", 1).cast(kind)
        for c in ("competitor_id", "opponent_id")
        if c in grown.columns
    }
    return grown.withColumns(plain)


def with_age(totals: DataFrame, competitors: DataFrame) -> DataFrame:
    """Name, and age in days on the day of the bout."""
    born = competitors.select(F.col("id").alias("competitor_id"), "name", "date_of_birth")
    return lookup(totals, born, ["competitor_id"], ["bout_id"]).select(
        *totals.columns, "name", F.date_diff("bout_date", "date_of_birth").alias("age")
    )


def cumulative_totals(
    bouts: DataFrame,
    stats: DataFrame,
    competitors: DataFrame,
    rows_per_slot: int = ROWS_PER_SLOT,
    seed: DataFrame | None = None,
    before: bool = False,
) -> DataFrame:
    """All totals with name and age, one row per corner of every bout."""
    totals = running_totals(bouts, stats, TOTAL_COLUMNS, rows_per_slot, seed, before)
    return with_age(totals, competitors)


def latest_totals(totals: DataFrame, order: str = "totals_id") -> DataFrame:
    """The newest totals row of every competitor.

    Finds the newest id on two narrow columns first, then fetches those rows only.
    """
    newest = totals.groupBy("competitor_id").agg(F.max(order).alias(order))
    return totals.join(newest.select(order), order, "left_semi")
