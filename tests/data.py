"""Small random bouts with what a sequential fold makes of them."""

import datetime as dt
import random

from boutlab.schema import CATEGORIES, OPPONENT_BEFORE, STAT_COLUMNS, TOTAL_COLUMNS

BOUT_SCHEMA = (
    "bout_id long, bout_ts timestamp_ntz, bout_date date, r_id long, b_id long, r_name string, "
    "b_name string, winner string, win_method string, championship_fight boolean, "
    "number_of_rounds int, finish_round int, finish_time string"
)
STATS_SCHEMA = "stats_id long, bout_id long, corner string, competitor_id long, " + ", ".join(
    f"{c} int" for c in STAT_COLUMNS
)


def make(seed=1, bouts=60, people=6, hot=None, same_moment=False):
    """Bout and corner rows; ``hot`` makes one competitor appear in most bouts."""
    rng = random.Random(seed)
    rows, stats = [], []
    start = dt.datetime(2024, 1, 1)
    for i in range(bouts):
        r, b = rng.sample(range(1, people + 1), 2)
        if hot and rng.random() < 0.7:
            r, b = (hot, b if b != hot else hot + 1)
        at = start if same_moment else start + dt.timedelta(minutes=rng.randrange(5000))
        winner = rng.choice([f"user {r}", f"user {b}", ""])
        last = rng.randint(1, 5)
        rows.append(
            (i, at, at.date(), r, b, f"user {r}", f"user {b}", winner, "KO/TKO",
             rng.random() < 0.3, 5, last, f"{rng.randrange(5)}:{rng.randrange(60):02d}")
        )
        for place, (corner, who) in enumerate((("r", r), ("b", b))):
            values = []
            for c in STAT_COLUMNS:
                late = c.startswith("round_") and int(c.split("_")[1]) > last
                values.append(None if late else rng.randrange(20))
            stats.append((i * 2 + place, i, corner, who, *values))
    return rows, stats


def frames(spark, rows, stats):
    return spark.createDataFrame(rows, BOUT_SCHEMA), spark.createDataFrame(stats, STATS_SCHEMA)


def fold(rows, stats, stored=None):
    """Totals after each bout by going through the bouts one at a time.

    ``stored`` has the totals of some bouts' corners: these are not folded, their totals take over.
    """
    by_corner = {(s[1], s[2]): dict(zip(STAT_COLUMNS, s[4:])) for s in stats}
    state, after, before = {}, {}, {}
    zeros = dict.fromkeys(TOTAL_COLUMNS, 0)
    for row in sorted(rows, key=lambda x: (x[1], bool(stored) and (x[0], "r") in stored, x[0])):
        bout, r, b, winner = row[0], row[3], row[4], row[7]
        if stored and (bout, "r") in stored:
            state[r], state[b] = (dict(stored[bout, c]) for c in "rb")
            continue
        minutes, seconds = row[12].split(":")
        time = (row[11] - 1) * 300 + int(minutes) * 60 + int(seconds)
        entering = {who: dict(state.get(who, zeros)) for who in (r, b)}
        for corner, who, other, opposite in (("r", r, b, "b"), ("b", b, r, "r")):
            own = {k: v or 0 for k, v in by_corner[bout, corner].items()}
            met = {k: v or 0 for k, v in by_corner[bout, opposite].items()}
            new = dict(entering[who])
            new["wins"] += winner == f"user {who}"
            new["losses"] += winner == f"user {other}"
            new["draws"] += winner == ""
            new["championship_fights"] += row[9]
            new["fight_time"] += time
            for total, source in OPPONENT_BEFORE.items():
                new[total] += entering[other][source]
            for c in CATEGORIES:
                new[f"{c}_landed"] += own[f"{c}_landed"]
                new[f"{c}_attempted"] += own[f"{c}_attempted"]
                new[f"{c}_absorbed"] += met[f"{c}_landed"]
                new[f"{c}_evaded"] += met[f"{c}_attempted"] - met[f"{c}_landed"]
            new["kd_landed"] += own["kd_landed"]
            new["kd_absorbed"] += met["kd_landed"]
            new["subs_attempted"] += own["subs_attempted"]
            new["subs_evaded"] += met["subs_attempted"]
            new["ctrl_time"] += own["ctrl_time"]
            new["opponent_ctrl_time"] += met["ctrl_time"]
            new["reversals"] += own["reversals"]
            state[who] = new
            after[bout, corner] = new
            before[bout, corner] = entering[who]
    return after, before


def as_dict(frame):
    return {
        (row["bout_id"], row["corner"]): {c: row[c] for c in TOTAL_COLUMNS}
        for row in frame.collect()
    }
