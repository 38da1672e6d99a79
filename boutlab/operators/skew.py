"""Running values, lookups and row numbers that hold when one key owns a third of all rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. So the keys are counted
first, on their key and order columns only. While no key has more than ``rows_per_slot`` rows the
plain window is the plan. Bigger keys are cut into time slots, slots that are still too big are cut
again: the window runs per (key, slot) and the totals of the earlier slots - one small row per slot -
are added afterwards. Slot bounds come from exact counts, minima and maxima, so a recomputed task
cuts at the same places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_SLOT = 1_000_000
# Slots are cut evenly in time, so leave room for uneven ones.
OVERSPLIT = 8
# Cuts of one key per level; a slot number holds three levels in one long.
MAX_SLOTS = 65_535
BASE = MAX_SLOTS + 1
LEVELS = 3
# Most tasks the facts of one hot lookup key are spread over.
MAX_COPIES = 4_096

SLOT = "_slot"


def _axis(df: DataFrame, name: str) -> Column:
    """An order column as a number that keeps its order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        # Seconds of the wall clock; going through a time zone could run backwards for an hour.
        clock = F.hour(name) * 3600 + F.minute(name) * 60 + F.second(name)
        return F.unix_date(F.col(name).cast("date")).cast("long") * 86_400 + clock
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, T.StringType):
        # The first seven bytes as a number: texts are ordered by their bytes.
        start = F.hex(F.substring(F.encode(F.col(name), "UTF-8"), 1, 7))
        return F.conv(F.rpad(start, 14, "0"), 16, 10).cast("long")
    return F.col(name).cast("long")


def _slot_number(axis: Column, low: Column, high: Column, slots: Column) -> Column:
    share = (axis - low).cast("double") / (high - low + F.lit(1)).cast("double")
    # `least` would skip a NULL; a row without an order value belongs to the first slot.
    return F.when(axis.isNull(), 1).otherwise(F.least(F.floor(share * slots), slots - 1) + 1)


def _slot_count(rows: Column, rows_per_slot: int) -> Column:
    return F.least(F.ceil(rows * OVERSPLIT / F.lit(float(rows_per_slot))), F.lit(MAX_SLOTS))


@dataclass(frozen=True)
class Slots:
    """The keys of a frame that are too big for one task, and where to cut them.

    Each level is a small table of (key, slot so far) with the size and the span to cut.
    """

    key: str
    order: tuple[str, ...]
    rows_per_slot: int
    levels: tuple[DataFrame, ...]

    @property
    def cut(self) -> bool:
        return bool(self.levels)


def find_slots(
    census: DataFrame, key: str, order: Sequence[str], rows_per_slot: int = ROWS_PER_SLOT
) -> Slots:
    """Count the rows of every key; an eager pass over ``key`` and ``order`` only.

    What comes back to the driver is one row per hot key or slot, and each stands for more than
    ``rows_per_slot`` rows of the input. A further level looks at the rows of hot keys alone.
    """
    first, second = order[0], order[min(1, len(order) - 1)]
    slots = Slots(key, tuple(order), rows_per_slot, ())
    while len(slots.levels) < LEVELS:
        counted = census.withColumn(SLOT, F.lit(0).cast("long"))
        if slots.cut:
            counted = add_slots(census, slots).filter(F.col(SLOT) > 0)
        big = (
            counted.filter(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("_hot_key"), F.col(SLOT).alias("_hot_slot"))
            .agg(
                F.count(F.lit(1)).alias("_rows"),
                F.min(_axis(census, first)).alias("_low"),
                F.max(_axis(census, first)).alias("_high"),
                F.min(_axis(census, second)).alias("_low2"),
                F.max(_axis(census, second)).alias("_high2"),
            )
            .filter(F.col("_rows") > rows_per_slot)
            .filter("_low < _high OR _low2 < _high2")
        )
        rows = big.collect()
        if not rows:
            break
        found = census.sparkSession.createDataFrame(rows, big.schema)
        slots = Slots(key, tuple(order), rows_per_slot, (*slots.levels, found))
    return slots


def add_slots(df: DataFrame, slots: Slots) -> DataFrame:
    """Add a slot number that never decreases along the order within a key; 0 for ordinary keys.

    Rows with a NULL order value come first and belong to the first slot.
    """
    first, second = slots.order[0], slots.order[min(1, len(slots.order) - 1)]
    count = _slot_count(F.col("_rows"), slots.rows_per_slot)
    # All rows of the key at one moment: the next order column has to do the cutting.
    slot = F.when(
        F.col("_low") < F.col("_high"),
        _slot_number(_axis(df, first), F.col("_low"), F.col("_high"), count),
    ).otherwise(_slot_number(_axis(df, second), F.col("_low2"), F.col("_high2"), count))
    within = F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(slot)
    slotted = df.withColumn(SLOT, F.lit(0).cast("long"))
    for level in slots.levels:
        same = (F.col(slots.key) == F.col("_hot_key")) & (F.col(SLOT) == F.col("_hot_slot"))
        slotted = slotted.join(F.broadcast(level), same, "left").select(
            *df.columns, (F.col(SLOT) * BASE + within).cast("long").alias(SLOT)
        )
    return slotted


def _up_to_here(slots: Slots, *extra: str) -> str:
    return (
        f"(PARTITION BY {', '.join([slots.key, *extra])} ORDER BY {', '.join(slots.order)} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


def _earlier_slots(slots: Slots) -> str:
    return (
        f"(PARTITION BY {slots.key} ORDER BY {SLOT} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )


def running_sums(
    df: DataFrame, slots: Slots, measures: Sequence[str], before: bool = False
) -> DataFrame:
    """Replace each measure by its sum over the key's rows up to and including this one.

    ``before=True`` leaves the current row out, so a key's first row gets zeros.
    """
    wanted = set(measures)

    def running(frame):
        own = "- {0} " if before else ""
        text = f"sum({{0}}) OVER {frame} {own}AS {{0}}"
        return [text.format(c) if c in wanted else c for c in df.columns]

    if not slots.cut:
        return df.selectExpr(*running(_up_to_here(slots)))

    slotted = add_slots(df, slots)
    inside = slotted.selectExpr(*running(_up_to_here(slots, SLOT)), SLOT)
    per_slot = (
        slotted.filter(F.col(SLOT) > 0)
        .groupBy(slots.key, SLOT)
        .agg(*[F.expr(f"sum({m}) AS {m}") for m in measures])
    )
    earlier = _earlier_slots(slots)
    carried = per_slot.selectExpr(
        slots.key, SLOT, *[f"sum({m}) OVER {earlier} AS _before_{m}" for m in measures]
    )
    # The window left its output partitioned by (key, slot), so only the small side moves.
    return inside.join(carried, [slots.key, SLOT], "left").selectExpr(
        *[f"{c} + coalesce(_before_{c}, 0) AS {c}" if c in wanted else c for c in df.columns]
    )


def running_last(df: DataFrame, slots: Slots, value: str) -> DataFrame:
    """Replace ``value`` by its latest non-NULL occurrence up to this row of the key."""
    if not slots.cut:
        return df.withColumn(value, F.expr(f"last({value}, true) OVER {_up_to_here(slots)}"))

    slotted = add_slots(df, slots)
    last = f"last({value}, true) OVER {_up_to_here(slots, SLOT)}"
    inside = slotted.withColumn(value, F.expr(last))
    # max_by skips rows whose order is NULL; a slot without values yields NULL and passes on
    # what came before it.
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*slots.order)))
    per_slot = slotted.filter(F.col(SLOT) > 0).groupBy(slots.key, SLOT).agg(latest.alias("_last"))
    carried = per_slot.selectExpr(
        slots.key, SLOT, f"last(_last, true) OVER {_earlier_slots(slots)} AS _before"
    )
    return inside.join(carried, [slots.key, SLOT], "left").select(
        *[F.coalesce(value, "_before").alias(c) if c == value else F.col(c) for c in df.columns]
    )


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    start: Column | int = 0,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Consecutive numbers from ``start + 1`` along ``order`` without a single-task window.

    ``order`` has to be unique; its first two columns are numbers, texts, dates or timestamps. The
    numbers are the same however the rows are cut.
    """
    start = F.lit(start) if isinstance(start, int) else start
    axis = _axis(df, order[0])
    span = df.agg(F.count(F.lit(1)), F.min(axis), F.max(axis)).first()
    if span[0] <= rows_per_slot:
        place = F.row_number().over(Window.orderBy(*order))
        return df.withColumn(name, (start + place).cast("long"))

    rows, low, high = (F.lit(v) for v in span)
    part = _slot_number(axis, low, high, _slot_count(rows, rows_per_slot))
    parted = df.withColumn("_part", part.cast("long"))
    slots = find_slots(parted.select("_part", *order), "_part", order, rows_per_slot)
    slotted = add_slots(parted, slots)
    counts = slotted.groupBy("_part", SLOT).agg(F.count(F.lit(1)).alias("_n"))
    # One small row per slot goes through one task here.
    earlier = Window.orderBy("_part", SLOT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", SLOT, F.sum("_n").over(earlier).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part", SLOT).orderBy(*order))
    return slotted.withColumn("_place", place).join(offsets, ["_part", SLOT], "left").select(
        *df.columns,
        (start + F.coalesce("_offset", F.lit(0)) + F.col("_place")).cast("long").alias(name),
    )


def estimated_bytes(df: DataFrame) -> int:
    """The size Spark's own planner expects, the number its broadcast decision rests on."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    rows_per_task: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Join facts to a table that is unique on ``on``, whatever the key distribution of the facts.

    A table within Spark's broadcast limit is left to Spark, which broadcasts it. For a bigger one
    the facts' keys are counted first. Only the table rows of hot keys are copied, and the facts of
    such a key are spread over the copies by a hash of ``spread``; NULL keys, which match nothing,
    are spread as well.
    """
    on = list(on)
    if estimated_bytes(table) <= broadcast_limit(facts.sparkSession):
        return facts.join(table, on, how)
    return spread_lookup(facts, table, on, spread, how, rows_per_task)


def spread_lookup(facts, table, on, spread, how, rows_per_task):
    """``lookup`` for a table too big to broadcast."""
    hash_of_row = F.xxhash64(*spread)
    known = facts.dropna(subset=on)
    size = F.least(F.ceil(F.col("_rows") / F.lit(float(rows_per_task))), F.lit(MAX_COPIES))
    # Each row collected stands for more than `rows_per_task` facts.
    hot = (
        known.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .select(*on, size.cast("int").alias("_copies"))
    )
    rows = hot.collect()
    unmatched = F.lit(False)
    for c in on:
        unmatched = unmatched | F.col(c).isNull()
    anywhere = F.pmod(hash_of_row, F.lit(MAX_COPIES))
    if not rows:
        placed = facts.withColumn("_copy", F.when(unmatched, anywhere).otherwise(0).cast("int"))
        copied = table.withColumn("_copy", F.lit(0))
        return placed.join(copied, on + ["_copy"], how).drop("_copy")
    copies = F.broadcast(facts.sparkSession.createDataFrame(rows, hot.schema))
    share = F.pmod(hash_of_row, F.coalesce("_copies", F.lit(1)))
    placed = (
        facts.join(copies, on, "left")
        .withColumn("_copy", F.when(unmatched, anywhere).otherwise(share).cast("int"))
        .drop("_copies")
    )
    numbers = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    copied = table.join(copies, on, "left").withColumn("_copy", F.explode(numbers)).drop("_copies")
    return placed.join(copied, on + ["_copy"], how).drop("_copy")
