"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutlab.llm.common import ready_for_python, unpacked
from boutlab.sources.tables import stage

# Parts of a shard, by hash, that are summed before the first overflowing one is looked at.
PARTS = 1024
# Rows numbered in one task.
NUMBERED = 50_000


@dataclass(frozen=True)
class Ring:
    """``nodes`` virtual nodes for each of ``shards`` shards; no shard takes more than ``slack``
    above the mean."""

    shards: int = 8
    nodes: int = 256
    slack: float = 0.002

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted positions of the virtual nodes, and for each the shards met clockwise from it."""
        names = [b"shard %d node %d" % (s, n) for s in range(self.shards) for n in range(self.nodes)]
        place = np.array([xxhash.xxh64_intdigest(x) >> 1 for x in names], np.int64)
        order = np.argsort(place, kind="stable")
        owner = (order // self.nodes).tolist()
        met, following = list(range(self.shards)), np.zeros((len(owner), self.shards), np.int32)
        # Going backwards, the node's own shard moves to the front; twice round settles the start.
        for i in [*reversed(range(len(owner)))] * 2:
            met.remove(owner[i])
            met.insert(0, owner[i])
            following[i] = met
        return place[order], following


def clockwise(keys: DataFrame, ring: Ring) -> DataFrame:
    """Add ``_shards``, all shards in the order met clockwise from the key's place ``_place``."""
    ready_for_python(keys.sparkSession, 10_000)
    positions, following = ring.table()

    @F.pandas_udf("array<int>")
    def shards_of(place: pd.Series) -> pd.Series:
        at = np.searchsorted(positions, place.to_numpy()) % len(positions)
        return pd.Series(list(following[at]))

    return keys.withColumn("_shards", shards_of("_place"))


def shard(docs: DataFrame, ring: Ring = Ring(), passed_on: Sequence[str] | None = None) -> DataFrame:
    """Add ``size`` (bytes of the text plus 1), ``text_crc32``, ``shard`` and ``slot`` to every row.

    The key of a row is its text, so copies go together. A key belongs to the first shard clockwise
    from its place on the ring that has room for it; a full shard is passed by. Capacity is the mean
    load plus ``slack``, so sizes are near equal, and a further shard takes over only what lies
    before its nodes and what overflows differently.

    Groups above half the slack are few, at most twice the shards divided by the slack; the driver
    places them, largest first. All others are placed in rounds: each open key asks the next shard
    clockwise, and a shard takes them in order of their hash up to its room. To find that point only
    sums of 1,024 hash parts per shard are looked at, and then the rows of the one part that
    overflows. A group that no shard has room for is split into its rows, which are placed the same
    way by doc_id; what then still finds no room, as single rows above the slack do in small tables,
    goes to the emptiest shard, row by row of at most the shards' number.

    ``slot`` numbers the rows of a shard from 0 without gaps. A null text counts as an empty one in
    size and checksum (size 1, crc32 0); repeated rows share a key and get slots of their own; an
    empty table stays empty; the columns ``passed_on`` (all, if
    None) go along, one named like a result is replaced.
    """
    names = list(passed_on if passed_on is not None else docs.columns)
    text = F.coalesce("text", F.lit(""))
    rows = stage(
        docs.select(
            F.struct(*names).alias("_row"),
            F.col("doc_id").alias("_id"),
            # By text too: rows that share or lack a doc_id would be numbered in one task.
            F.xxhash64("doc_id", "text").alias("_row_hash"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("_key"),
        ),
        "sharded_rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = int(total / ring.shards * (1 + ring.slack)) + 1
    groups = stage(
        rows.groupBy("_key").agg(F.sum("size").alias("_weight"), F.count(F.lit(1)).alias("_rows")), "groups"
    )
    free = [capacity] * ring.shards
    placed, split = _place(groups.select("_key", "_weight"), "_key", free, ring, total)
    whole = rows.join(placed, "_key")
    if split is not None:
        single = stage(
            rows.join(split, "_key", "left_semi").withColumn(
                "_one", F.sha2(F.concat_ws(":", "_key", F.col("_id").cast("string")), 256)
            ),
            "split_groups",
        )
        ones = single.groupBy("_one").agg(F.sum("size").alias("_weight"))
        found, _ = _place(ones, "_one", free, ring, total, last=True)
        whole = whole.unionByName(single.join(found, "_one").drop("_one"))
    numbered = _number(stage(whole.drop("_key"), "placed_rows"))
    return unpacked(numbered, names, ["size", "text_crc32", "shard", "slot"])


def _place(
    keys: DataFrame, key: str, free: list[int], ring: Ring, total: int, last: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """(key, shard) of the keys that find room in ``free``, which shrinks; and the keys that do not."""
    spark = keys.sparkSession
    placed_on = F.conv(F.substring(key, 1, 15), 16, 10).cast("long") * F.lit(8)
    keys = clockwise(keys.withColumn("_place", placed_on), ring)
    big = max(1, int(total / ring.shards * ring.slack / 2))
    keys = stage(keys, "ring_keys")
    # At most 2 * shards / slack rows: each stands for that share of everything.
    large = sorted(
        keys.filter(F.col("_weight") > big).select(key, "_weight", "_shards").collect(),
        key=lambda r: (-r["_weight"], r[key]),
    )
    chosen, none = [], []
    for row in large:
        fit = [s for s in row["_shards"] if free[s] >= row["_weight"]]
        if not fit and last:
            fit = [max(range(ring.shards), key=lambda s: (free[s], -s))]
        if fit:
            free[fit[0]] -= row["_weight"]
            chosen.append((row[key], fit[0]))
        else:
            none.append((row[key],))
    schema = f"{key} string, shard int"
    done = [spark.createDataFrame(chosen, schema)]
    open_keys = keys.filter(F.col("_weight") <= big)
    for turn in range(ring.shards):
        asking = open_keys.withColumn("shard", F.col("_shards")[turn]).withColumn(
            "_part", F.shiftrightunsigned(F.xxhash64(key), 54).cast("int")
        )
        sums = asking.groupBy("shard", "_part").agg(F.sum("_weight").alias("_weight")).collect()
        if not sums:
            break
        room = list(free)
        limits, edge = {}, {}
        for row in sorted(sums, key=lambda r: (r["shard"], r["_part"])):
            s = row["shard"]
            if s in edge:
                continue
            if row["_weight"] <= room[s]:
                room[s] -= row["_weight"]
            else:
                edge[s] = (row["_part"], room[s])
        limits = spark.createDataFrame(
            [(s, edge.get(s, (PARTS, 0))[0], edge.get(s, (PARTS, 0))[1]) for s in range(ring.shards)],
            "shard int, _edge int, _room long",
        )
        bounded = asking.join(F.broadcast(limits), "shard")
        before = Window.partitionBy("shard", "_part").orderBy(F.xxhash64(key), key)
        at_edge = bounded.filter("_part = _edge").withColumn("_sum", F.sum("_weight").over(before))
        takes = bounded.filter("_part < _edge").withColumn("_sum", F.lit(0).cast("long")).unionByName(at_edge)
        taken = stage(takes.filter("_sum <= _room OR _part < _edge").select(key, "_weight", "shard"), "taken")
        for row in taken.groupBy("shard").agg(F.sum("_weight").alias("w")).collect():
            free[row["shard"]] -= row["w"]
        done.append(taken.select(key, "shard"))
        if not edge:
            open_keys = None
            break
        open_keys = stage(open_keys.join(taken.select(key), key, "left_anti"), "open_keys")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    rest = spark.createDataFrame(none, f"{key} string")
    if open_keys is not None:
        rest = rest.unionByName(open_keys.select(key))
    if rest.isEmpty():
        return placed, None
    if last:
        emptiest = max(range(ring.shards), key=lambda s: (free[s], -s))
        return placed.unionByName(rest.withColumn("shard", F.lit(emptiest))), None
    return placed, rest


def _number(rows: DataFrame) -> DataFrame:
    """Slots from 0 in every shard: numbers within hash parts, plus the sizes of earlier parts."""
    parts = max(1, rows.count() // NUMBERED)
    parted = rows.withColumn("_part", F.pmod(F.col("_row_hash"), F.lit(parts)).cast("int"))
    counts = parted.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_part").orderBy("_row_hash", "size", "text_crc32")
    numbered = parted.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "_part"]).withColumn("slot", (F.col("_offset") + F.col("_at")).cast("long"))
