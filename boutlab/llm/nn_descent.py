"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily, as Spark joins."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlab.llm.common import ready_for_python
from boutlab.sources.tables import remove, stage, stage_for_a_while


@dataclass(frozen=True)
class Settings:
    """``neighbours`` of every node in the graph; ``sample`` new and ``sample`` old ones, and as many that
    point to the node, meet in each round; rounds end when the share of neighbours that a round changed is
    at most ``settled``. ``trees`` random partitions into blocks of about
    ``block`` nodes give the first graph, each the ``first`` nearest of every node. A search keeps the best ``beam`` nodes and expands ``steps``
    of them at each of at most ``hops``. The vectors of at most ``together`` nodes and of all they meet are
    shuffled at once, which says how much disk that takes, not what is found."""

    neighbours: int = 32
    sample: int = 16
    settled: float = 0.01
    trees: int = 16
    block: int = 2048
    first: int = 12
    beam: int = 64
    steps: int = 16
    hops: int = 6
    entries: int = 32
    together: int = 200_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) that take part: of the commonest length, finite and not all zero.

    A repeated vec_id counts once, with the least of its vectors.
    """
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull()
        & F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
        & F.expr("exists(vector, x -> x <> 0)")
    )
    sizes = whole.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1)
    length = (sizes.first() or {"size": 0})["size"]
    return whole.filter(F.size("vector") == length).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """(node, vector, members): equal vectors are one node, with its ``most`` smallest vec_ids.

    Ids are ranked within 32 hash parts of a vector first, so a vector that a third of the rows share
    is no task of its own.
    """
    same = [F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")]
    keyed = vectors.select(*same, "vec_id", "vector").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    place = F.row_number().over(Window.partitionBy("a", "b", "part").orderBy("vec_id"))
    few = keyed.withColumn("place", place).filter(F.col("place") <= most)
    grouped = few.groupBy("a", "b").agg(
        F.min("vec_id").alias("node"),
        F.first("vector").alias("vector"),
        F.slice(F.sort_array(F.collect_list("vec_id")), 1, most).alias("members"),
    )
    return grouped.select("node", "vector", "members")


def _packed(vectors: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, np.float32).astype("<f2").tobytes() for v in vectors])


def _matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f2").reshape(len(packed), -1).astype(np.float32)


def lifted(nodes: DataFrame) -> DataFrame:
    """(node, code): vectors with one component more, after which all have the length of the longest.

    Then the largest inner product with a query, whose further component is 0, is also the
    smallest angle, and neighbours of neighbours are near in a true metric. All are scaled to length
    1 and kept as 16-bit numbers; final scores come from the vectors themselves.
    """
    square = F.expr("aggregate(vector, 0D, (a, x) -> a + x * x)")
    longest = nodes.agg(F.max(square)).first()[0] or 1.0
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("square") / F.lit(longest)))
    scaled = F.transform("vector", lambda x: x / F.lit(float(longest**0.5)))
    packed = F.pandas_udf(_packed, "binary")  # needs a session, so not at import
    return nodes.withColumn("square", square).select("node", packed(F.concat(scaled, F.array(rest))).alias("code"))


def _top(scored: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` best rows of every key, by score, then node; keys have few rows here."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "other"))
    return scored.withColumn("place", best).filter(F.col("place") <= most).drop("place")


def first_graph(codes: DataFrame, settings: Settings) -> tuple[DataFrame, str]:
    """(node, other, score), stored, and its path: the best neighbours inside the blocks of several random partitions.

    A partition puts nodes on the same sides of random hyperplanes together; what is still above the
    block size, such as a dense cluster, is dealt to several blocks by hash.
    """
    ready_for_python(codes.sparkSession, 4096)
    count = max(1, codes.count())
    planes = max(0, int(np.ceil(np.log2(count / settings.block))))
    trees, block = settings.trees, settings.block

    @F.pandas_udf("array<long>")
    def sides(code: pd.Series) -> pd.Series:
        rows = _matrix(code)
        rng = np.random.default_rng(11)
        found = []
        for _ in range(trees):
            normal = rng.normal(size=(rows.shape[1], max(1, planes))).astype(np.float32)
            bits = (rows @ normal > 0).astype(np.int64)[:, :planes]
            found.append(bits @ (1 << np.arange(planes, dtype=np.int64)))
        return pd.Series(list(np.stack(found, axis=1)))

    spark = codes.sparkSession
    placed, path = stage_for_a_while(codes.select("node", "code", F.posexplode(sides("code")).alias("tree", "side")), "blocks")
    sizes = placed.groupBy("tree", "side").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / F.lit(2.0 * block)).cast("int")
    dealt = placed.join(sizes.select("tree", "side", parts.alias("parts")), ["tree", "side"]).select(
        "tree", F.xxhash64("tree", "side", F.pmod(F.xxhash64("node", "tree"), F.col("parts"))).alias("block"), "node", "code"
    )
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A near node is among the first of any block it shares.
    most = settings.first

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _blocks(frames):
            ids, rows = frame.node.to_numpy(), _matrix(frame.code)
            if len(ids) < 2:
                continue
            k = min(most, len(ids) - 1)
            for at in range(0, len(ids), 256):  # some rows at a time, for little memory
                scores = rows[at : at + 256] @ rows.T
                own = np.arange(len(scores))
                scores[own, at + own] = -9
                near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                yield pd.DataFrame(
                    {
                        "node": np.repeat(ids[at : at + 256], k),
                        "other": ids[near].ravel(),
                        "score": np.take_along_axis(scores, near, axis=1).ravel(),
                    }
                )

    # Some partitions at a time; the best of all are among the best of each.
    some = max(1, trees * settings.together // count)
    best = []
    for at in range(0, trees, some):
        own = dealt.filter((F.col("tree") >= at) & (F.col("tree") < at + some)).drop("tree")
        gathered = own.repartition(shuffles, "block").sortWithinPartitions("block")
        found = gathered.mapInPandas(run, "node long, other long, score float").distinct()
        best.append(stage_for_a_while(_top(found, "node", settings.neighbours), "graph"))
    remove(spark, path)
    if len(best) == 1:
        return best[0]
    both = functools.reduce(DataFrame.unionByName, [x for x, _ in best]).distinct()
    whole = stage_for_a_while(_top(both, "node", settings.neighbours), "graph")
    for _, path in best:
        remove(spark, path)
    return whole


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks of rows that come sorted by block."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for key, part in frame.groupby("block", sort=False):
            if held and held[0].block.iloc[0] != key:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _meeting(graph: DataFrame, sample: int) -> DataFrame:
    """(node, meets): nodes that meet at each node, with whether they are new there.

    ``sample`` new and old neighbours each, and as many of those that point to the node. These are
    thinned by their number before they are ranked, so a node that many point to stays small.
    """
    u = F.pmod(F.xxhash64("node", "other"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ahead = graph.select("node", F.col("other").alias("meets"), "new", u.alias("u"))
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("meets"), "new", u.alias("u"))
    counts = back.groupBy("node", "new").agg(F.count(F.lit(1)).alias("n"))
    thinned = back.join(counts, ["node", "new"]).filter(F.col("u") * F.col("n") <= 3 * sample).drop("n")
    place = F.row_number().over(Window.partitionBy("node", "new").orderBy("u", "meets"))
    both = [x.withColumn("place", place).filter(F.col("place") <= sample) for x in (ahead, thinned)]
    meeting = both[0].unionByName(both[1])
    return meeting.groupBy("node", "meets").agg(F.max("new").alias("new"))


def descend(codes: DataFrame, graph: DataFrame, settings: Settings) -> tuple[DataFrame, str]:
    """One graph better than the last, stored, and its path: neighbours of a node are proposed to each other."""
    spark = codes.sparkSession
    ready_for_python(spark, 1024)
    meeting, path = stage_for_a_while(_meeting(graph, settings.sample), "meeting")
    held = [path]
    worst = graph.groupBy("node").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
    full = F.when(F.col("n") >= settings.neighbours, F.col("worst")).otherwise(F.lit(-9.0)).cast("float")
    floors = codes.join(worst, "node", "left").select(F.col("node").alias("meets"), "code", full.alias("floor"))
    best = 6

    def gathered(some: DataFrame) -> DataFrame:
        groups = some.join(floors, "meets").groupBy("node").agg(
            F.collect_list(F.struct("meets", "new", "code", "floor")).alias("all")
        )
        return groups.select("all.meets", "all.new", "all.code", "all.floor")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[tuple] = []
            for ids, new, code, floor in zip(frame.meets, frame.new, frame.code, frame.floor, strict=True):
                ids, new, floor = np.asarray(ids), np.asarray(new, bool), np.asarray(floor)
                if len(ids) < 2 or not new.any():
                    continue
                rows = _matrix(list(code))
                scores = rows @ rows.T
                scores[~(new[:, None] | new[None, :])] = -9
                np.fill_diagonal(scores, -9)
                scores[scores <= floor[:, None]] = -9
                k = min(best, len(ids) - 1)
                near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(scores, near, axis=1)
                one, at = np.nonzero(value > -9)
                found.append((ids[one], ids[near[one, at]], value[one, at]))
            if found:
                node, other, score = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"node": node, "other": other, "score": score})

    kind, proposed = "node long, other long, score float", []
    parts = max(1, -(-codes.count() // settings.together))
    for part in range(parts):
        some = meeting.filter(F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(parts)) == part) if parts > 1 else meeting
        best_of = gathered(some).mapInPandas(run, kind).groupBy("node", "other").agg(F.max("score").alias("score"))
        found, path = stage_for_a_while(best_of, "proposed")
        proposed.append(found)
        held.append(path)
    fresh = functools.reduce(DataFrame.unionByName, proposed).withColumn("new", F.lit(True))
    # A neighbour that has met the others of its node is old from now on.
    met = meeting.filter("new").select("node", F.col("meets").alias("other"), F.lit(True).alias("met"))
    kept = graph.join(met, ["node", "other"], "left").select(
        "node", "other", "score", (F.col("new") & F.col("met").isNull()).alias("new")
    )
    merged = kept.unionByName(fresh).groupBy("node", "other").agg(
        F.max("score").alias("score"), F.min("new").alias("new")
    )
    found = stage_for_a_while(_top(merged, "node", settings.neighbours), "graph")
    for path in held:
        remove(spark, path)
    return found


def build_graph(codes: DataFrame, settings: Settings) -> DataFrame:
    """(node, near): the neighbours of every node in the graph, and some of those it is one of."""
    spark = codes.sparkSession
    graph, path = first_graph(codes, settings)
    graph, changed = graph.withColumn("new", F.lit(True)), 1.0
    while changed > settings.settled:
        before, last = graph, path
        graph, path = descend(codes, graph, settings)
        fresh = graph.join(before.select("node", "other"), ["node", "other"], "left_anti").count()
        changed = fresh / max(1, graph.count())
        remove(spark, last)
    ahead = graph.select("node", "other")
    back = _meeting(graph.withColumn("new", F.lit(False)), settings.sample).select("node", F.col("meets").alias("other"))
    both = ahead.unionByName(back).distinct()
    near = stage(both.groupBy("node").agg(F.collect_list("other").alias("near")), "graph")
    remove(spark, path)
    return near


def _entries(codes: DataFrame, most: int) -> list[int]:
    """Nodes that every search starts from, by hash."""
    return [r.node for r in codes.select("node").orderBy(F.xxhash64("node"), "node").limit(most).collect()]


def greedy_search(queries: DataFrame, codes: DataFrame, graph: DataFrame, settings: Settings) -> DataFrame:
    """(query, beam) for queries (query, code, start): the best nodes found, as (score, node, open).

    A search starts from ``start``, an array of nodes, and from common entries. At each hop the best
    nodes not yet expanded are, all neighbours not seen before are scored, and the best ``beam`` stay.
    It ends when no open node is left in any beam, or after ``hops``.
    """
    spark = queries.sparkSession
    ready_for_python(spark, 4096)
    entries = F.array(*[F.lit(x) for x in _entries(codes, settings.entries)]).cast("array<long>")
    kind = "array<struct<score: float, node: bigint, open: boolean>>"
    state = queries.select(
        "query",
        "code",
        F.expr(f"cast(array() AS {kind})").alias("beam"),
        F.array_distinct(F.concat("start", entries)).alias("ask"),
        F.expr("cast(array() AS array<bigint>)").alias("seen"),
    )
    state, path = stage_for_a_while(state, "search")

    @F.pandas_udf("float")
    def inner(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", _matrix(a), _matrix(b)))

    for hop in range(settings.hops + 1):
        asked = state.select("query", F.col("code").alias("q"), F.explode("ask").alias("node"))
        scored = asked.join(codes, "node").select("query", "node", inner("q", "code").alias("score"))
        new = scored.groupBy("query").agg(
            F.collect_list(F.struct("score", "node", F.lit(True).alias("open"))).alias("new")
        )
        better = F.slice(
            F.sort_array(F.concat("beam", F.coalesce("new", F.expr(f"cast(array() AS {kind})"))), asc=False),
            1,
            settings.beam,
        )
        grown = state.join(new, "query", "left").select(
            "query", "code", better.alias("beam"), F.concat("seen", "ask").alias("seen")
        )
        chosen = F.slice(F.filter("beam", lambda x: x["open"]), 1, settings.steps if hop else settings.beam // 2)
        opened = grown.withColumn("expand", F.transform(chosen, lambda x: x["node"])).withColumn(
            "beam",
            F.transform(
                "beam",
                lambda x: F.struct(
                    x["score"].alias("score"),
                    x["node"].alias("node"),
                    (x["open"] & ~F.array_contains("expand", x["node"])).alias("open"),
                ),
            ),
        )
        last = path
        opened, path = stage_for_a_while(opened, "search")
        remove(spark, last)
        if hop == settings.hops or opened.filter(F.size("expand") > 0).isEmpty():
            return opened.select("query", "beam")
        around = (
            opened.select("query", F.explode("expand").alias("node"))
            .join(graph, "node")
            .select("query", F.explode("near").alias("near"))
            .groupBy("query")
            .agg(F.collect_set("near").alias("near"))
        )
        last = path
        state, path = stage_for_a_while(
            opened.drop("expand")
            .join(around, "query", "left")
            .withColumn("ask", F.coalesce(F.array_except("near", "seen"), F.expr("cast(array() AS array<bigint>)")))
            .drop("near"),
            "search",
        )
        remove(spark, last)
    raise AssertionError("the loop returns")


def search(vectors: DataFrame, is_query: Column, most: int = 20, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``most`` nearest rows of every row that ``is_query`` names.

    Nearest is the largest inner product, computed in double precision on the vectors themselves; ties
    go to the smaller vec_id, and a query is never its own neighbour. Every row is in the graph; equal
    vectors are one node of it and are told apart again at the end.

    Vectors that are null, empty, all zero, of another length than most, or that hold null or
    non-finite components take no part, as queries or neighbours; a repeated vec_id counts once, with
    the least of its vectors; a table of one row or none gives no rows; other columns are ignored.
    """
    ready_for_python(vectors.sparkSession, 4096)
    known = stage(usable(vectors), "vectors")
    nodes = stage(distinct_vectors(known, most + 1), "vector_nodes")
    codes = stage(lifted(nodes), "vector_codes")
    graph = build_graph(codes, settings)
    asking = known.filter(is_query).select("vec_id", F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))
    hashed = nodes.select("node", "vector", F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))
    owned = stage(asking.join(hashed, ["a", "b"]).select("vec_id", "node", "vector"), "queries")
    # One search for each node that is asked for, from that node; its own copies come back with it.
    once = owned.select("node").distinct().join(codes, "node").select(
        F.col("node").alias("query"), F.pandas_udf(_as_query, "binary")("code").alias("code"), F.array("node").alias("start")
    )
    found = greedy_search(once, codes, graph, settings)
    near = found.select("query", F.explode("beam").alias("x")).select("query", F.col("x.node").alias("node"))
    exact = F.expr("aggregate(zip_with(vector, other, (x, y) -> x * y), 0D, (a, x) -> a + x)")
    own = nodes.select(F.col("node").alias("query"), "vector")
    priced = (
        near.join(nodes.select("node", F.col("vector").alias("other"), "members"), "node")
        .join(own, "query")
        .select("query", exact.alias("score"), "members")
    )
    listed = owned.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(priced, "query")
    rows = listed.select("query_id", "score", F.explode("members").alias("vec_id")).filter("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = rows.withColumn("rank", place).filter(F.col("rank") <= most)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _as_query(codes: pd.Series) -> pd.Series:
    """A query's further component is 0."""
    return pd.Series([c[:-2] + b"\0\0" for c in codes])
