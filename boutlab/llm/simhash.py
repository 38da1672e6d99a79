"""Near-duplicates by SimHash fingerprints, compared through tables of distances to pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlab.llm.common import carried, ready_for_python, texts
from boutlab.llm.components import connected
from boutlab.operators.skew import lookup
from boutlab.sources.tables import stage

SHINGLE = 4
DISTANCE = 4
SEED = 42
PIVOTS = 24
# Copies whose texts differ: words of a shingle, least Jaccard similarity, bits their fingerprints differ
# in at most, and how often two with ``USUAL`` differing bits share no table. Prefixes find those.
COPY_SHINGLE = 5
SIMILAR = 0.8
WIDE, USUAL, MISSED = 14, 10, 0.3
# Places of a sketch, and the share of them that has to agree before texts are compared.
SKETCH, ALIKE = 64, 0.68
# Bits of a parity map, the leading ones of a shingle's hash.
PARITY = 9
# Shingles that come last in prefixes, and how they are found: among so many at once, those of so many texts.
FREQUENT, COUNTED, OFTEN = 65_536, 1 << 21, 4
# One in so many texts is counted to see which prefix shingles are hot.
SEEN = 16
# Fingerprints that one task compares with each other at once; larger buckets are cut.
BLOCK = 4096


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, repeats included; none for a text without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)],
        np.uint64,
    )


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    return majority_bits(shingle_hashes(text, shingle))


def majority_bits(hashes: np.ndarray) -> int:
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as long) of every row; a text without words has fingerprint 0."""
    ready_for_python(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [fingerprint_of(t.encode("utf-8", "surrogatepass"), shingle) for t in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id, "fingerprint": np.array(found, np.uint64).view(np.int64)})

    return texts(docs).mapInPandas(run, "doc_id long, fingerprint long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers, so every run has the same."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(count)], np.uint64)


def distance_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint (rows) to every pivot (columns)."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def links_within(
    prints: np.ndarray, table: np.ndarray, distance: int, ids: np.ndarray | None = None
) -> Iterator[tuple[int, int]]:
    """Links that join everything within ``distance`` of each other, at most one per fingerprint.

    Grows one component after another: of the fingerprints not yet reached, those whose pivot
    distances all lie within ``distance`` of the current one's are verified and leave the rest. A
    dense group so takes one look at each member, not one at each pair. Links name ``ids``, by default
    the fingerprints.
    """
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    ids = prints if ids is None else ids[order]
    while len(prints):
        found, prints, table, ids = [(prints[0], table[0], ids[0])], prints[1:], table[1:], ids[1:]
        while found and len(prints):
            one, place, name = found.pop()
            low, high = np.searchsorted(table[:, 0], [place[0] - distance, place[0] + distance + 1])
            near = np.arange(low, high)
            for k in range(1, table.shape[1], 4):
                if len(near) < 16:
                    break
                near = near[(np.abs(table[near, k : k + 4] - place[k : k + 4]) <= distance).all(axis=1)]
            near = near[np.bitwise_count(prints[near] ^ one) <= distance]
            if len(near):
                yield from ((int(name), int(x)) for x in ids[near])
                found += list(zip(prints[near], table[near], ids[near], strict=True))
                rest = np.ones(len(prints), bool)
                rest[near] = False
                prints, table, ids = prints[rest], table[rest], ids[rest]


def near_links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within ``distance`` bits.

    64 bits are cut into ``distance + 2`` blocks. Two fingerprints within ``distance`` agree on at
    least two blocks, so buckets by each pair of blocks bring every such pair together. Inside a bucket the
    pivot tables discard pairs by their largest coordinate difference, and Hamming distance verifies
    the rest. A bucket of more than ``block`` fingerprints is cut into parts, and each two of its
    parts meet in a task of their own: no pair is left out and no task takes a whole hot bucket.
    """
    spark = prints.sparkSession
    ready_for_python(spark, 10_000)
    bounds = np.linspace(0, 64, distance + 3).astype(int)
    masks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(bounds, bounds[1:], strict=False)]
    both = [masks[i] | masks[j] for i in range(len(masks)) for j in range(i)]
    signed = [m - (1 << 64) if m >> 63 else m for m in both]
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits"))
            for i, m in enumerate(signed)
        ]
    )
    placed = prints.select("fingerprint", F.explode(keys).alias("key")).select("fingerprint", "key.i", "key.bits")
    # Only buckets of two or more have work to do; few are.
    sizes = placed.groupBy("i", "bits").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    sizes = stage(sizes, "bucket_sizes")
    parts = F.ceil(F.col("_size") / F.lit(float(block))).cast("int")
    shared = (
        placed.join(sizes, ["i", "bits"])
        .withColumn("_parts", parts)
        .withColumn("_part", F.pmod(F.xxhash64("fingerprint"), F.col("_parts")).cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    met = shared.withColumn("_other", other).select(
        F.xxhash64("i", "bits", F.least("_part", "_other"), F.greatest("_part", "_other")).alias("bucket"),
        "fingerprint",
    )
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gathered = met.repartition(shuffles, "bucket").sortWithinPartitions("bucket", "fingerprint")
    references = pivots()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket in _whole_buckets(frames):
            numbers = np.unique(bucket).view(np.uint64)
            found = list(links_within(numbers, distance_table(numbers, references), distance))
            if found:
                yield pd.DataFrame(np.array(found, np.uint64).view(np.int64), columns=["a", "b"])

    return gathered.mapInPandas(run, "a long, b long").distinct()


def _whole_buckets(frames: Iterator[pd.DataFrame], values_of: str | list[str] = "fingerprint") -> Iterator[np.ndarray]:
    """The fingerprints, or other columns, of one bucket after another; rows come sorted by bucket."""
    key, held = None, []
    for frame in frames:
        buckets, values = frame.bucket.to_numpy(), frame[values_of].to_numpy()
        edges = np.flatnonzero(np.diff(buckets)) + 1
        for at, part in zip([0, *edges.tolist()], np.split(values, edges), strict=True):
            if len(part) and buckets[at] != key:
                if held:
                    yield np.concatenate(held)
                key, held = buckets[at], []
            held.append(part)
    if held:
        yield np.concatenate(held)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints link at ``distance`` or fewer differing bits; a component holds all that links
    reach, and is named by its smallest doc_id. Equal fingerprints are one before anything is
    compared, so copies never become pairs; components are found by joins on linked fingerprints.

    A null text counts as an empty one; texts without words share fingerprint 0; repeated rows give
    a row each; a null doc_id is never the name of a component unless no other is in it; an empty
    table gives no rows.
    """
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("_least"))
    distinct = stage(distinct, "distinct_fingerprints")
    roots = connected(near_links(distinct, distance))
    groups = stage(
        distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
            "fingerprint", F.coalesce("root", "fingerprint").alias("_root"), "_least"
        ),
        "fingerprint_groups",
    )
    # Only roots that joined several fingerprints need more than their own least id.
    names = stage(groups.groupBy("_root").agg(F.min("_least").alias("component_id")), "component_names")
    named = stage(groups.join(names, "_root").select("fingerprint", "component_id"), "named_fingerprints")
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def sketch_of(hashes: np.ndarray) -> bytes:
    """Least values of the shingles under ``SKETCH`` orders, a byte each; places agree as often as sets do."""
    if not len(hashes):
        return bytes(SKETCH)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    factors = np.array([xxhash.xxh64_intdigest(b"order %d" % i, SEED) | 1 for i in range(SKETCH)], np.uint64)
    for at in range(0, len(hashes), 4096):
        turned = hashes[at : at + 4096, None] * factors[None, :]
        least = np.minimum(least, (turned ^ (turned >> np.uint64(29))).min(axis=0))
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def tables_for(rows: int) -> list[int]:
    """Masks of sampled bits, so many that two fingerprints ``USUAL`` bits apart share one in 70 of 100 cases.

    A table's bits grow with the logarithm of the rows, which keeps its buckets small, and the number of
    tables with the bits, which keeps that share.
    """
    bits = max(8, (max(rows, 1) - 1).bit_length() - 4)
    shared = math.comb(64 - USUAL, bits) / math.comb(64, bits)
    count = math.ceil(math.log(MISSED) / math.log(1 - shared))
    rng = np.random.default_rng(SEED)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(count)]


def _copy_links(distinct: DataFrame, rows: int) -> DataFrame:
    """Candidate links (a, b) between nodes: buckets by sampled bits, pivot tables inside, then sketches.

    Only nodes and fingerprints go to the buckets; sketches are joined to the links that come out.
    """
    spark = distinct.sparkSession
    ready_for_python(spark, 10_000)
    masks = tables_for(rows)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    placed = distinct.select("node", "fingerprint", F.explode(keys).alias("bucket"))
    # Hot buckets are cut like those of ``near_links``: each two of their parts meet.
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > BLOCK)
    parts = F.ceil(F.coalesce("_size", F.lit(1)) / F.lit(float(BLOCK))).cast("int")
    shared = lookup(placed, stage(sizes, "bucket_sizes"), ["bucket"], ["node"]).withColumn("_parts", parts)
    part = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    met = shared.withColumn("_part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    keyed = met.select(
        F.xxhash64("bucket", F.least("_part", "_other"), F.greatest("_part", "_other")).alias("bucket"), "node", "fingerprint"
    )
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gathered = keyed.repartition(shuffles, "bucket").sortWithinPartitions("bucket", "node")
    references = pivots()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket in _whole_buckets(frames, ["node", "fingerprint"]):
            ids, first = np.unique(bucket[:, 0], return_index=True)
            prints = bucket[first, 1].view(np.uint64)
            # Most buckets hold strangers only.
            if len(ids) <= 32 and (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= WIDE).sum() == len(ids):
                continue
            found = list(links_within(prints, distance_table(prints, references), WIDE, ids))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    links = stage(gathered.mapInPandas(run, "a long, b long").distinct(), "near_nodes")
    one = links.join(distinct.select(F.col("node").alias("a"), F.col("sketch").alias("_a")), "a")
    both = one.join(distinct.select(F.col("node").alias("b"), F.col("sketch").alias("_b")), "b")
    ready_for_python(spark, 10_000)

    def alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, b = (np.frombuffer(b"".join(frame[c]), np.uint8).reshape(-1, SKETCH) for c in ("_a", "_b"))
            yield frame.loc[(a == b).mean(axis=1) >= ALIKE, ["a", "b"]]

    return both.mapInPandas(alike, "a long, b long")


def frequent_shingles(docs: DataFrame, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """At most ``FREQUENT`` shingles that most texts share, the most frequent last.

    They only set the order of prefixes, which any order serves: it keeps frequent ones out. A task counts
    ``COUNTED`` shingles at a time, equal sets once.
    """
    ready_for_python(docs.sparkSession, 256)

    def often(held: list[np.ndarray]) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        kept = counts >= OFTEN
        return pd.DataFrame({"shingle": values[kept].view(np.int64), "n": counts[kept]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for frame in frames:
            for text in frame.text:
                found = np.unique(shingle_hashes(text.encode("utf-8", "surrogatepass"), shingle))
                name = set_name(found)
                if name not in held:
                    held[name] = found
                    size += len(found)
            if size >= COUNTED:
                yield often(list(held.values()))
                held, size = {}, 0
        if held:
            yield often(list(held.values()))

    counted = texts(docs).select("text").mapInPandas(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    return np.array([r.shingle for r in reversed(most)], np.int64).view(np.uint64)


def set_name(shingles: np.ndarray) -> int:
    """A number for a set, given as its sorted hashes."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def parity_map(shingles: np.ndarray) -> bytes:
    """Whether an even or odd number of a set's hashes start with the same bits.

    Two maps differ in no more bits than the sets have elements of which the other has none.
    """
    counts = np.bincount((shingles >> np.uint64(64 - PARITY)).astype(np.int64), minlength=1 << PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first shingles of a set, so many that two sets alike by ``SIMILAR`` have one in common among theirs.

    Frequent ones come last: ``frequent`` has them sorted, ``places`` their places in that order.
    """
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        place = np.where(frequent[at] == shingles, places[at], -1)
        shingles = shingles[np.argsort(place, kind="stable")]
    return shingles[: len(shingles) - _ceiling(SIMILAR * len(shingles)) + 1]


def _ceiling(number: float) -> int:
    return math.ceil(number - 1e-9)


def pairs_alike(rows: np.ndarray) -> np.ndarray:
    """Pairs of nodes that share a prefix shingle and may be alike; ``rows`` are (node, root, size, place).

    Only nodes of different roots are compared. A pair is left to another bucket if what follows the shingle in
    one of them is too short: the first shingle that both have always has enough behind it.
    """
    if (rows[:, 1] == rows[0, 1]).all():
        return rows[:0, :2]
    rows = rows[np.argsort(rows[:, 2], kind="stable")]
    node, root, size, place = rows.T
    behind = size - place
    last = np.searchsorted(size, np.floor(size / SIMILAR + 1e-9), side="right")
    found = []
    for i in range(len(rows) - 1):
        to = slice(i + 1, last[i])
        enough = np.minimum(behind[i], behind[to]) >= SIMILAR / (1 + SIMILAR) * (size[i] + size[to]) - 1e-9
        other = node[to][enough & (root[to] != root[i])]
        if len(other):
            found.append(np.column_stack([np.full(len(other), node[i]), other]))
    return np.concatenate(found) if found else rows[:0, :2]


def _shared_buckets(frames: Iterator[pd.DataFrame], values_of: list[str]) -> Iterator[np.ndarray]:
    """Like ``_whole_buckets``, but only buckets of two rows and more."""
    held = None
    for frame in frames:
        rows = frame[["bucket", *values_of]].to_numpy()
        rows = rows if held is None else np.concatenate([held, rows])
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 0])) + 1])
        longer = np.flatnonzero(np.diff(starts) > 1)
        for a, b in zip(starts[longer].tolist(), starts[longer + 1].tolist(), strict=True):
            yield rows[a:b, 1:]
        held = rows[starts[-1] :]
    if held is not None and len(held) > 1:
        yield held[:, 1:]


def _prefix_links(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """All links (a, b) between nodes of different roots whose texts can be alike.

    Two sets alike share a shingle of their prefixes, so buckets by these bring every such pair together; sizes, places
    in the prefix and parity maps then rule out pairs that cannot be alike, and no others. Nodes that are known
    to be of one group are not compared, so a group of near copies makes no pairs. Buckets are numbered by half a
    shingle's hash: shingles that share it only bring more nodes together.
    """
    spark = distinct.sparkSession
    ready_for_python(spark, 10_000)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rooted = distinct.join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "size", F.posexplode("prefix").alias("place", "bucket")
    )
    # A hot bucket is cut into parts that all meet; how hot it is, a part of the texts shows.
    some = rooted.filter(F.pmod(F.xxhash64("node"), F.lit(SEEN)) == 0).groupBy("bucket")
    seen = some.agg(F.count(F.lit(1)).alias("_seen"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    hot = seen.filter((F.col("_seen") * SEEN > BLOCK) & (F.col("_low") < F.col("_high"))).select("bucket", "_seen")
    parts = F.ceil(F.coalesce("_seen", F.lit(0)) * SEEN / F.lit(float(BLOCK))).cast("int")
    shared = lookup(rooted, stage(hot, "hot_shingles"), ["bucket"], ["node"]).withColumn("_parts", F.greatest(parts, F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    met = shared.withColumn("_part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    pair = F.xxhash64("bucket", F.least("_part", "_other"), F.greatest("_part", "_other"))
    keyed = met.select(
        F.when(F.col("_parts") == 1, F.col("bucket")).otherwise(pair).alias("bucket"),
        "node", "root", F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("measures"),
    )
    gathered = keyed.repartition(shuffles, "bucket").sortWithinPartitions("bucket")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket in _shared_buckets(frames, ["node", "root", "measures"]):
            size, place = bucket[:, 2] >> 32, bucket[:, 2] & 0xFFFFFFFF
            found = pairs_alike(np.column_stack([bucket[:, :2], size, place]))
            if len(found):
                yield pd.DataFrame(np.sort(found, axis=1), columns=["a", "b"])

    links = stage(gathered.mapInPandas(run, "a long, b long").distinct(), "prefix_pairs")
    one = links.join(distinct.select(F.col("node").alias("a"), F.col("parity").alias("_a"), F.col("size").alias("_m")), "a")
    both = one.join(distinct.select(F.col("node").alias("b"), F.col("parity").alias("_b"), F.col("size").alias("_n")), "b")
    ready_for_python(spark, 10_000)

    def possible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, b = (np.frombuffer(b"".join(frame[c]), np.uint8).reshape(len(frame), -1) for c in ("_a", "_b"))
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            most = (1 - SIMILAR) / (1 + SIMILAR) * (frame._m + frame._n).to_numpy() + 1e-9
            yield frame.loc[apart <= most, ["a", "b"]]

    return both.mapInPandas(possible, "a long, b long")


def _similar(links: DataFrame, texts_of: DataFrame, shingle: int) -> DataFrame:
    """The links whose texts share ``SIMILAR`` of their shingles.

    Texts travel, not their shingles: eight bytes a word that no codec makes smaller.
    """
    ready_for_python(links.sparkSession, 256)
    one = links.join(texts_of.select(F.col("node").alias("a"), F.col("text").alias("_a")), "a")
    both = one.join(texts_of.select(F.col("node").alias("b"), F.col("text").alias("_b")), "b")

    def alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Rows of one node often follow each other.
            sets: dict[int, np.ndarray] = {}
            kept = np.zeros(len(frame), bool)
            for i, row in enumerate(frame.itertuples(index=False, name=None)):
                for node, text in zip(row[:2], row[2:], strict=True):
                    if node not in sets:
                        sets[node] = np.unique(shingle_hashes(text.encode("utf-8", "surrogatepass"), shingle))
                x, y = sets[row[0]], sets[row[1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                kept[i] = shared >= SIMILAR * (len(x) + len(y) - shared)
            yield frame.loc[kept, ["a", "b"]]

    return both.select("a", "b", "_a", "_b").mapInPandas(alike, "a long, b long")


def keep_one(docs: DataFrame, shingle: int = COPY_SHINGLE) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id, with its columns.

    Two texts are near copies if they share at least 0.8 of their five-word shingles (Jaccard), and a group is
    what such links reach; none is left out. First candidates come from SimHash fingerprints that agree on sampled
    bits, within ``WIDE`` bits by pivot distance tables and Hamming distance; a sketch of the shingles leaves out
    strangers, and the texts themselves decide. Inside a bucket a group takes one link per member. What these
    miss is found by prefixes: texts of different groups that share one of their first shingles are candidates
    too, unless their sizes, or parity maps, rule it out. Texts with the same set of shingles are one from the start.

    Rows that share a doc_id, or have none, are compared by their texts like any others. A null doc_id comes
    after all others, equal ones are ordered by the checksum of the text, and of rows alike in both any one
    stays. Null and empty texts have no words and are one group; an empty table stays empty.
    """
    spark = docs.sparkSession
    common = frequent_shingles(docs, shingle)
    places = np.argsort(common).astype(np.int32)
    frequent = common[places]
    ready_for_python(spark, 256)

    def profile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = [shingle_hashes(t.encode("utf-8", "surrogatepass"), shingle) for t in frame.text]
            prints = np.array([majority_bits(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            yield frame[["doc_id", "md5"]].assign(
                fingerprint=prints,
                sketch=[sketch_of(h) for h in hashes],
                node=np.array([set_name(s) for s in sets], np.uint64).view(np.int64),
                size=[len(s) for s in sets],
                parity=[parity_map(s) for s in sets],
                prefix=[(prefix_of(s, frequent, places) >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets],
            )

    text = F.coalesce("text", F.lit(""))
    given = docs.select("doc_id", text.alias("text"), F.md5(text).alias("md5"))
    columns = "fingerprint long, sketch binary, node long, size int, parity binary, prefix array<int>"
    marked = given.mapInPandas(profile, f"doc_id long, md5 string, {columns}")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5")
    of_set = [F.first(c).alias(c) for c in ("fingerprint", "sketch", "size", "parity", "prefix")]
    distinct = marked.groupBy("node").agg(*of_set, F.min(name).alias("first"))
    # From here on nodes have small numbers, which travel often.
    distinct = stage(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct_profiles")
    nothing = F.lit(-(1 << 63))
    keyed = carried(docs).select(
        "_row", F.coalesce("_row.doc_id", nothing).alias("_id"), F.md5(F.coalesce("_row.text", F.lit(""))).alias("_md5")
    )
    named = distinct.select("node", F.coalesce("first.doc_id", nothing).alias("_id"), F.col("first.md5").alias("_md5"), "first")

    def verified(links: DataFrame) -> DataFrame:
        """The links whose texts are alike, stored; texts are read again for the nodes of links alone."""
        links = stage(links, "copy_candidates")
        wanted = named.join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        # Stored, so that texts need not travel if the links are few.
        wanted = stage(wanted.select("node", "_id", "_md5"), "wanted_texts")
        texts_of = keyed.select("_id", "_md5", F.coalesce("_row.text", F.lit("")).alias("text")).join(
            wanted, ["_id", "_md5"]
        ).dropDuplicates(["node"])
        return stage(_similar(links, stage(texts_of.select("node", "text"), "copy_texts"), shingle), "copy_links")

    near = verified(_copy_links(distinct, distinct.count()))
    # Stored, so that prefixes need not travel to them while they are few.
    roots = stage(connected(near), "near_groups")
    rest = verified(_prefix_links(distinct, roots))
    if not rest.isEmpty():
        roots = connected(near.unionByName(rest))
    rooted = named.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("_root"))
    chosen = rooted.agg(F.min("first").alias("first")).select(
        F.coalesce("first.doc_id", nothing).alias("_id"), F.col("first.md5").alias("_md5")
    )
    chosen = stage(chosen, "first_rows")
    return keyed.join(chosen, ["_id", "_md5"], "left_semi").dropDuplicates(["_id", "_md5"]).select("_row.*")
