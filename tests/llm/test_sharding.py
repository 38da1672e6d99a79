import hashlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from boutlab.llm import sharding
from boutlab.llm.sharding import Ring, shard


def _loads(rows, shards):
    loads, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [loads[s] for s in range(shards)], homes


def test_loads_are_bounded_and_copies_together(documents):
    rows = shard(documents, Ring(slack=0.05)).collect()
    loads, homes = _loads(rows, 8)
    mean, largest = sum(loads) / 8, max(r.size for r in rows)
    assert max(loads) <= mean * 1.05 + largest
    assert all(len(s) == 1 for s in homes.values())
    assert all(r.size == len(r.text.encode()) + 1 for r in rows)


def test_small_rows_overflow_clockwise(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    rows = shard(docs, Ring(shards=5, nodes=16, slack=0.02)).collect()
    loads, _ = _loads(rows, 5)
    mean = sum(loads) / 5
    assert max(loads) <= mean * 1.02 + 1 and min(loads) > 0.9 * mean
    before = {r.doc_id: r.shard for r in rows}
    grown = {r.doc_id: r.shard for r in shard(docs, Ring(shards=6, nodes=16, slack=0.02)).collect()}
    moved = sum(before[i] != grown[i] for i in before) / len(before)
    assert moved < 0.5  # a plain modulus moves five sixths


def test_a_group_above_capacity_is_split(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text again', concat('own text ', id)) AS text")
    rows = shard(docs, Ring(slack=0.05)).collect()
    loads, homes = _loads(rows, 8)
    assert len(rows) == 3_000
    assert max(loads) <= sum(loads) / 8 * 1.06 + 25
    assert len(homes["the same text again"]) > 1


def test_odd_rows(odd_docs, spark):
    found = shard(odd_docs)
    assert set(found.columns) >= set(odd_docs.columns)
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    _loads(rows, 8)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    assert shard(odd_docs.limit(0)).count() == 0
    tied = spark.createDataFrame([(1, "same")] * 40, "doc_id long, text string")
    _loads(shard(tied).collect(), 8)


def _met(key, ring):
    """Shards in the order in which a walk from the key's place passes their nodes."""
    nodes = sorted(
        (xxhash.xxh64_intdigest(b"shard %d node %d" % (s, n)) >> 1, s) for s in range(ring.shards) for n in range(ring.nodes)
    )
    place = int(key[:15], 16) * 8
    return list(dict.fromkeys([s for p, s in nodes if p >= place] + [s for _, s in nodes]))


def _walk(weights, free, ring, total, last=False):
    """Homes of keys, one after another, and the keys that no shard has room for."""
    met = {k: _met(k, ring) for k in weights}
    big = max(1, int(total / ring.shards * ring.slack / 2))
    homes, none = {}, []
    for key in sorted((k for k in weights if weights[k] > big), key=lambda k: (-weights[k], k)):
        fit = [s for s in met[key] if free[s] >= weights[key]]
        if not fit and last:
            fit = [free.index(max(free))]
        if not fit:
            none.append(key)
            continue
        homes[key] = fit[0]
        free[fit[0]] -= weights[key]
    waiting = sorted((k for k in weights if weights[k] <= big), key=lambda k: xxhash.xxh64_intdigest(k, seed=42))
    for turn in range(ring.shards):
        full, passed = set(), []
        for key in waiting:
            s = met[key][turn]
            if s in full or weights[key] > free[s]:
                full.add(s)
                passed.append(key)
            else:
                homes[key] = s
                free[s] -= weights[key]
        waiting = passed
    if last:
        emptiest = free.index(max(free))
        return homes | dict.fromkeys(waiting, emptiest), []
    return homes, none + waiting


def _hex(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plain(rows, ring):
    """Shard of every (doc_id, text), for unique doc_ids."""
    size = {i: len(t.encode()) + 1 for i, t in rows}
    weights, total = Counter(), sum(size.values())
    for i, t in rows:
        weights[_hex(t)] += size[i]
    free = [int(total / ring.shards * (1 + ring.slack)) + 1] * ring.shards
    homes, rest = _walk(weights, free, ring, total)
    ones = {_hex(f"{_hex(t)}:{i}"): size[i] for i, t in rows if _hex(t) in rest}
    singles = _walk(ones, free, ring, total, last=True)[0]
    return {i: homes[_hex(t)] if _hex(t) in homes else singles[_hex(f"{_hex(t)}:{i}")] for i, t in rows}


def test_shards_equal_a_plain_walk(spark):
    many = [(i, f"key number {i * 7919 % 1500} of many") for i in range(2_000)]
    hot = [(i, "the same text again" if i % 3 == 0 else f"own text {i} " + "long " * (i % 40)) for i in range(300)]
    for rows, ring in ((many, Ring(shards=5, nodes=8, slack=0.05)), (hot, Ring())):
        found = shard(spark.createDataFrame(rows, "doc_id long, text string"), ring).collect()
        assert {r.doc_id: r.shard for r in found} == _plain(rows, ring)


def test_rows_without_an_id_are_numbered_in_many_parts(spark, monkeypatch):
    given, number = [], sharding._number
    monkeypatch.setattr(sharding, "NUMBERED", 100)
    monkeypatch.setattr(sharding, "_number", lambda rows: given.append(rows) or number(rows))
    docs = spark.range(2_000).selectExpr("if(id % 2 = 0, null, id) AS doc_id", "concat('text ', id) AS text")
    rows = shard(docs, Ring(slack=0.05)).collect()
    assert len(rows) == 2_000
    _loads(rows, 8)
    parts = given[0].groupBy("shard", F.pmod("_row_hash", F.lit(20))).count()
    assert parts.agg(F.max("count")).first()[0] < 50
