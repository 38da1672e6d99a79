from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from boutlab.llm import simhash
from boutlab.llm.components import connected


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, distance=4):
    """Smallest position reachable from each."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                one, two = sorted((find(i), find(j)))
                root[two] = one
    return [find(i) for i in range(len(prints))]


def test_equals_brute_force(spark, documents, texts):
    near = "one two three four five six seven eight nine ten eleven twelve " * 30
    extra = [(10_000 + i, near + ("changed " * (i % 3)) + "end") for i in range(30)] + [(10_100, None), (10_101, " ")]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    known = sorted((texts | dict(extra)).items())
    prints = [_fingerprint(t) for _, t in known]
    expected = {i: (f"{p:016x}", known[c][0]) for (i, _), p, c in zip(known, prints, _components(prints), strict=True)}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == expected
    assert expected[10_100] == expected[10_101] and expected[10_100][0] == "0" * 16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 63)), max_size=60))
def test_links_connect_all_within_distance(base, flips):
    prints = list(base)
    for at, bit in flips:  # chains of small steps
        prints.append(prints[at % len(prints)] ^ (1 << bit) ^ (1 << (bit * 7 % 64)))
    prints = sorted(set(prints))
    table = simhash.distance_table(np.array(prints, np.uint64), simhash.pivots())
    links = list(simhash.links_within(np.array(prints, np.uint64), table, 4))
    assert all((a ^ b).bit_count() <= 4 for a, b in links) and len(links) < len(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        one, two = sorted((find(a), find(b)))
        root[two] = one
    assert [find(p) for p in prints] == [prints[c] for c in _components(prints)]


def test_hot_buckets_are_cut_without_loss(spark):
    rng = np.random.default_rng(5)
    centre, prints = int(rng.integers(1 << 62)), set()
    for _ in range(150):  # a dense group and its outliers, all in the same buckets
        bits = rng.integers(0, 20, rng.integers(1, 6))
        prints.add(centre ^ int(np.bitwise_or.reduce(1 << bits)))
    prints |= {int(x) for x in rng.integers(1 << 62, size=100)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    expected = {p: prints[c] for p, c in zip(prints, _components(prints), strict=True)}
    for block in (4096, 16):
        links = simhash.near_links(frame, block=block)
        roots = {r.node: r.root for r in connected(links).collect()}
        assert {p: roots.get(p, p) for p in prints} == expected


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected(links).collect()}
    assert Counter(roots.values()) == {0: 201, 500: 2}


def test_odd_rows(odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 6)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids.values()) == {1} and not ids.keys() & {2, 5, 6} and None in ids
    assert simhash.keep_one(odd_docs.limit(0)).count() == 0


def test_unlike_texts_stay_whatever_their_ids(spark):
    texts = ["a first text about rivers", "another one on mountains and snow", "the third says nothing new at all", "last of them, short"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (None, texts[3]), (9, texts[0])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert found == sorted([(9, texts[0]), (0, texts[1]), (5, texts[2]), (5, texts[3])])


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_go_and_unlike_texts_stay(spark):
    """Edited copies around a similarity of 0.8: nearly all pairs of 0.8 and more lose one, no other text goes."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for group in range(120):
        words = list(rng.choice(vocabulary, 220))
        for copy in range(3):
            changed = list(words)
            for at in rng.choice(220, rng.integers(0, 7), replace=False):
                changed[at] = f"x{group}_{copy}_{at}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows) + i, " ".join(rng.choice(vocabulary, 60))) for i in range(300)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = [_shingles(t) for _, t in rows]
    alike = {
        (i, j)
        for g in range(120)
        for i in range(3 * g, 3 * g + 3)
        for j in range(i)
        if j >= 3 * g and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    }
    assert len(alike) > 100
    assert sum(not {i, j} <= kept for i, j in alike) >= 0.9 * len(alike)
    # Whoever goes has a near copy.
    assert all(any(i in pair for pair in alike) for i, _ in rows if i not in kept)


def test_sketches_agree_as_often_as_sets_do_and_tables_grow():
    drawn = np.random.default_rng(4).integers(0, 1 << 63, 440, dtype=np.uint64) * np.uint64(2)
    one, other = drawn[:400], drawn[40:]  # 360 of 440 shared
    a, b = (np.frombuffer(simhash.sketch_of(x), np.uint8) for x in (one, other))
    assert abs((a == b).mean() - 360 / 440) < 0.15 and simhash.sketch_of(one[:0]) == bytes(simhash.SKETCH)
    wide = simhash.tables_for(10_000_000), simhash.tables_for(100)
    assert len(wide[0]) > len(wide[1]) and wide[0][0].bit_count() > wide[1][0].bit_count()


def _kept_by_brute_force(rows):
    """Smallest doc_id of every component of links at a similarity of 0.8."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            shared = len(one & sets[j])
            if 5 * shared >= 4 * (len(one) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[find(i)][0] for i in range(len(rows))}


def test_no_copy_at_the_threshold_is_left_out(spark):
    """Pairs just above and below 0.8, short and long, among frequent phrases; all links count."""
    rng = np.random.default_rng(18)
    vocabulary = [f"w{i}" for i in range(3000)]
    phrase = "as it was said before in this very place".split()
    rows = []
    for group in range(250):
        n = int(rng.choice([9, 14, 23, 24, 60, 220]))
        words = [*phrase, *rng.choice(vocabulary, n), *phrase] if group % 2 else list(rng.choice(vocabulary, n))
        for copy in range(3):
            changed = list(words)
            at = int(rng.integers(len(words)))
            # A stretch of new words costs its length and four shingles.
            width = max(0, int(len(words) * rng.uniform(0.04, 0.16)) - 4) if len(words) > 30 else int(rng.integers(0, 2))
            changed[at : at + width] = [f"x{group}_{copy}_{k}" for k in range(width)]
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows), "one two three four five six seven"), (len(rows) + 1, "one two three four five six seven eight")]
    rows += [(len(rows), "a b c d e f g h"), (len(rows) + 1, "a b c d e f g h i")]
    expected = _kept_by_brute_force(rows)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert 300 < len(expected) < len(rows) - 100
    assert kept == expected


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 20), st.integers(0, 20), st.integers(0, 2**32), st.floats(0, 0.6))
def test_prefixes_and_maps_never_part_sets_that_are_alike(both, left, right, seed, often):
    rng = np.random.default_rng(seed)
    drawn = np.unique(rng.integers(0, 1 << 63, both + left + right, dtype=np.uint64) * np.uint64(2))
    one = np.sort(drawn[: both + left])
    other = np.sort(np.concatenate([drawn[:both], drawn[both + left :]]))
    common = rng.permutation(drawn[rng.random(len(drawn)) < often])
    places = np.argsort(common)
    a, b = (simhash.prefix_of(s, common[places], places) for s in (one, other))
    if 5 * both < 4 * len(drawn):
        return
    rows = [
        np.array([[1, 1, len(one), a.tolist().index(h)], [2, 2, len(other), b.tolist().index(h)]])
        for h in set(a.tolist()) & set(b.tolist())
    ]
    assert any(len(simhash.pairs_alike(r)) for r in rows)
    assert not any(len(simhash.pairs_alike(r * [1, 0, 1, 1])) for r in rows)
    x, y = (np.frombuffer(simhash.parity_map(s), np.uint8) for s in (one, other))
    assert np.bitwise_count(x ^ y).sum() <= left + right


def test_hot_shingles_are_cut_without_loss(spark, monkeypatch):
    """Many texts of frequent shingles alone, in blocks of few."""
    phrases = ["the cat sat on the mat", "a dog ran in the park", "it was a day like any other", "we went home by bus"]
    rows = []
    for i in range(160):
        words = " ".join(phrases[(i * 7 + k * (1 + i % 3)) % 4] for k in range(3 + i % 6))
        rows.append((i, words + (f" only here {i}" if i % 2 else "")))
    expected = _kept_by_brute_force(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block, seen in ((4096, 16), (8, 1)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "SEEN", seen)
        assert {r.doc_id for r in simhash.keep_one(frame).collect()} == expected


def test_texts_of_links_decide(spark):
    """Links between texts, of which some appear often, against plain sets."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[: 40 - i] + [f"x{i}"] * (i % 3))) for i in range(12)] + [(12, ""), (13, " \n"), (14, "A B"), (15, "a b")]
    pairs = [(i, j) for i in range(16) for j in range(i + 1, 16)]
    texts_of = spark.createDataFrame(rows, "node long, text string").repartition(2)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in rows}

    def alike(x, y):
        return len(x & y) >= 0.8 * len(x | y)

    found = {(r.a, r.b) for r in simhash._similar(links, texts_of, 5).collect()}
    assert found == {(i, j) for i, j in pairs if alike(sets[i], sets[j])} and 0 < len(found) < len(pairs)
