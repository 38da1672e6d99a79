import numpy as np
from pyspark.sql import functions as F

from boutlab.llm import nn_descent
from boutlab.llm.nn_descent import Settings, search
from boutlab.sources import tables


def _exact(ids, vectors, query, most=20):
    scores = vectors @ vectors[ids.index(query)]
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-scores[i], ids[i]))[:most]
    return {ids[i]: scores[i] for i in order}


def _recall(rows, ids, vectors, most=20):
    found, hits, wanted = {}, 0, 0
    for r in rows:
        found.setdefault(r.query_id, []).append(r)
    for query, near in found.items():
        near.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in near] == list(range(1, len(near) + 1))
        assert [(-r.score, r.vec_id) for r in near] == sorted((-r.score, r.vec_id) for r in near)
        exact = _exact(ids, vectors, query, most)
        for r in near:
            assert abs(r.score - vectors[ids.index(query)] @ vectors[ids.index(r.vec_id)]) < 1e-9
        hits += len(exact.keys() & {r.vec_id for r in near})
        wanted += len(exact)
    return hits / wanted, found


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    # Small blocks, so that the graph has to be descended.
    settings = Settings(block=64, trees=3)
    recall, found = _recall(search(table, F.col("vec_id") % 20 == 0, settings=settings).collect(), ids, vectors)
    assert recall >= 0.9
    assert sorted(found) == sorted(i for i in ids if i % 20 == 0)
    assert all(len(x) == 20 for x in found.values())


def test_lengths_matter_for_inner_products(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 8)) * rng.lognormal(0, 0.7, (600, 1))
    vectors = vectors.astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    recall, _ = _recall(search(table, F.col("vec_id") % 20 == 0).collect(), list(range(600)), vectors)
    assert recall >= 0.9


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 300)] + [(1000 + i, [0.0, 1.0, float(i + 1)]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = search(table, F.col("vec_id") % 100 == 0).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r.vec_id)
    assert by_query[0] == list(range(1, 21)) and by_query[100] == list(range(20)) and by_query[200] == list(range(20))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "x"), (1, [0.5, 0.5], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [nan, 1.0], "x"),
        (5, [inf, 1.0], "x"), (6, [1.0, None], "x"), (7, [1.0], "x"), (8, [], "x"), (1, [0.5, 0.5], "x"), (None, [1.0, 1.0], "x"),
        (20, [-1.0, 0.0], "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = search(table, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(found)] == [
        (0, 1, 1, 0.5), (0, 2, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 0, -1.0)
    ]
    assert search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert search(table.limit(1), F.col("vec_id") % 20 == 0).count() == 0


def test_rounds_go_on_until_the_graph_settles(spark, monkeypatch):
    """From a poor first graph, two rounds are too few."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 8))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rounds, once = [], nn_descent.descend
    monkeypatch.setattr(nn_descent, "descend", lambda *a: rounds.append(1) or once(*a))
    settings = Settings(block=16, trees=3, first=2)
    recall, _ = _recall(search(table, F.col("vec_id") % 20 == 0, settings=settings).collect(), list(range(1500)), vectors)
    assert len(rounds) > 2 and recall >= 0.9


def test_parts_find_the_same_and_leave_little(spark, monkeypatch, tmp_path):
    """Shuffles of a few nodes at a time change nothing, and tables of former rounds and hops are removed."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(700, 6)).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    paths = iter(range(10_000))
    monkeypatch.setattr(tables, "scratch_path", lambda spark, name: f"{tmp_path}/{name}-{next(paths)}")
    found, gathers = [], []
    for together in (200_000, 250):
        settings = Settings(block=32, trees=6, first=4, together=together)
        found.append(sorted(search(table, F.col("vec_id") % 20 == 0, settings=settings).collect()))
        gathers.append(next(paths))
    assert found[0] == found[1] and len(found[0]) == 700
    # More tables are written in parts, and of each kind one stays.
    assert gathers[1] - gathers[0] > gathers[0]
    kinds = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert kinds == sorted(2 * ["vectors", "vector_nodes", "vector_codes", "graph", "queries", "search"])
