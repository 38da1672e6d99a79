import hashlib

import numpy as np
import pytest

from boutlab.llm import vector_codes
from boutlab.llm.vector_codes import Settings, coded_with_label_errors, encode, written

SCHEMA = "vec_id long, label string, embedding array<float>, code string, error string, _x string"


def _by_hand(vectors, entries=256, rounds=4):
    """Codes, errors and codebooks with all distances in whole numbers."""
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64).reshape(len(vectors), 4, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest(k):
        squared = ((x[:, k, None, :] - books[k][None]) ** 2).sum(2)
        return squared.argmin(1), squared.min(1)

    for _ in range(rounds):
        chosen = [nearest(k)[0] for k in range(4)]
        for k in range(4):
            for e in set(chosen[k].tolist()):
                mine = x[chosen[k] == e, k]
                books[k, e] = mine.sum(0) // len(mine)
    last = [nearest(k) for k in range(4)]
    codes = ["".join(f"{last[k][0][i]:02x}" for k in range(4)) for i in range(len(x))]
    return codes, sum(last[k][1] for k in range(4)).tolist(), books


@pytest.mark.parametrize("settings", [Settings(), Settings(b=2, most_b=3), Settings(b=1, least_b=1, most_b=1)])
def test_whole_table_against_all_distances(spark, settings):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    found = encode(table, settings=settings)
    codes, errors, books = _by_hand([r.embedding for r in rows])
    mine = {r.vec_id: (r.code, r.error) for r in found.rows.collect()}
    assert mine == {r.vec_id: x for r, *x in zip(rows, codes, errors, strict=True) for x in [tuple(x)]}
    assert np.array_equal(found.codebooks, books)


def test_bounds_spare_comparisons_and_b_adapts(spark):
    """Tight clusters: entries come to rest, and parts are settled by few entries."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(16, 16)) * 4
    vectors = (centers[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 16)) * 0.01).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = encode(table, settings=Settings(entries=16, b=8, least_b=1))
    codes, errors, books = _by_hand(vectors.tolist(), 16)
    assert [(r.code, r.error) for r in found.rows.orderBy("vec_id").collect()] == list(zip(codes, errors, strict=True))
    assert np.array_equal(found.codebooks, books)
    used = [b for b, _ in found.history]
    settled = [needed[:-1].sum() / needed.sum() for _, needed in found.history]
    assert len(set(used)) > 1 and settled[-1] > 0.9


def test_label_errors_and_checksum(spark, no_broadcast):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    labels = [None if i % 3 == 0 else "" if i % 3 == 1 else f"l{i % 4}" for i in range(300)]
    table = spark.createDataFrame(
        [(i, labels[i], v.tolist()) for i, v in enumerate(vectors)], "vec_id long, label string, embedding array<float>"
    )
    codes, errors, books = _by_hand(vectors.tolist())
    per_label = {}
    for label, error in zip(labels, errors, strict=True):
        per_label[label] = per_label.get(label, 0) + error
    digest = hashlib.sha256(written(books).encode()).hexdigest()
    found = {r.vec_id: r for r in coded_with_label_errors(table).collect()}
    assert len(found) == 300
    for i, r in found.items():
        assert (r.code, r.error, r.label_error, r.codebooks_sha256) == (codes[i], errors[i], per_label[labels[i]], digest)


def test_odd_rows(spark):
    rows = [
        (None, "a", [1.0, 2.0, 3.0, 4.0, 5.0]), (1, None, []), (1, "a", [0.5] * 8), (1, "a", [0.5] * 8),
        (2, "", [None, 1.0]), (3, "a", [float("nan")]), (4, "b", None), (5, "b", [float("-inf")]),
    ]
    table = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    found = coded_with_label_errors(table.repartition(3)).collect()
    # Entries by vec_id, then by numbers: the empty vector counts as zeros.
    assert sorted((r.vec_id or 9, r.label or "", r.code, r.error, r.label_error, r["_x"]) for r in found) == [
        (1, "", "00000000", 0, 0, "clash"), (1, "a", "01010101", 0, 0, "clash"), (1, "a", "01010101", 0, 0, "clash"),
        (9, "a", "03030300", 0, 0, "clash"),
    ]
    assert encode(table.limit(0)).rows.collect() == []
    assert [r.code for r in encode(table.filter("size(embedding) = 0")).rows.collect()] == ["00000000"]
    with pytest.raises(ValueError):
        encode(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        Settings(b=1)


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(5)
    x = rng.integers(-900, 900, (400, 4)).astype(float)
    book = rng.integers(-900, 900, (40, 4)).astype(float)
    part = vector_codes.Part.fresh(x, book, 4)
    for _ in range(6):
        new = book + rng.integers(-40, 40, book.shape)
        moves = np.sqrt(((new - book) ** 2).sum(1))
        part, book = part.moved(moves).assigned(x, new, int(rng.integers(2, 9))), new
        true = np.sqrt(vector_codes.distances(x, book))
        rows = np.arange(len(x))
        assert np.array_equal(part.near[:, 0], np.argmin(true, axis=1))
        kept = np.where(np.isinf(part.low), 0, part.low)
        assert (kept <= true[rows[:, None], part.near]).all()
        others = true.copy()
        others[rows[:, None], np.where(np.isinf(part.low), part.near[:, :1], part.near)] = np.inf
        assert (part.outer <= others.min(1)).all()
