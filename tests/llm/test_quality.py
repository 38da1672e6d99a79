import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from boutlab.llm import byte_cnn, quality_rules
from boutlab.llm.queries import remainder


def _signals(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
        len(covered), n < 50 or 100 * len(covered) > 50 * n,
    )


def test_signals_equal_brute_force(documents, texts, odd_docs):
    for docs in (documents, odd_docs):
        for r in quality_rules.judge_quality(docs).collect():
            assert tuple(r[c] for c in quality_rules.SIGNALS) == _signals(r.text)
            assert not (r.base_failed and r.kept)
            assert 0 <= r.posterior <= 1


def test_windows_that_overlap_themselves(spark):
    texts = ["a a a a a", "a b c a b c", "a b c d a b c", "x a b a b a y", "a b", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge_quality(docs).collect():
        assert r.n_repeat_words == _signals(r.text)[4]


def test_posterior_rejects_junk_and_keeps_prose(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality_rules.judge_quality(docs, passed_on=["doc_id"]).filter("NOT base_failed")
    found = {(r.quality, r.kept): r["count"] for r in judged.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    good, bad = (found.get((1, k), 0) for k in (True, False)), (found.get((0, k), 0) for k in (False, True))
    (kept, lost), (caught, missed) = good, bad
    assert kept > 0.98 * (kept + lost) and caught > 0.8 * (caught + missed)


def test_keep_good_returns_the_columns_it_got(odd_docs):
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert all(r.text for r in kept.collect())
    assert quality_rules.keep_good(odd_docs.limit(0)).count() == 0


def test_network_ranks_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    net = byte_cnn.fit_quality(docs, labels, remainder(3) != 1)
    rows = byte_cnn.score_quality(docs, net).join(labels, "doc_id").filter(remainder(3) == 1).collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    area = (good[:, None] > bad[None, :]).mean()
    assert area > 0.9
    assert (good >= 0.5).mean() > 0.95


def test_training_never_sees_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    known = {r.text: r.doc_id for r in docs.collect()}
    rows = byte_cnn.training_rows(docs, labels, remainder(3) != 1, 5)
    assert 0 < len(rows) <= 10
    single = docs.groupBy("text").count().filter("count = 1").select("text").collect()
    for r in rows:
        if (r.text,) in single:
            assert zlib.crc32(str(known[r.text]).encode()) % 3 != 1


def test_gradients_equal_differences():
    shape = byte_cnn.Shape(filters=3, width=3, stride=1, block=4, chunk=2)
    net = byte_cnn.train([b"aab", b"xyzzy"], [1, 0], shape, epochs=0)
    net.table, net.bias, net.out = (x.astype(float) for x in (net.table, net.bias, net.out))
    data = np.frombuffer(b"hello wonderful world", np.uint8)
    slopes = {n: np.zeros_like(getattr(net, n)) for n in ("table", "bias", "out")}
    byte_cnn._backward(net, data, 1.0, 1.0, slopes)

    def loss():
        return np.log1p(np.exp(-net.logit(net.pooled(data))))

    for name, place in (("table", (0, 111, 1)), ("table", (2, 108, 0)), ("bias", (2,)), ("out", (4,)), ("out", (6,))):
        value = getattr(net, name)
        value[place] += 1e-5
        up = loss()
        value[place] -= 2e-5
        down = loss()
        value[place] += 1e-5
        assert abs((up - down) / 2e-5 - slopes[name][place]) < 1e-5


def test_network_looks_at_whole_texts(odd_docs, spark):
    empty = odd_docs.select("doc_id", F.lit(1).alias("quality")).limit(0)
    net = byte_cnn.fit_quality(odd_docs, empty, F.lit(True), per_class=2)
    rows = byte_cnn.score_quality(odd_docs, net).collect()
    assert len(rows) == odd_docs.count() and {r.score for r in rows} == {0.5}
    assert byte_cnn.score_quality(odd_docs.limit(0), net).count() == 0
    rng = np.random.default_rng(3)
    net.out = rng.normal(size=net.out.shape)
    assert net.score(b"a" * 50_000) != net.score(b"a" * 50_000 + b"!!##" * 50)


def _plain_score(net, text):
    """The score as nested loops over chunks, places and filters."""
    s = net.shape
    blocks = -(-max(1, -(-len(text) // s.stride)) // s.block)
    data = text + bytes(blocks * s.block * s.stride + s.width - len(text))

    def best(f, first):
        places = range(first * s.block, min(first + s.chunk, blocks) * s.block)
        return max(0.0, *(net.bias[f] + sum(net.table[w][data[p * s.stride + w]][f] for w in range(s.width)) for p in places))

    firsts = range(0, max(1, blocks - 1), s.chunk - 1)
    chunks = [[best(f, first) for first in firsts] for f in range(s.filters)]
    features = [*(sum(c) / len(c) for c in chunks), *map(max, chunks), 1.0]
    return 1 / (1 + np.exp(-sum(x * w for x, w in zip(features, net.out, strict=True)) - net.offset))


def test_scores_equal_plain_loops(spark):
    shape = byte_cnn.Shape(filters=3, width=3, stride=2, block=4, chunk=3)
    net = byte_cnn.train([b"clean words here", b"##$$ !!"], [1, 0], shape, epochs=2)
    net.offset = 0.3
    rows = [(i, ("été and more words " * 9)[:n]) for i, n in enumerate((0, 1, 2, 7, 8, 9, 16, 17, 23, 24, 25, 33, 64, 150))]
    rows.append((99, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in byte_cnn.score_quality(docs, net).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        assert abs(found[i] - _plain_score(net, (text or "").encode())) < 1e-5
