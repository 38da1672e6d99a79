import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from boutlab.llm import ppm
from boutlab.llm.queries import remainder


def test_base_equals_brute_force(documents, texts):
    tokens = {i: [*t.encode().lower().split(), "end"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total = sum(counts.values())
    for r in ppm.score(documents, remainder(7) == 2).collect():
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), total)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert abs(r.base_score - base) < 1e-6
        assert r.score < 0


def _trie(texts, share=0.0):
    keys = np.concatenate([ppm.grams(t) for t in texts])
    tables = []
    for k in range(ppm.ORDER + 1):
        grams, n = np.unique(keys & ppm._mask(k + 1), return_counts=True)
        whole, sums = np.unique((keys & ppm._mask(k + 1)) >> ppm.BITS, return_counts=True)
        kept = n >= (share * len(keys) if k else 1)
        tables.append((grams[kept], n[kept], whole, sums))
    return ppm.Trie.build(tables)


def test_probabilities_of_all_symbols_add_up_to_one():
    training = [b"the cat sat on the mat", b"the dog sat on the log", b"a cat and a dog"] * 5
    for share in (0.0, 0.02):
        trie = _trie(training, share)
        for text in (b"the c", b"the do", b"zzz", b"", b"on the m"):
            context = ppm.grams(text)[-1] >> ppm.BITS
            keys = (np.int64(context) << ppm.BITS) | np.arange(ppm.SYMBOLS)
            assert abs((10 ** trie.log10(keys)).sum() - 1) < 1e-9


def test_learnt_text_is_likelier_than_shuffled_text(spark):
    rng = np.random.default_rng(1)
    words = ["river", "stone", "bridge", "quiet", "morning", "walks", "over", "under"]
    learnt = [(i, " ".join(rng.choice(words, 60))) for i in range(80)]
    strange = "".join(sorted(learnt[0][1]))
    docs = spark.createDataFrame([*learnt, (1000, learnt[3][1]), (1001, strange)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in ppm.score(docs, F.col("doc_id") >= 1000).collect()}
    assert scores[1000] > 0.5 * scores[1001]


def test_odd_rows(odd_docs, spark):
    rows = ppm.score(odd_docs, remainder(7) == 2).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_tokens == by_id[2].n_tokens == by_id[6].n_tokens == 1
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert ppm.score(odd_docs.limit(0), remainder(7) == 2).count() == 0
    nothing_learnt = ppm.score(odd_docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in nothing_learnt)


def test_scores_use_every_gram_of_the_training_texts(documents, texts):
    """Against the whole trie in memory; with few grams looked up, and with all."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    data = {i: t.encode("utf-8", "surrogatepass") for i, t in texts.items()}
    trie = _trie([data[i] for i in texts if not held[i]])
    exact = {i: trie.log10(ppm.grams(t)).sum() for i, t in data.items()}
    for looked_up in (0, 3_000, ppm.LOOKED_UP):
        rows = ppm.score(documents, remainder(7) == 2, looked_up).collect()
        assert all(abs(r.score - exact[r.doc_id]) <= 1e-9 * abs(exact[r.doc_id]) for r in rows)


def test_frequent_text_does_not_push_out_what_is_seen_twice(spark):
    often = [(i, "a" * 2_000_000) for i in range(2)]
    docs = spark.createDataFrame(
        [*often, (10, "zebra quartz"), (11, "zebra quartz"), (1000, "zebra quartz")], "doc_id long, text string"
    )
    scores = {r.doc_id: r.score for r in ppm.score(docs, F.col("doc_id") >= 1000).collect()}
    # Every symbol but the first ones follows a context that only ever had this symbol: 2 of 2 + 1 counts.
    assert scores[1000] > 13 * math.log10(2 / 3) - 8
