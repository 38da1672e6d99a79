import re
from itertools import permutations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from boutlab.llm.filter_audit import BLOCK, audit_filters, audit_filters_sql, failed_filters, removal_steps

NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _fails(text, doc_id, texts):
    words = re.findall("[^ \t-\r]+", text)
    copy = doc_id is not None and any(i is not None and i < doc_id and t == text for i, t in texts)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": copy,
    }


def _by_hand(rows, marks):
    """Filter after filter over lists of documents."""
    texts = [(i, t or "") for i, t, _ in rows]
    found = {}
    for part in {p or "" for _, _, p in rows}:
        docs = [
            (_fails(t or "", i, texts), *marks.get(i, (False, False))) for i, t, p in rows if (p or "") == part
        ]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                out = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = sum(d[0][f] for d in docs)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                counts = (len(left), len(out), failing - len(out), alone, sum(d[1] for d in out), sum(d[2] for d in out))
                found[part, order, step] = counts
                shapley[f] += len(out)
        for order, step in {(o, s) for p, o, s in found if p == part}:
            found[part, order, step] += (shapley[order[step - 1]],)
    return found


def _rows(frame):
    return {
        (r.part, r.filter_order, r.step): (*[r[c] for c in NAMES], r.shapley) for r in frame.collect()
    }


def test_whole_table_against_sql(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    answer = con.sql(audit_filters_sql())
    names = sorted(answer.columns)
    found = audit_filters(docs, labels)
    assert names == sorted(found.columns)
    mine = sorted(tuple(r[c] for c in names) for r in found.collect())
    assert mine == sorted(tuple(r[answer.columns.index(c)] for c in names) for r in answer.fetchall())


def test_against_filtering_one_after_another(spark, no_broadcast):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (None, long, "en"), (0, None, "fr"),
        (4, "", ""), (5, "", "fr"), (6, "AA b #", "en"), (7, "x " * 300, "en"), (8, "x " * 300, "de"),
        (9, long + " $", "de"), (10, "A" * 30 + long, "de"), (1, "A & A", "en"), (None, None, None),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, None, None), (5, 1, 1), (None, 1, 1), (8, None, 1), (99, 1, 1)]
    marks = {1: (True, False), 2: (False, True), 5: (True, True), 8: (False, True)}
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, n string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert _rows(audit_filters(docs.repartition(5), marked)) == _by_hand(rows, marks)


def test_steps_are_the_first_failing_place():
    steps = removal_steps(np.arange(32))
    for k, order in enumerate(permutations(range(5))):
        for mask in range(32):
            places = [s for s, f in enumerate(order) if mask >> f & 1]
            assert steps[mask, k] == (min(places) if places else np.inf)


def test_words_across_blocks():
    text = "é" * BLOCK + " b" * 3 + "\x0bc" * BLOCK
    assert failed_filters(text) == 0b0010
    assert failed_filters("a" * (2 * BLOCK)) == 0b0001
    assert failed_filters("") == 0b0001


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.select("doc_id", "text", "lang").collect()]
    found = _rows(audit_filters(odd_docs, labels))
    assert found == _by_hand(rows, {4: (True, False)})
    assert audit_filters(odd_docs.limit(0), labels).count() == 0
    none = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {p for p, _, _ in _rows(audit_filters(none, labels.limit(0)))} == {""}
