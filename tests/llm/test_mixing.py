import math

from boutlab.llm import line_templates, mixing


def test_mixing_equals_sql(documents, same_rows):
    assert same_rows(mixing.mix(documents), mixing.mix_sql())


def test_copies_follow_the_weights(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'small', if(id % 3 = 1, 'none', 'big')) AS source", "'x' AS text")
    mixed = mixing.mix(docs, {"small": 3.0, "big": 1.0}, total=20_000)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"small", "big"}
    assert abs(counts["small"] - 15_000) < 5 * math.sqrt(15_000) and abs(counts["big"] - 5_000) < 5 * math.sqrt(5_000)
    per = {r.doc_id: r["count"] for r in mixed.filter("source = 'big'").groupBy("doc_id").count().collect()}
    assert abs(sum(v == 1 for v in per.values()) / 10_000 - 0.5 * math.exp(-0.5)) < 0.02
    again = mixing.mix(docs.repartition(7), {"small": 3.0, "big": 1.0}, total=20_000)
    assert again.exceptAll(mixed).isEmpty() and mixed.exceptAll(again).isEmpty()


def test_high_rates_do_not_vanish(spark):
    docs = spark.createDataFrame([(1, "s", "x"), (2, "s", "y")], "doc_id long, source string, text string")
    assert abs(mixing.mix(docs, total=4_000).count() - 4_000) < 400


def test_order_is_random_within_partitions(spark):
    docs = spark.range(4_000).selectExpr("id AS doc_id", "'s' AS source", "'x' AS text")
    ids = [r.doc_id for r in mixing.mix(docs).collect()]
    rises = sum(a < b for a, b in zip(ids, ids[1:], strict=False))
    assert 0.45 < rises / len(ids) < 0.55


def test_mixing_odd_rows(odd_docs):
    mixed = mixing.mix(odd_docs)
    assert set(mixed.columns) == set(odd_docs.columns)
    rows = mixed.collect()
    assert all(0 <= r.place < 1 and r["copy"] >= 1 for r in rows)
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_line_dedup_equals_sql(documents, same_rows):
    found = line_templates.drop_recurring_lines(documents.select("doc_id", "text"))
    assert same_rows(found, line_templates.drop_recurring_lines_sql())


def test_variable_fields_are_generalised(spark):
    rows = [
        (1, "Order 17 was shipped to Berlin on 2020-01-02 .\nA first own line of this text here."),
        (2, "Order 99 was shipped to Madrid on 2021-11-12 .\nSomething else stands in this one."),
        (3, "Short line.\nOrder 5 was shipped to Oslo on 1999-09-09 .\nNothing here is like the others at all."),
        (4, "Short line.\nOrder of the day by the new boss today ."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.drop_recurring_lines(docs).collect()}
    assert found[1] == (rows[0][1], 0)
    assert found[2] == ("Something else stands in this one.", 1)
    assert found[3] == ("Short line.\nNothing here is like the others at all.", 1)
    assert found[4] == (rows[3][1], 0)


def test_line_dedup_odd_rows(spark, odd_docs):
    found = line_templates.drop_recurring_lines(odd_docs)
    assert set(found.columns) == set(odd_docs.columns)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by_id.values())) == odd_docs.count()
    assert by_id[1][0].text is None and by_id[2][0].text == ""
    assert by_id[4][0].n_dropped == 0 and [r.text for r in by_id[5]] == ["", ""]
    assert line_templates.drop_recurring_lines(odd_docs.limit(0)).count() == 0
    # Rows of one doc_id with different texts keep their own lines.
    line = "this very line is in two of the texts"
    rows = [(1, f"{line}\nfirst"), (2, f"second\n{line}"), (2, f"third\nfourth\n{line}"), (2, "fifth\nsixth")]
    texts = [r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(texts) == sorted([f"{line}\nfirst", "second", "third\nfourth", "fifth\nsixth"])
