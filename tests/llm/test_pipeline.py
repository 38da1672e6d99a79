import zlib
from collections import Counter

import corpus_pipeline
from boutlab.llm import mixing
from boutlab.llm.quality_rules import judge_quality


def test_stages_do_their_work(spark, tmp_path, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    kept = []
    for at, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{at}"
        step(spark, before, folder).write.parquet(path)
        after = spark.read.parquet(path)
        if at < 4:
            assert after.columns == columns, name
        kept.append((before, after))
        before = after
    good = {r.doc_id for r in judge_quality(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept[0][1].collect()} == good and len(good) < docs.count()
    lines = [Counter(x for t in {r.text for r in d.collect()} for x in t.split("\n") if len(x.split()) >= 5) for d in kept[1]]
    assert max(lines[0].values()) > 1 and max(lines[1].values()) == 1
    assert all(r.n_chars == len(r.text) for r in kept[1][1].collect())
    # Of texts alike word for word one stays, and every text that stays was there.
    before_texts = [(r.text or "").lower().split() for r in kept[2][0].collect()]
    after_texts = [(r.text or "").lower().split() for r in kept[2][1].collect()]
    assert len(after_texts) == len({tuple(t) for t in after_texts}) < len(before_texts)
    assert {tuple(t) for t in after_texts} <= {tuple(t) for t in before_texts}
    mixed = mixing.mix(kept[3][0]).count()
    assert kept[3][1].count() == mixed
    pieces = kept[4][1].collect()
    assert sum(r.start == 0 for r in pieces) == mixed
    assert len({r.sequence_id for r in pieces}) > 0


def test_run_equals_the_stages(spark, folder):
    def digest(frame):
        rows = frame.select("doc_id", "start", "length", "doc_tokens").collect()
        ids = Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
        return zlib.crc32(repr(sorted(ids.items())).encode())

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
    assert digest(docs) == digest(corpus_pipeline.run(spark, folder))


def test_names_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"
    ]


def test_odd_rows_and_clashing_columns(spark, odd_docs, folder, tmp_path):
    """Every stage but the last gives back the columns it got, with their own values."""
    docs = odd_docs
    for at, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, folder).write.parquet(f"{tmp_path}/{at}")
        after = spark.read.parquet(f"{tmp_path}/{at}")
        assert step(spark, docs.limit(0), folder).count() == 0
        if at < 4:
            assert after.columns == docs.columns
            assert all(r.n_dropped == r.copy == r.place == "clash" for r in after.collect())
        docs = odd_docs if at < 3 else after


def test_a_table_without_counts_of_characters(spark, folder):
    rows = [(1, "one line of five words\nand another of six words here"), (2, "one line of five words\nsomething else")]
    found = corpus_pipeline.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert found.columns == ["doc_id", "text"]
    assert {r.doc_id: r.text for r in found.collect()} == {1: rows[0][1], 2: "something else"}
