import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
CLASHING = (
    "size shard slot kept posterior spans n_words copy place n_dropped fingerprint component_id word gram "
    "row doc n low high text_crc32 score query node base_spans held_out key _key _part _u"
).split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like anything inside."""
    good = "The quick brown fox runs over the old stone bridge near the quiet river bank. " * 3
    texts = [
        (1, None, "a"),
        (2, "", None),
        (3, " ".join(f"word{i % 997} of a very long text." for i in range(20_000)), "a"),
        (4, good + "x", "a"),
        (5, good + "x", "b"),
        (5, good + "x", "b"),
        (6, " \n\t \r\n", "b"),
        (None, "A text without an id, but with words enough to be read.", "c"),
        (7, "😀 ñandú – one line\nIP 10.0.0.1, a@b.co +49 170 1234567\n" + good, "c"),
        (8, "7" * 30_000, "c"),
        (9, "a@" * 8_000 + "b.c", None),
    ]
    rows = [(i, t, "en", s, len(t or ""), *["clash"] * len(CLASHING)) for i, t, s in texts]
    clash = ", ".join(f"{c} string" for c in CLASHING)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {clash}"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def same_rows():
    def compare(frame, sql):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        answer = con.sql(sql)
        names = sorted(frame.columns)
        assert names == sorted(answer.columns)
        places = [answer.columns.index(c) for c in names]
        mine = sorted((tuple(r[c] for c in names) for r in frame.collect()), key=repr)
        return mine == sorted((tuple(r[i] for i in places) for r in answer.fetchall()), key=repr)

    return compare
