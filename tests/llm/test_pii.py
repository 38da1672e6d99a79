import hashlib
import random
import re

from boutlab.llm import pii
from boutlab.llm.label_model import fit_label_model

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c_d@e.f x@y a.b@c-d.e.f@g.h",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.02.3.255 12345678901234567890.1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004 1 2 3 4  5",
    "+1 (389) 555-5010 +1 +12 ++49 170 1234567) +1(2",
    "😀é a@b.de 😀 +33 1 23 45 67 89\n10.0.0.1",
    "",
    "token = \"0123456789abcdef0123\" Mr. Smith call 212-555-0187 today",
]


def _luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _spans(text):
    found = [
        (m.start(), i, m.end(), kind)
        for i, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if _valid(kind, m.group())
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans_equal_brute_force(spark, documents, texts):
    known = texts | {100_000 + i: t for i, t in enumerate(TRICKY)}
    more = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    rows = pii.find_pii(docs).select("doc_id", *[f"n_{k}" for k in pii.BASE], pii.written("base_spans").alias("b"), "spans")
    for r in rows.collect():
        expected = _spans(known[r.doc_id])
        assert r.b == expected, known[r.doc_id]
        for kind in PATTERNS:
            assert r[f"n_{kind}"] == expected.count(f"{kind}:")
        base = set(expected.split(",")) - {""}
        every = {f"{s.kind}:{s.start}:{s.stop}" for s in r.spans}
        assert base <= every
        places = sorted((s.start, s.stop) for s in r.spans if f"{s.kind}:{s.start}:{s.stop}" not in base)
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))


def test_labelers_add_spans_and_leave_plain_numbers_alone(spark):
    rows = [(i, f"Please call 212-555-{1000 + i} today. Order 123456 of page 77, version 1.2.") for i in range(60)]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all([s.kind for s in r.spans] == ["phone_national"] for r in found)


def test_odd_rows(odd_docs, spark):
    found = pii.find_pii(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].spans == [] and by_id[2].spans == [] and by_id[8].n_card == 0
    assert (by_id[7].n_ip, by_id[7].n_email, by_id[7].n_phone) == (1, 1, 1)
    assert by_id[4]["shard"] == "clash"
    assert pii.find_pii(odd_docs.limit(0)).count() == 0


def test_written_digest_of_no_spans(spark):
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
    assert _spans(None) == ""


def test_label_model_tells_good_labelers_from_bad(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(4000):
        truth = rng.random() < 0.75
        right = 1 if truth else -1
        votes = [right if rng.random() < share else -right for share in (0.9, 0.85, 0.9)]
        rows.append((*votes, rng.choice([1, -1, 0]), truth))
    votes = spark.createDataFrame(rows, "a int, b int, c int, coin int, truth boolean")
    model = fit_label_model(votes, ["a", "b", "c", "coin"], prior=0.5)
    weights = dict(zip(model.labelers, model.weights(), strict=True))
    assert weights["a"][0] > 1 and weights["b"][1] < -1
    assert abs(weights["coin"][0]) < 0.5
    scored = votes.withColumn("p", model.posterior())
    assert scored.filter("(p >= 0.5) = truth").count() > 3600
    assert fit_label_model(votes.limit(0), ["a", "b", "c", "coin"], prior=0.7).prior == 0.7
