import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from boutlab.llm.packing import Limits, pack
from boutlab.llm.tokens import default_paths, encoder


def _check(rows, wanted, limits):
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = 0
        for r in pieces:
            assert r.offset == total
            total += r.length
        assert total <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r.loss_tokens for r in pieces) <= limits.loss_tokens
        assert total & (total - 1) == 0, "padding"
    for doc_id, ids in wanted.items():
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == np.array(ids, "<u4").tobytes()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    assert not by_doc


@pytest.mark.parametrize("limits", [Limits(), Limits(tokens=64, segments=3, loss_tokens=50, pool=20)])
def test_every_id_lies_in_one_piece(documents, texts, limits):
    model = Tokenizer.from_file(default_paths()[0])
    wanted = {i: [*model.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    _check(pack(documents.repartition(3), limits=limits).collect(), wanted, limits)


def test_prompts_bear_no_loss(spark):
    rows = [(i, "answer " * (i % 7 + 1), "a question about this " * (i % 5)) for i in range(200)]
    limits = Limits(tokens=64, segments=8, loss_tokens=20, pool=64)
    packed = pack(spark.createDataFrame(rows, "doc_id long, text string, prompt string").repartition(2), limits=limits)
    found = packed.collect()
    model = Tokenizer.from_file(default_paths()[0])
    ids = lambda t: model.encode(t, add_special_tokens=False).ids
    _check(found, {i: [*ids(p), *ids(t), 0] for i, t, p in rows}, limits)
    for i, text, prompt in rows:
        lead = len(ids(prompt))
        expected = len(ids(text)) + 1 - (lead == 0)
        assert sum(r.loss_tokens for r in found if r.doc_id == i) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 'sé\n\t .!9<|endoftext|>ßÅ\xa0漢😀", max_size=24))
def test_both_libraries_give_the_same_ids(text):
    path, ranks = default_paths()
    fast, slow = encoder(path, ranks), encoder(path, None)
    assert fast.encode([text])[0].tolist() == slow.encode([text])[0].tolist()


def test_odd_rows(odd_docs):
    found = pack(odd_docs).collect()
    assert sum(r.doc_tokens for r in found if r.doc_id == 1) == 1
    assert sum(r.start == 0 for r in found) == odd_docs.count()
    assert pack(odd_docs.limit(0)).count() == 0
    # Partitions without rows, as a shuffle leaves them.
    assert pack(odd_docs.filter("doc_id IN (1, 2)").repartition(9)).count() == 2
    with pytest.raises(ValueError):
        Limits(tokens=1000)
