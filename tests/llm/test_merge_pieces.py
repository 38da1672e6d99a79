import functools
import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from boutlab.llm.merge_pieces import SPACE, MergePieces, default_path, encode_texts
from boutlab.llm.queries import op13_merge_pieces

ODD = "ab '▁ é\n\t .!9<s></s><0x41>ßÅ\xa0漢😀\x00́ﬁ"


@functools.cache
def _model():
    return MergePieces(default_path())


@pytest.fixture()
def pieces():
    return _model()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ODD, max_size=40))
def test_same_ids_and_text_as_the_library(text):
    own = _model()
    ids = own.encode(text)
    assert own.library_agrees(text, ids, own.decode(ids))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é.", max_size=30))
def test_both_agendas_merge_alike(text):
    own = _model()
    assert own._merge(text) == own._merge_many(list(text.replace(" ", SPACE)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31_999)), max_size=30))
def test_any_ids_decode_alike(ids):
    own = _model()
    assert own.decode(np.array(ids, "<u4").tobytes()) == own.library.decode(ids)


@pytest.mark.parametrize("text", ["7" * 50_000, "ab" * 20_000, " " * 5_000, "漢" * 5_000 + "é" * 5_000, "a " * 50_000])
def test_long_words(pieces, text):
    ids = pieces.encode(text)
    assert pieces.library_agrees(text, ids, pieces.decode(ids))
    assert pieces.decode(ids) == text


def test_whole_table(spark, folder, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=default_path())
    found = {r.doc_id: r for r in op13_merge_pieces(spark, folder).collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        r = found[doc_id]
        assert r.agrees and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd_docs):
    found = encode_texts(odd_docs).collect()
    assert len(found) == odd_docs.count() and all(r.agrees for r in found)
    for r in found:
        if r.doc_id in (1, 2):
            assert (r.n_tokens, r.decoded) == (2, "") and np.frombuffer(r.ids, "<u4").tolist() == [1, 2]
    assert sum(r.doc_id is None for r in found) == 1 and sum(r.doc_id == 5 for r in found) == 2
    assert encode_texts(odd_docs.limit(0)).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as layout

    model = layout.ModelProto.FromString(open(default_path(), "rb").read())
    model.trainer_spec.model_type = layout.TrainerSpec.WORD
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        MergePieces(str(path))


def test_without_bytes_unknown_characters_count_as_one(tmp_path):
    """The same vocabulary without byte pieces: runs of unknown characters are one id."""
    from sentencepiece import sentencepiece_model_pb2 as layout

    model = layout.ModelProto.FromString(open(default_path(), "rb").read())
    model.trainer_spec.byte_fallback = False
    for p in model.pieces:
        if p.type == layout.ModelProto.SentencePiece.BYTE:
            p.type = layout.ModelProto.SentencePiece.NORMAL
    path = tmp_path / "plain.model"
    path.write_bytes(model.SerializeToString())
    own = MergePieces(str(path))
    for text in ("a \x01\x02 b\x03", "\x01 \x02", "no unknown one"):
        ids = own.encode(text)
        assert own.library_agrees(text, ids, own.decode(ids))
