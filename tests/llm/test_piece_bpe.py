"""Pieces of the prefix table against the library itself."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspar.llm import piece_bpe

MODEL = piece_bpe.model_file()
WHOLE = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
PIECES = piece_bpe.Pieces(MODEL)


def ids_of(text, pieces=PIECES):
    ids, bounds = pieces.encode([text])
    assert bounds.tolist() == [0, len(ids)]
    return ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n▁.,'teahinoé\u0000①日")), max_size=60))
def test_ids_equal_the_library(text):
    ids = ids_of(text)
    assert ids.tolist() == WHOLE.encode(text)
    assert PIECES.decode(ids) == WHOLE.decode(WHOLE.encode(text))


@pytest.mark.parametrize("text", ["", " ", " " * 37 + "x" + " " * 16, "▁", "<0x41></s><unk>", "\r\n\n\t", "a" * 3000, "日本語①" * 500, "a  b   c    d", "́e‍😀"])
def test_ids_of_chosen_texts(text):
    assert ids_of(text).tolist() == WHOLE.encode(text)


def test_each_prefix_has_one_last_token():
    """Of the tokens that end at a place, exactly one fits behind the shorter prefix."""
    word = "▁unbelievably"
    for end in range(1, len(word) + 1):
        last = PIECES.word(word[:end])
        fitting = []
        for start in range(end):
            token = PIECES.id.get(word[start:end])
            if token in PIECES.steps and (start == 0 or PIECES.fits(PIECES.word(word[:start])[-1], token)):
                fitting.append(token)
        assert fitting == [last[-1]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n▁.,'-aé\ue000\ue001")), max_size=30), max_size=6))
def test_texts_of_a_batch(texts):
    ids, bounds = PIECES.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [WHOLE.encode(t) for t in texts]


def test_words_are_dropped_at_the_limit(monkeypatch):
    monkeypatch.setattr(piece_bpe, "PAIRS", 50)
    pieces = piece_bpe.Pieces(MODEL, 5_000)
    for text in [" ".join(f"word{k}x{k * 7}" for k in range(n, n + 40)) for n in range(0, 400, 40)]:
        assert ids_of(text, pieces).tolist() == WHOLE.encode(text)
    assert len(pieces.pairs) <= 50 and len(pieces.place) <= 81


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("▁theationé①")), min_size=1, max_size=40))
def test_long_words_equal_short_ones(word):
    assert PIECES.long_word(word) == PIECES.word(word)


def test_other_models_are_refused():
    with pytest.raises(Exception):
        piece_bpe.Pieces(b"not a model")


def test_documents(spark):
    rows = [(3, "Hello, world."), (1, None), (2, ""), (10, "long wörd ①  " * 20_000), (3, "Hello, world."), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    encoded = piece_bpe.encode(docs, MODEL)
    got = {(r.doc_id, tuple(r.ids)) for r in encoded.collect()}
    assert got == {(i, tuple(WHOLE.encode(t or ""))) for i, t in rows} and encoded.count() == len(rows)
    back = {(r.doc_id, r.text) for r in piece_bpe.decode(encoded, MODEL).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert piece_bpe.encode(docs.limit(0), MODEL).count() == 0


def test_query_equals_the_library(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = piece_bpe.op13_piece_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = WHOLE.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(WHOLE.decode(ids).encode()).hexdigest()
