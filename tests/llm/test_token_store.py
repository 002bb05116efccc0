"""Range coding and the token store, by exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspar.llm import rans, token_store
from quillspar.llm.common import Scratch

SOURCE = token_store.tokenizer_file()
WHOLE = Tokenizer.from_str(SOURCE)
ENCODER = token_store.Encoder(SOURCE, limit=10_000)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=9000))
def test_coder_round_trip(tokens):
    tokens = np.array(tokens, np.int64)
    shared = rans.Table.of(np.bincount(tokens, minlength=301) + (np.arange(301) == 7))
    assert int(shared.share.sum()) == 1 << rans.SCALE
    assert (rans.decode(len(tokens), *rans.encode(tokens, shared), shared) == tokens).all()


def test_table_with_more_rare_tokens_than_their_share():
    counts = np.ones(60_000, np.int64)
    counts[0] = 10**12
    shared = rans.Table.of(counts)
    assert int(shared.share.sum()) == 1 << rans.SCALE and int(shared.share.min()) == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n.,'éÉßΣςİ<|")), max_size=40), max_size=5))
def test_words_give_the_ids_of_the_whole(texts):
    ids, sizes = ENCODER(pa.array(texts, pa.string()))
    wanted = [[*WHOLE.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


@pytest.mark.parametrize("text", ["<|endoftext|> x", "a.b, c. It's we'll ..., ", "naïve CAFÉ.", "x́ y", "  ", "<|ENDOFTEXT|>", "don't. 'S"])
def test_words_on_chosen_texts(text):
    assert ENCODER(pa.array([text]))[0].tolist() == [*WHOLE.encode(text, add_special_tokens=False).ids, 2]


#: Letters on both sides of what counts as one, signs that belong to letters or join with marks, digits, white space.
EDGES = "aZsStmvdl\u00c0\u00d6\u00d7\u00d8\u00de\u00df\u00e0\u00ed\u00f7\u00ff\u0100\u0130\u03a3\u0301\u0338\u20e3\u00aa\u00b2\u0660\u00a0\u0085\t\r \n'.,<>=*&_|-0197\u4e00\U0001f600"


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(EDGES), max_size=30)), max_size=6), st.integers(0, 2))
def test_words_between_letters_signs_and_digits(texts, skipped):
    ids, sizes = ENCODER(pa.array(texts, pa.string())[skipped:])
    wanted = [[*WHOLE.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[skipped:]]
    assert sizes.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


def test_a_word_is_kept_once_whatever_signs_stand_around():
    encoder = token_store.Encoder(SOURCE)
    encoder(pa.array(["word*** Word, (WORD) word.", 'word!! "word" word-word_word,***', "\u00c9T\u00c9. \u00e9t\u00e9&&& word12"]))
    assert {word for word in encoder.place if any(map(str.isalpha, word))} == {"word", "\u00e9t\u00e9"}


def test_common_words_stay_when_others_leave():
    encoder, asked = token_store.Encoder(SOURCE, limit=20_000), []
    library = encoder.ids
    encoder.ids = lambda words: asked.extend(words) or library(words)
    letters = np.array(list("abcdefghij"))
    for batch in range(100):
        rare = ["x" + "".join(letters[list(map(int, str(n)))]) for n in range(batch * 20, batch * 20 + 20)]
        encoder(pa.array([" ".join(["the common words", *rare])]))
    assert encoder.bytes < 30_000 and len(asked) > 2000
    assert [asked.count(word) for word in ("the", "common", "words")] == [1, 1, 1]


def test_store(spark):
    rows = [(3, "Hello, world."), (1, None), (2, ""), (10, "long word " * 40_000), (3, "Hello, again."), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    path = token_store.write_store(Scratch(spark, "t"), docs, SOURCE)
    # The path is all that another session needs.
    got = sorted(map(tuple, token_store.read_store(spark.newSession(), path).collect()), key=lambda r: r[1])
    twice = sorted(["Hello, again.", "Hello, world."], key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    start, wanted = 0, []
    for i, t in [(None, "no id"), (1, None), (2, ""), (3, twice[0]), (3, twice[1]), (10, "long word " * 40_000)]:
        ids = np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == wanted
    assert token_store.read_store(spark, token_store.write_store(Scratch(spark, "t"), docs.limit(0), SOURCE)).count() == 0


def test_rows_without_id_are_dealt_over_tasks(spark, monkeypatch):
    spark = spark.newSession()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit("same words").alias("text"))
    path = token_store.write_store(Scratch(spark, "t"), docs, SOURCE)
    assert spark.read.parquet(f"{path}/frames").select("part").distinct().count() > 2
    got = token_store.read_store(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == [3 * k for k in range(4000)] and [r.doc_id for r in got[3600:]] == list(range(0, 4000, 10))


def test_damage_is_found():
    tokens = np.arange(5000) % 50
    shared = rans.Table.of(np.bincount(tokens))
    frame = token_store.frame_bytes(np.array([4], "<i8").tobytes(), b"\x01", np.array([5000], "<u4").tobytes(), tokens, shared)
    assert (token_store.read_frame(frame, shared)[2] == tokens).all()
    broken = bytearray(frame)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        token_store.read_frame(bytes(broken), shared)
