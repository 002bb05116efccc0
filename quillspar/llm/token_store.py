"""Token numbers of a corpus, stored as range-coded frames and read back.

Documents are dealt by ranges of doc_id and tokenized once, in order. Tokens
are counted over the whole corpus into one frequency table, bounded by the
vocabulary, which every frame shares. A store is a folder with two Parquet
tables: ``frequencies`` (token, n and the digest of the tokenizer's file), and
``frames``; it is read from its path alone, in any session. A frame is a binary
value that holds whole documents, about FRAME tokens of them:

    magic, checksum of the table, numbers of documents, tokens, blocks, words
    doc_ids, their presence, token counts of the documents
    of every block: its states (the checkpoint), its words, its checksum
    the words of all blocks

Frames are rows of a Parquet table together with the corpus position of their
first token, so they are written, retried and read by Spark alone; a reader may
decode any frame, and within it any block, without the others.

Defined results: a null or empty text is the end id alone; documents with a
null doc_id come first; rows that share a doc_id follow each other in the order
of a hash of their texts, so that many of them are dealt over many tasks; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.llm import rans
from quillspar.llm.common import Scratch, small_batches, table

FRAME, VOCABULARY, END_ID = 1 << 18, 1 << 16, 2
MAGIC, HEAD = b"QSR1", struct.Struct("<4sIIQII")
#: Words of lower-case letters that no normal form changes; the tokenizer's pattern takes each as one run.
_PLAIN_WORD = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"


#: What a byte of a lower-cased text is: white space where texts are always cut, a letter, a sign, a digit, or anything else.
_SPACE, _LETTER, _SIGN, _DIGIT, _OTHER = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
for _kind, _signs in ((_SPACE, b" \n"), (_LETTER, bytes(range(97, 123))), (_SIGN, b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"), (_DIGIT, b"0123456789")):
    _KINDS[list(_signs)] = _kind
#: By eight times the kind before and the kind: whether a word begins. Apostrophes are no signs here, as letters may follow them in a word.
_BEGINS = np.zeros(64, bool)
for _before, _kind in ((_LETTER, _SIGN), (_SIGN, _LETTER), (_LETTER, _DIGIT), (_DIGIT, _LETTER), (_SIGN, _DIGIT), (_DIGIT, _SIGN), (_DIGIT, _DIGIT)):
    _BEGINS[8 * _before + _kind] = True
_BEGINS[8 * _SPACE + _LETTER : 8 * _SPACE + _OTHER + 1] = True


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level tokenizers write for each byte: itself where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return dict(zip(hidden, range(256, 256 + len(hidden)), strict=True))


_BYTE_SIGNS = _byte_signs()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the number of words up to the end of each text.

    Texts are cut where the tokenizer's pattern cuts them whatever stands around: at spaces and line feeds, between
    letters, signs and digits. Only letters up to U+00FF and signs and digits of ASCII count as such, so
    what a normal form could join stays in one word. Letters are lower-cased.
    """
    if not pc.sum(pc.binary_length(texts)).as_py():
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    lower = pc.ascii_lower(texts.cast(pa.string()))
    offsets = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset : lower.offset + len(lower) + 1]
    signs = np.frombuffer(lower.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets = offsets - offsets[0]
    kinds = _KINDS[signs]
    # U+00C0 to U+00FF without the signs of multiplication and division; all but the last are lower-cased by 32.
    at = np.flatnonzero(signs == 0xC3)
    at = at[(signs[at + 1] & 0xDF) != 0x97]
    kinds[at] = kinds[at + 1] = _LETTER
    large = at[signs[at + 1] < 0x9F] + 1
    signs[large] += 32
    pairs = kinds.copy()
    pairs[1:] += kinds[:-1] << 3
    begins = _BEGINS[pairs]
    edges = offsets[:-1][offsets[:-1] < len(signs)]
    begins[edges] = kinds[edges] != _SPACE
    kept = kinds != _SPACE
    held = signs[kept]
    bounds = np.append(np.flatnonzero(begins[kept]), len(held)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(held))
    return words, np.searchsorted(np.flatnonzero(begins), offsets[1:])


class Encoder:
    """Ids of whole texts, by words: the tokenizer never joins across the places where ``split`` cuts.

    Its pattern takes runs of letters, single digits and runs of other signs,
    lower-cased; the ids of a word do not depend on its neighbours. Words are
    kept with their ids until they take ``limit`` bytes; then those that most
    batches held stay, in half of it. A text that could hold a special token goes to the tokenizer whole.
    """

    #: Bytes that a kept word takes beside its letters and ids: its string, its number, its place in the dictionary.
    WORD = 200

    def __init__(self, source: str, limit: int = 64 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_str(source), limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used, self.bytes = np.zeros(1 << 16, np.uint16), 0, 0
        self.first, self.size, self.batches = (np.zeros(1 << 14, np.int32) for _ in range(3))

    def add(self, words: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        """Keeps words with the numbers of their ids and the ids, one behind the other."""
        count, total = len(self.place), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while count + len(words) > len(self.first):
            self.first, self.size, self.batches = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.batches))
        self.flat[self.used : self.used + total] = flat
        self.size[count : count + len(words)] = sizes
        self.first[count : count + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.bytes += self.WORD * len(words) + sum(map(len, words)) + 2 * total
        self.place.update(zip(words, range(count, count + len(words)), strict=True))

    def shrink(self) -> None:
        """Keeps the words that more than one batch held, in half of the limit, those of the most batches first."""
        words, batches = list(self.place), self.batches[: len(self.place)]
        often = np.argsort(-batches, kind="stable")[: int((batches > 1).sum())]
        lengths = np.fromiter((len(words[at]) for at in often.tolist()), np.int64, len(often))
        often = often[np.cumsum(self.WORD + lengths + 2 * self.size[often]) <= self.limit // 2]
        first, sizes, flat = self.first[often], self.size[often], self.flat
        self.clear()
        self.add([words[at] for at in often.tolist()], sizes, flat[_ranges(first, sizes)])

    def ids(self, words: list[str]) -> list[list[int]]:
        """The tokenizer's ids. Plain words go to its model, as its byte-level step would hand them over."""
        tokenize, out = self.tokenizer.model.tokenize, [[]] * len(words)
        plain = np.asarray(pc.match_substring_regex(pa.array(words, pa.string()), _PLAIN_WORD))
        rest = np.flatnonzero(~plain).tolist()
        plain = np.flatnonzero(plain).tolist()
        shown = "\n".join([words[at] for at in plain]).encode().decode("latin-1")
        for byte, sign in _BYTE_SIGNS.items():
            if byte >= 0x80:
                shown = shown.replace(chr(byte), chr(sign))
        for at, word in zip(plain, shown.split("\n")):
            out[at] = [token.id for token in tokenize(word)]
        found = self.tokenizer.encode_batch_fast([words[at] for at in rest], add_special_tokens=False)
        for at, each in zip(rest, found, strict=True):
            out[at] = each.ids
        return out

    def places(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words, new ones added."""
        if self.bytes > self.limit:
            self.shrink()
        found = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(len(self.place), len(self.place) + len(new))
            added = [words[at] for at in new.tolist()]
            ids = self.ids(added)
            self.add(added, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint16))
        self.batches[found] += 1
        return found

    def ids_at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of kept words, one behind the other, and where those of each word end, behind a 0."""
        sizes = self.size[place]
        return self.flat[_ranges(self.first[place], sizes)], np.append(0, np.cumsum(sizes))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the number of each text's ids."""
        texts = pc.fill_null(texts, "")
        special = np.flatnonzero(np.asarray(pc.match_substring(texts, "<|"))).tolist()
        if special:
            whole = {at: texts[at].as_py() for at in special}
            texts = pa.array(["" if at in whole else text for at, text in enumerate(texts.to_pylist())], pa.string())
        words, ends = split(texts)
        said = words.dictionary_encode()
        ids, bounds = self.ids_at(self.places(said.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(said.indices)])
        stops = bounds[ends]
        if not special:
            return np.insert(ids, stops, END_ID), np.diff(stops, prepend=0) + 1
        pieces = np.split(ids, stops[:-1])
        found = self.tokenizer.encode_batch_fast(list(whole.values()), add_special_tokens=False)
        for row, each in zip(whole, found, strict=True):
            pieces[row] = np.array(each.ids, np.uint16)
        pieces = [np.append(piece, np.uint16(END_ID)) for piece in pieces]
        return np.concatenate(pieces), np.array([len(piece) for piece in pieces])


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``sizes`` many, one run behind the other."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(first - ends + sizes, sizes)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(source) -> Encoder:
    """One encoder for the tasks of a worker process, until ``_count`` runs there."""
    if source.value[0] not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[source.value[0]] = Encoder(source.value[1])
    return _ENCODERS[source.value[0]]


TOKENS = "part int, frame int, before long, n_tokens long, doc_ids binary, present binary, sizes binary, tokens binary"


def _tokenize(source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(source), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=1)
        frame, before = 0, 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        docs: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal frame, before
            tokens = np.concatenate(ids)
            halves = tokens.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
            row = {
                "part": part, "frame": frame, "before": before, "n_tokens": len(tokens),
                "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "present": np.array([d is not None for d in docs], np.uint8).tobytes(),
                "sizes": np.concatenate(sizes).astype("<u4").tobytes(), "tokens": pack.compress(halves),
            }
            frame, before = frame + 1, before + len(tokens)
            ids.clear(), sizes.clear(), docs.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in small_batches(batches, "text", 2 << 20):
            found, size = encoder(batch.column("text"))
            ids.append(found)
            sizes.append(size)
            docs += batch.column("doc_id").to_pylist()
            if sum(map(len, ids)) >= FRAME:
                yield close()
        if docs:
            yield close()

    return run


def _tokens(packed: bytes, n: int) -> np.ndarray:
    halves = zstandard.ZstdDecompressor().decompress(packed, max_output_size=2 * n)
    return np.frombuffer(halves, np.uint8).reshape(2, n).T.copy().view("<u2").ravel()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _ENCODERS.clear()  # all tokens are made; the workers' words are not needed again
    counts = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for packed, n in zip(batch.column("tokens").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
            counts += np.bincount(_tokens(packed, n), minlength=VOCABULARY)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["token", "n"])


def frame_bytes(doc_ids: bytes, present: bytes, sizes: bytes, tokens: np.ndarray, shared: rans.Table) -> bytes:
    """A frame in the file format."""
    states, counts, words = rans.encode(tokens, shared)
    checks = [zlib.crc32(tokens[k : k + rans.BLOCK].astype("<u4").tobytes()) for k in range(0, len(tokens), rans.BLOCK)]
    head = HEAD.pack(MAGIC, shared.check(), len(present), len(tokens), len(states), len(words))
    parts = [head, doc_ids, present, sizes, states.astype("<u8").tobytes(), counts.astype("<u4").tobytes(), np.array(checks, "<u4").tobytes(), words.astype("<u4").tobytes()]
    return b"".join(parts)


def read_frame(frame: bytes, shared: rans.Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, token counts and all tokens of a frame, every block held against its checksum."""
    magic, check, n_docs, n_tokens, n_blocks, n_words = HEAD.unpack_from(frame)
    if magic != MAGIC or check != shared.check():
        raise ValueError("not a frame of this store, or of another frequency table")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(frame, kind, n, at)
        at += found.nbytes
        return found

    docs, present, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs).astype(np.int64)
    states, counts, checks = take("<u8", n_blocks * rans.LANES).reshape(n_blocks, rans.LANES), take("<u4", n_blocks).astype(np.int64), take("<u4", n_blocks)
    tokens = rans.decode(n_tokens, states, counts, take("<u4", n_words), shared)
    for block, check in enumerate(checks.tolist()):
        if zlib.crc32(tokens[block * rans.BLOCK : (block + 1) * rans.BLOCK].astype("<u4").tobytes()) != check:
            raise ValueError(f"block {block} of a frame is damaged")
    return [d if p else None for d, p in zip(docs.tolist(), present.tolist(), strict=True)], sizes, tokens


def _encode(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Table.of(np.frombuffer(counts.value, "<i8"))
        for batch in batches:
            for row in batch.to_pylist():
                frame = frame_bytes(row["doc_ids"], row["present"], row["sizes"], _tokens(row["tokens"], row["n_tokens"]), shared)
                kept = [pa.array([row["part"]], pa.int32()), pa.array([row["frame"]], pa.int32()), pa.array([row["start"]], pa.int64()), pa.array([frame], pa.binary())]
                yield pa.RecordBatch.from_arrays(kept, names=["part", "frame", "start", "payload"])

    return run


def frequencies(spark: SparkSession, path: str):
    """The store's frequency table as a broadcast of VOCABULARY counts."""
    counted = spark.read.parquet(f"{path}/frequencies").select("token", "n").toArrow()
    totals = np.zeros(VOCABULARY, "<i8")
    totals[np.asarray(counted.column("token")).astype(np.int64)] = np.asarray(counted.column("n"))
    return spark.sparkContext.broadcast(totals.tobytes())


def write_store(scratch: Scratch, documents: DataFrame, tokenizer: str) -> str:
    """Encodes whole texts into a store and returns its path.

    ``tokenizer`` is the text of a tokenizer file of at most VOCABULARY ids.
    """
    spark = scratch.spark
    source = spark.sparkContext.broadcast((zlib.crc32(tokenizer.encode()), tokenizer))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    # The last key parts equal rows, whose order does not matter.
    rows = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "text")
    tokens = scratch.keep(rows.select("doc_id", "text").mapInArrow(_tokenize(source), TOKENS), "tokens")
    counted = tokens.select("tokens", "n_tokens").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    scratch.keep(counted.withColumn("tokenizer", F.lit(hashlib.sha256(tokenizer.encode()).hexdigest())), "frequencies")
    # One row for every partition of the corpus, so the running sum is small.
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = tokens.join(base, "part").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")
    counts = frequencies(spark, scratch.root)
    scratch.keep(placed.mapInArrow(_encode(counts), "part int, frame int, start long, payload binary"), "frames")
    scratch.drop("tokens")
    return scratch.root


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the store at ``path``."""
    counts = frequencies(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Table.of(np.frombuffer(counts.value, "<i8"))
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                docs, sizes, tokens = read_frame(payload, shared)
                raw, ends = tokens.astype("<u4"), np.cumsum(sizes)
                checks = [zlib.crc32(raw[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(checks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    frames = spark.read.parquet(f"{path}/frames").select("start", "payload")
    return frames.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The text of one of the public tokenizer files."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(spark, write_store(Scratch(spark, "op6"), table(spark, sf_dir, "documents"), tokenizer_file()))
