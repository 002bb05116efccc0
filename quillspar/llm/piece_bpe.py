"""SentencePiece ids of whole texts by a table of prefixes, and texts from ids.

The pieces of a merge-type (BPE) model are encoded without merging anything in
the text itself. For every prefix of a word the last token of its encoding is
unique: it is the token that ends there (an automaton over all pieces, read from
their ends, finds those) and that fits behind the last token of the shorter prefix
before it. Two tokens fit if the encoding of their joined strings is these two,
which is kept per pair. So a word's ids are those of a prefix and one token more.
Words of up to ``LONG`` characters share one table of prefixes, filled for those that
are asked for; a longer one has a table of its own, which is read from the end, each
token leading back to the prefix before it. Characters that no piece holds are
written as their bytes and part the words on both sides of them.

Only tokens that encode to themselves are in the automaton. No piece holds a
word sign behind another character, so texts fall into words at these signs
whose ids do not depend on each other, and words fall into parts between letters
and marks that no piece has side by side; a worker keeps the ids of words and parts
it has seen, up to ``LIMIT`` bytes. A model for which one of this does not hold is
refused.

Defined results: null and empty texts have no ids and decode to the empty text;
rows that repeat are encoded each; a null doc_id stays null; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm.common import small_batches, table
from quillspar.llm.token_store import VOCABULARY, Encoder

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Bytes that kept words may take in a worker, what a part of one takes beside its letters and ids, and pairs that are kept.
LIMIT, PART, PAIRS = 160 << 20, 200, 1 << 20
#: Characters of the words whose prefixes are shared.
LONG = 64
#: Marks at which words are cut where the model allows it.
MARKS = ".,!?;:()\"'-"
#: The score of parts that cannot be joined.
NEVER = float("-inf")


class Pieces(Encoder):
    """A merge-type model with byte fallback, as the sentencepiece library reads it."""

    def __init__(self, model: bytes, limit: int = LIMIT) -> None:
        import sentencepiece

        self.limit = limit
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i))]
        self.id = {lib.id_to_piece(i): i for i in ids}
        self.score = {piece: lib.get_score(i) for piece, i in self.id.items()}
        self.byte_of = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte = frozenset(self.byte_of)
        letters = {sign for piece in self.id for sign in piece}
        if lib.vocab_size() > VOCABULARY or any(map(lib.is_unused, ids)) or not letters <= self.id.keys() or any(SPACE in p.lstrip(SPACE) for p in self.id) or not all(map(lib.is_byte, self.byte_of)):
            raise ValueError("not a merge-type model with byte fallback whose pieces begin words")
        self.automaton: dict = {}  # by the characters of a piece from its end; the token at the empty string
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        for piece, i in self.id.items():
            steps = self.merged(piece)
            if steps[-1][1] == piece:
                self.steps[i] = steps
                state = self.automaton
                for sign in reversed(piece):
                    state = state.setdefault(sign, {})
                state[""] = i
        self.line_ends = "\n" not in letters  # a line feed that is no piece parts words too
        # Between a letter or digit and a mark, where no piece has both side by side.
        beside = {pair for piece in self.id for pair in zip(piece, piece[1:])}
        before = {mark: "".join(sorted(a for a, b in beside if b == mark and a.isalnum())) for mark in MARKS}
        open_ = "".join(re.escape(mark) for mark in MARKS if not any(a == mark and b.isalnum() for a, b in beside))
        closed = "|".join(rf"{f'(?<![{re.escape(letters)}])' if letters else ''}(?={re.escape(mark)})" for mark, letters in before.items())
        cuts = [rf"(?<=[^\W_])(?:{closed})"] + ([rf"(?<=[{open_}])(?=[^\W_])"] if open_ else [])
        self.cuts = re.compile("|".join(cuts)).split
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.parts: dict[str, tuple[int, ...]] = {"": ()}

    def merged(self, text: str) -> list[tuple[float, str, str]]:
        """How the model's definition joins a text: the best-scored neighbours, the leftmost of equals, until none can be.

        Before each joining its score and the first and the last part; at the end no score and the parts that are left.
        """
        parts, steps = list(text), []
        while True:
            scores = [self.score.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = max(scores, default=NEVER)
            steps.append((best, parts[0], parts[-1]))
            if best == NEVER:
                return steps
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' joined strings is these two: no joining crosses them at any time."""
        a, b, score = self.steps[left], self.steps[right], self.score
        i = j = 0
        while True:
            (next_a, _, x), (next_b, y, _) = a[i], b[j]
            across = score.get(x + y, NEVER)
            if across > next_a and across >= next_b:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def ending(self, word: str, end: int) -> list[tuple[int, int]]:
        """The tokens that end at a place and where they begin, the shortest first: what the automaton meets on its way back."""
        state, found, at = self.automaton, [], end
        while at:
            state = state.get(word[at - 1])
            if state is None:
                break
            at -= 1
            token = state.get("")
            if token is not None:
                found.append((token, at))
        return found

    def follows(self, before: int, token: int) -> bool:
        """``fits``, kept per pair."""
        known = self.pairs.get(before << 24 | token)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[before << 24 | token] = self.fits(before, token)
        return known

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one word: those of a prefix and the last token behind it. Words share the table of their prefixes."""
        found = self.parts.get(word)
        if found is not None:
            return found
        if len(word) > LONG:
            return self.long_word(word)
        for token, start in reversed(self.ending(word, len(word))):
            before = self.word(word[:start]) if start else ()
            if not before or before[-1] in self.byte or self.follows(before[-1], token):
                found = (*before, token)
                break
        else:
            found = (*(self.word(word[:-1]) if len(word) > 1 else ()), *map(self.byte_of.__getitem__, word[-1:].encode()))
        self.parts[word] = found
        self.bytes += PART + len(word) + 8 * len(found)
        return found

    def long_word(self, word: str) -> tuple[int, ...]:
        """The same with a table of its own, filled from left to right and read from the end."""
        last = [(-1, 0)]  # the last token of every prefix and where it begins; -1 behind a character that no piece holds
        for end in range(1, len(word) + 1):
            for token, start in reversed(self.ending(word, end)):
                if last[start][0] < 0 or self.follows(last[start][0], token):
                    last.append((token, start))
                    break
            else:
                last.append((-1, end - 1))
        ids, at = [], len(word)
        while at:
            token, start = last[at]
            ids += [token] if token >= 0 else [self.byte_of[b] for b in reversed(word[start].encode())]
            at = start
        return tuple(reversed(ids))

    def ids(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of some words, put together from their parts where no piece can cross from one to the next."""
        word, cuts = self.word, self.cuts
        # Most words have no mark to be cut at.
        return [word(each) if each[1:].isalnum() else tuple(i for part in cuts(each) for i in word(part)) for each in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end."""
        texts = [self.library.normalize(text) for text in texts]
        # A sign that none of the texts holds parts the words: one is set before every run of word signs.
        mark = next(sign for sign in map(chr, range(0xE000, 0xF900)) if not any(sign in text for text in texts))
        marked = [re.sub(f"(?<!{SPACE}){SPACE}", mark + SPACE, text) if SPACE * 2 in text else text.replace(SPACE, mark + SPACE) for text in texts]
        if self.line_ends:
            marked = [text.replace("\n", f"{mark}\n{mark}") for text in marked]
        lists = pc.split_pattern(pa.array(marked, pa.string()), mark)
        said = lists.flatten().dictionary_encode()
        ids, ends = self.ids_at(self.places(said.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(said.indices)])
        return ids.astype(np.int32), ends[np.cumsum(np.append(0, np.asarray(pc.list_value_length(lists))))]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_MODELS: dict[int, Pieces] = {}


def _pieces(model) -> Pieces:
    """One model for the tasks of a worker process."""
    number, source = model.value
    if number not in _MODELS:
        _MODELS.clear()
        _MODELS[number] = Pieces(source)
    return _MODELS[number]


def _shared(spark: SparkSession, model: bytes):
    return spark.sparkContext.broadcast((zlib.crc32(model), model))


def encode(documents: DataFrame, model: bytes, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every document; with ``decoded`` also the text that the ids give."""
    shared = _shared(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared)
        for batch in small_batches(batches, "text", 6 << 20):
            ids, bounds = pieces.encode([text or "" for text in batch.column("text").to_pylist()])
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))}
            if decoded:
                columns["decoded"] = pa.array([pieces.decode(ids[a:b]) for a, b in zip(bounds, bounds[1:])], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows with ``ids``; a null list gives the empty text."""
    shared = _shared(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared)
        for batch in batches:
            texts = [pieces.library.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def model_file(name: str = "piece_bpe_32k.model") -> bytes:
    """One of the public model files."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    return encode(table(spark, sf_dir, "documents"), model_file(), decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
