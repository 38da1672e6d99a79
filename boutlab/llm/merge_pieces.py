"""SentencePiece encoding and decoding of merge-type vocabularies.

Symbols next to each other wait on an agenda ordered by the score of the piece they would make; the
best pair merges first, the leftmost of equals, until no neighbours make a piece. Characters without a
piece become bytes. The library itself encodes and decodes every Arrow batch again, as a check.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlab.llm.common import ready_for_python

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string, agrees boolean"
# Segments that one worker remembers, and the longest of them in characters.
REMEMBERED, SHORT = 1_000_000, 32
# Texts that one task remembers, and the longest of them in characters.
COPIES, COPIED = 10_000, 8_000
LEFT, SCORE = 16, 64
# Above every rank, and a symbol of no piece.
NEVER, END = 1 << 32, "\ud800"
LENGTHS, PLACES = (1 << LEFT) - 1, (1 << SCORE - LEFT) - 1

_MODELS: dict[str, MergePieces] = {}


class _Segments(dict):
    """Ids of segments met before; new ones are encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, segment: str) -> bytes:
        ids = self._encode(segment)
        if len(segment) <= SHORT and len(self) < REMEMBERED:
            self[segment] = ids
        return ids


class MergePieces:
    """Pieces and scores of a model file, and the two directions over them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as layout

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = layout.ModelProto.FromString(self.library.serialized_model_proto())
        kinds = layout.ModelProto.SentencePiece
        if model.trainer_spec.model_type != layout.TrainerSpec.BPE:
            raise ValueError(f"{path} is no merge-type vocabulary")
        if any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in model.pieces):
            raise ValueError(f"{path} has unused or user-defined pieces")
        if not model.normalizer_spec.escape_whitespaces:
            raise ValueError(f"{path} keeps spaces apart from word starts")
        plain = [(i, p) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self._packed = {p.piece: _number(i) for i, p in plain}
        rank = {score: r for r, score in enumerate(sorted({p.score for _, p in plain}, reverse=True))}
        # Entries of the agenda are numbers: rank of the score, place of the left symbol, length made.
        self._rank = {p.piece: rank[p.score] for _, p in plain}
        self._wanted = {piece: r << SCORE | len(piece) for piece, r in self._rank.items()}
        self._bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self._byte_of = {i: b for b, i in self._bytes.items()}
        self._fallback = model.trainer_spec.byte_fallback
        self._pieces = [p.piece for p in model.pieces]
        self._control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self._unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self._unknown_text = model.trainer_spec.unk_surface
        self._begin, self._end = _number(self.library.bos_id()), _number(self.library.eos_id())
        normal = model.normalizer_spec
        self._plain_text = (
            not normal.precompiled_charsmap
            and normal.add_dummy_prefix
            and not normal.remove_extra_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
        )
        self._strips_first = normal.add_dummy_prefix or normal.remove_extra_whitespaces
        self._strips_all = normal.remove_extra_whitespaces
        self._written = [self._bytes_of(i) for i in range(len(self._pieces))]
        self._segment = re.compile(self._segments())
        self._known = _Segments(self._merge)

    def _bytes_of(self, i: int) -> bytes:
        """What an id stands for inside a text."""
        if i in self._byte_of:
            return bytes([self._byte_of[i]])
        if i in self._control:
            return b""
        text = self._unknown_text if i == self._unknown else self._pieces[i].replace(SPACE, " ")
        return text.encode("utf-8")

    def _segments(self) -> str:
        """A pattern that cuts texts, their spaces still plain ones, where no merge can reach across.

        Such a place lies between two characters that stand side by side in no piece. Looked for are
        the starts of words, the ends of runs of letters, and characters that no longer piece has. Without
        bytes, unknown characters side by side count as one, so nothing is cut.
        """
        pairs = {pair for p in self._packed for pair in zip(p, p[1:], strict=False)}
        if not self._fallback or any(y == SPACE != x for x, y in pairs):
            return "(?s).+"
        joined = {c for pair in pairs for c in pair}
        alone = "".join(chr(c) for c in range(128) if chr(c) not in joined and chr(c) != " " and not chr(c).isalpha())
        letters = {c for c in joined if c.isalpha()}
        # Without those that some piece follows up with another character, and then those before them.
        while led_on := {x for x, y in pairs if x in letters and y not in letters}:
            letters -= led_on
        if not letters:
            return " +[^ ]*|[^ ]+"
        alone, run = (re.escape("".join(sorted(x))) for x in (alone, letters))
        return rf" *[{run}]+|[{alone}]|(?: +|[^ {alone}{run}])[^ {alone}{run}]*[{run}]*"

    def encode(self, text: str) -> bytes:
        """Ids with those of begin and end, as little-endian unsigned 32-bit numbers."""
        if not text:
            normal = ""
        elif self._plain_text:
            normal = " " + text.replace(SPACE, " ")
        else:
            normal = self.library.normalize(text).replace(SPACE, " ")
        found = map(self._known.__getitem__, self._segment.findall(normal))
        return b"".join([self._begin, *found, self._end])

    def _merge(self, text: str) -> bytes:
        symbols = list(text.replace(" ", SPACE))
        return (self._merge_few if len(symbols) <= SHORT else self._merge_many)(symbols)

    def _merge_many(self, symbols: list[str]) -> bytes:
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        wanted = self._wanted.get
        first = map(wanted, map(add, symbols, symbols[1:]))
        agenda = [key + (left << LEFT) for left, key in enumerate(first) if key is not None]
        heapify(agenda)
        while agenda:
            key = heappop(agenda)
            left = key >> LEFT & PLACES
            right = after[left]
            # A symbol that has grown or gone since makes another piece.
            if not symbols[left] or right < 0 or len(symbols[left]) + len(symbols[right]) != key & LENGTHS:
                continue
            whole = symbols[left] = symbols[left] + symbols[right]
            symbols[right] = ""
            behind = after[left] = after[right]
            if behind >= 0:
                before[behind] = left
                key = wanted(whole + symbols[behind])
                if key is not None:
                    heappush(agenda, key + (left << LEFT))
            front = before[left]
            if front >= 0:
                key = wanted(symbols[front] + whole)
                if key is not None:
                    heappush(agenda, key + (front << LEFT))
        return self._ids_of([s for s in symbols if s])

    def _merge_few(self, symbols: list[str]) -> bytes:
        """The same for a short text: its agenda is a list by place, whose first least entry is next."""
        wanted = self._rank.get
        # No piece has END, so what would pass either end of the text gets no rank.
        symbols.append(END)
        agenda = list(map(wanted, map(add, symbols, symbols[1:]), repeat(NEVER)))
        agenda.append(NEVER)
        while (best := min(agenda)) != NEVER:
            at = agenda.index(best)
            whole = symbols[at] = symbols[at] + symbols.pop(at + 1)
            del agenda[at]
            agenda[at] = wanted(whole + symbols[at + 1], NEVER)
            agenda[at - 1] = wanted(symbols[at - 1] + whole, NEVER)
        symbols.pop()
        return self._ids_of(symbols)

    def _ids_of(self, symbols: list[str]) -> bytes:
        packed = self._packed
        try:
            return b"".join(map(packed.__getitem__, symbols))
        except KeyError:
            pass  # a character without a piece
        if not self._fallback:
            # Unknown characters side by side are one.
            symbols = [s for i, s in enumerate(symbols) if s in packed or i == 0 or symbols[i - 1] in packed]
        return b"".join([packed.get(s) or self._spelt(s) for s in symbols])

    def _spelt(self, character: str) -> bytes:
        """A character without a piece: the ids of its bytes, or the one for unknown characters."""
        if not self._fallback:
            return _number(self._unknown)
        return b"".join(_number(self._bytes[b]) for b in character.encode("utf-8"))

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes joined to characters, without the space put in front."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self._strips_all:
            return self._decode_each(numbers)
        try:
            text = b"".join(map(self._written.__getitem__, numbers)).decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_each(numbers)
        first = next((i for i in numbers if i not in self._control), None)
        spaced = self._strips_first and first is not None and self._pieces[first].startswith(SPACE)
        return text[1:] if spaced else text

    def _decode_each(self, numbers: list[int]) -> str:
        """One id after another, for bytes that are no characters."""
        parts, waiting, at_start = [], bytearray(), self._strips_first
        for i in numbers:
            byte = self._byte_of.get(i)
            if byte is not None:
                waiting.append(byte)
                continue
            if waiting:
                parts.append(_characters(waiting))
                waiting, at_start = bytearray(), False
            if i in self._control:
                continue
            if i == self._unknown:
                parts.append(self._unknown_text)
                at_start = False
                continue
            piece = self._pieces[i]
            if at_start and piece.startswith(SPACE):
                piece = piece[1:]
                at_start = self._strips_all and not piece
            else:
                at_start = False
            parts.append(piece.replace(SPACE, " "))
        parts.append(_characters(waiting))
        return "".join(parts)

    def library_agrees(self, text: str, ids: bytes, decoded: str) -> bool:
        """Whether the library gives the same ids for a text, and the same text back."""
        other = self.library.encode(text, add_bos=True, add_eos=True)
        return ids == _packed(other) and self.library.decode(other) == decoded


def _number(i: int) -> bytes:
    return i.to_bytes(4, "little")


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def _characters(raw: bytearray) -> str:
    """UTF-8 read character by character; each byte that is none becomes the replacement character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    found, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                found.append(raw[at : at + size].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            found.append("\ufffd")
            size = 1
        at += size
    return "".join(found)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, model: str | None = None, at_once: int = 64) -> DataFrame:
    """Token ids of every whole text, the text they decode to, and whether the library agrees on both.

    ``ids`` are little-endian unsigned 32-bit numbers with those of begin and end; ``agrees`` compares
    them and ``decoded`` with what the sentencepiece library makes of the same batch, ``at_once`` texts
    at a time. ``model`` is the file of a merge-type vocabulary that every executor can read; one with
    unused or user-defined pieces is refused with a ValueError.

    One narrow pass without a shuffle: a task holds one batch of texts, and a lost one is encoded again.
    A text is cut at places that no merge can cross, as the start of a word, so work grows with its length;
    a stretch of n characters without such a place takes n log n steps. A null or empty text gives the
    ids of begin and end and decodes to an empty text; a null doc_id stays null; repeated rows each give
    a row; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    ready_for_python(docs.sparkSession, 256)
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _MODELS.get(path) or _MODELS.setdefault(path, MergePieces(path))
        # Copies of a text that one task meets are encoded and checked once, while they are short and few.
        known: dict[str, tuple[bytes, str, bool]] = {}

        def encoded(text: str) -> tuple[bytes, str, bool]:
            found = known.get(text)
            if found is None:
                ids = pieces.encode(text)
                decoded = pieces.decode(ids)
                found = ids, decoded, pieces.library_agrees(text, ids, decoded)
                if len(text) <= COPIED and len(known) < COPIES:
                    known[text] = found
            return found

        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                found = [encoded(t) for t in part.column(1).to_pylist()]
                ids, decoded, agrees = (list(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(decoded, pa.string()),
                        pa.array(agrees, pa.bool_()),
                    ],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(run, SCHEMA)
