"""Vector bin packing of tokenised examples into training sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlab.llm.common import ready_for_python
from boutlab.llm.tokens import default_paths, encoder

SCHEMA = (
    "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, "
    "sequence_id long, offset long"
)
END_OF_TEXT = 0


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most. ``tokens`` has to be a power of two."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    # Remainders of so many documents are placed against each other.
    pool: int = 1024

    def __post_init__(self):
        if self.tokens & (self.tokens - 1) or min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("tokens must be a power of two, and all limits at least 1")


@dataclass
class _Example:
    """A document with the prefix sums of its loss-bearing tokens; ``start`` moves as it is cut."""

    doc_id: int | None
    ids: np.ndarray
    loss: np.ndarray
    start: int = 0

    @property
    def left(self) -> int:
        return len(self.ids) - self.start

    def loss_of(self, length: int) -> int:
        return int(self.loss[self.start + length] - self.loss[self.start])

    def most(self, tokens: int, loss: int) -> int:
        """The longest piece from ``start`` within both limits."""
        end = np.searchsorted(self.loss, self.loss[self.start] + loss, side="right") - 1
        return int(min(tokens, self.left, end - self.start))


@dataclass
class _Packer:
    limits: Limits
    first_sequence: int
    made: int = 0
    pool: list[_Example] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def add(self, example: _Example) -> None:
        """Full sequences at once, the remainder into the pool."""
        while (n := example.most(self.limits.tokens, self.limits.loss_tokens)) == self.limits.tokens:
            self._close([(example, example.start, n)])
            example.start += n
        if example.left:
            self.pool.append(example)

    def _close(self, pieces: list[tuple[_Example, int, int]]) -> None:
        """Write a bin as sequences without padding: one, or one for each power of two in its length."""
        total, at = sum(n for _, _, n in pieces), 0
        sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        room = sizes.pop(0)
        for example, start, length in pieces:
            while length:
                if not room:
                    room, at = sizes.pop(0), 0
                    self.made += 1
                n = min(length, room)
                loss = int(example.loss[start + n] - example.loss[start])
                ids = example.ids[start : start + n].tobytes()
                place = (self.first_sequence + self.made, at)
                self.rows.append((example.doc_id, start, n, ids, loss, len(example.ids), *place))
                start, length, room, at = start + n, length - n, room - n, at + n
        self.made += 1

    def place(self) -> None:
        """Fill bins one after another until the pool is empty.

        Next into the open bin goes the example with the largest dot product of its demands and the
        bin's remaining capacities, both as shares of the limits, among those that fit. When none
        fits whole, the one with the largest product is cut to what does.
        """
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        need = np.array([[e.left, 1, e.loss_of(e.left)] for e in self.pool], float).reshape(-1, 3) / most
        while len(need):
            free, pieces = np.ones(3), []
            while len(need) and (free > 1e-9).all():
                score = need @ free
                fits = (need <= free + 1e-9).all(axis=1)
                k = int(np.argmax(np.where(fits, score, -1.0) if fits.any() else score))
                e = self.pool[k]
                tokens, loss = np.rint(free[[0, 2]] * most[[0, 2]]).astype(int)
                n = e.left if fits[k] else e.most(tokens, loss)
                if n < 1:
                    break
                pieces.append((e, e.start, n))
                free = free - np.array([n, 1, e.loss_of(n)]) / most
                e.start += n
                if e.left:
                    need[k] = np.array([e.left, 1, e.loss_of(e.left)]) / most
                else:
                    self.pool[k] = self.pool[-1]
                    self.pool.pop()
                    need[k] = need[-1]
                    need = need[:-1]
            self._close(pieces)

    def take(self) -> pd.DataFrame:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=names)


def pack(
    examples: DataFrame,
    tokenizer: str | None = None,
    ranks: str | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Cut and place every example into sequences, one row per piece, with its ids.

    ``examples`` has ``doc_id`` and ``text``, and for instruction data ``prompt``, whose tokens come
    first and bear no loss. An example is the ids of both and then id 0. The first id of an example
    never bears loss either, as nothing stands before it. Each id lies in exactly one piece, cut at
    any place; sequences keep within all three limits at once and need no padding: a bin that ends up
    with less than ``limits.tokens`` is written as sequences of powers of two.

    Every task packs the documents of its own input partition, so nothing is shuffled and memory is
    bounded by ``limits.pool`` examples; a lost task is packed again alike. Sequence ids are unique,
    not gapless.

    A null or empty text gives the one id 0; a null doc_id stays null; repeated rows are packed each
    on its own; an empty table gives no rows; other columns are ignored.
    """
    spark = examples.sparkSession
    ready_for_python(spark)
    if tokenizer is None:
        tokenizer, ranks = default_paths()
    prompted = "prompt" in examples.columns
    prompt = F.coalesce("prompt", F.lit("")) if prompted else F.lit("")
    texts = examples.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), prompt.alias("prompt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder(tokenizer, ranks)
        packer = _Packer(limits, TaskContext.get().partitionId() << 40)
        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at : at + 64]
                prompts = model.encode(part.prompt.tolist()) if prompted else [()] * len(part)
                for doc_id, lead, ids in zip(part.doc_id, prompts, model.encode(part.text.tolist()), strict=True):
                    packer.add(_example(doc_id, lead, ids))
                if len(packer.pool) >= limits.pool:
                    packer.place()
                if packer.rows:
                    yield packer.take()
        packer.place()
        yield packer.take()

    return texts.mapInPandas(run, SCHEMA)


def _example(doc_id, lead, ids: np.ndarray) -> _Example:
    whole = np.concatenate([np.asarray(lead, "<u4"), ids, np.array([END_OF_TEXT], "<u4")]).astype("<u4")
    bears = np.ones(len(whole), np.int64)
    bears[: max(1, len(lead))] = 0
    return _Example(None if pd.isna(doc_id) else int(doc_id), whole, np.concatenate([[0], np.cumsum(bears)]))
