"""Quality classifier: a convolutional network over bytes, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlab.llm.common import ready_for_python, texts


@dataclass(frozen=True)
class Shape:
    """Filters look at ``width`` bytes, every ``stride`` bytes; a chunk is ``chunk`` blocks of
    ``block`` places and shares its last block with the next one."""

    filters: int = 24
    width: int = 6
    stride: int = 2
    block: int = 64
    chunk: int = 4


@dataclass
class ByteNet:
    """``table[w, b, f]``: weight of byte b at place w of filter f. Chunks are max-pooled to one value
    per filter; the mean and the maximum over a document's chunks go into one logistic output."""

    shape: Shape
    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float = 0.0

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses as blocks: (blocks, places in a block, filters)."""
        s = self.shape
        places = max(1, -(-len(data) // s.stride))
        blocks = -(-places // s.block)
        padded = np.zeros(blocks * s.block * s.stride + s.width, np.uint8)
        padded[: len(data)] = data
        end = blocks * s.block * s.stride
        total = self.table[0][padded[0 : end : s.stride]] + self.bias
        for w in range(1, s.width):
            total += self.table[w][padded[w : end + w : s.stride]]
        return total.reshape(blocks, s.block, -1)

    def windows(self, blocks: int) -> np.ndarray:
        """First block of every chunk; the last chunk ends with the text."""
        return np.arange(0, max(1, blocks - 1), self.shape.chunk - 1)

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """Chunk features of one text: (chunks, filters)."""
        best = self.responses(data).max(axis=1)
        starts = self.windows(len(best))
        ends = np.minimum(starts + self.shape.chunk, len(best))
        return np.maximum(np.array([best[a:b].max(axis=0) for a, b in zip(starts, ends, strict=True)]), 0)

    def logit(self, chunks: np.ndarray) -> float:
        features = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), [1.0]])
        return float(features @ self.out) + self.offset

    def score(self, text: bytes) -> float:
        x = self.logit(self.pooled(np.frombuffer(text, np.uint8)))
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


@dataclass
class _Adam:
    rate: float
    step: int = 0
    state: dict = field(default_factory=dict)

    def update(self, name: str, value: np.ndarray, slope: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (slope - m)
        v += 0.001 * (slope * slope - v)
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        value -= (scale * m / (np.sqrt(v) + 1e-8)).astype(value.dtype)


def train(samples: Sequence[bytes], labels: Sequence[int], shape: Shape = Shape(), epochs: int = 5, seed: int = 7) -> ByteNet:
    """Fit by Adam on batches of 16; gradients pass only through the winning place of each maximum.

    Classes weigh the same whatever their share in the sample.
    """
    rng = np.random.default_rng(seed)
    f = shape.filters
    net = ByteNet(
        shape,
        rng.normal(0, 0.3, (shape.width, 256, f)).astype(np.float32),
        np.zeros(f, np.float32),
        rng.normal(0, 0.1, 2 * f + 1).astype(np.float32),
    )
    truth = np.asarray(labels, float)
    share = np.clip(truth.mean() if len(truth) else 0.5, 1e-3, 1 - 1e-3)
    weight = np.where(truth == 1, 0.5 / share, 0.5 / (1 - share))
    data = [np.frombuffer(x, np.uint8) for x in samples]
    adam = _Adam(0.004)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 16):
            slopes = {"table": np.zeros_like(net.table), "bias": np.zeros_like(net.bias), "out": np.zeros_like(net.out)}
            batch = order[at : at + 16]
            for i in batch:
                _backward(net, data[i], truth[i], weight[i] / len(batch), slopes)
            adam.step += 1
            for name, slope in slopes.items():
                value = getattr(net, name)
                adam.update(name, value, slope + 1e-4 * value)
    return net


def _backward(net: ByteNet, data: np.ndarray, truth: float, weight: float, slopes: dict) -> None:
    s, f = net.shape, net.shape.filters
    response = net.responses(data)
    place = response.argmax(axis=1)
    best = np.take_along_axis(response, place[:, None, :], axis=1)[:, 0, :]
    starts = net.windows(len(best))
    ends = np.minimum(starts + s.chunk, len(best))
    winner = np.array([a + best[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
    columns = np.arange(f)
    chunks = np.maximum(best[winner, columns], 0)
    features = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), [1.0]])
    p = 1 / (1 + np.exp(-np.clip(features @ net.out, -60, 60)))
    error = weight * (p - truth)
    slopes["out"] += error * features
    back = np.repeat(error * net.out[:f][None, :] / len(chunks), len(chunks), axis=0)
    back[chunks.argmax(axis=0), columns] += error * net.out[f : 2 * f]
    back = np.where(chunks > 0, back, 0)
    slopes["bias"] += back.sum(axis=0)
    position = (winner * s.block + place[winner, columns]) * s.stride
    padded = np.zeros(len(best) * s.block * s.stride + s.width, np.uint8)
    padded[: len(data)] = data
    for w in range(s.width):
        np.add.at(slopes["table"][w], (padded[position + w], np.broadcast_to(columns, position.shape)), back)


def training_rows(docs: DataFrame, labels: DataFrame, usable, per_class: int) -> list:
    """(text, label) of at most ``per_class`` labelled documents of each label, chosen by hash."""
    known = labels.filter("quality IN (0, 1)").filter(usable).select("doc_id", F.col("quality").alias("label")).distinct()
    wanted = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        wanted = some if wanted is None else wanted.unionByName(some)
    # At most 2 * per_class rows, so this side may be broadcast whatever the table's size.
    return texts(docs).join(F.broadcast(wanted), "doc_id").select("text", "label").collect()


def fit_quality(docs: DataFrame, labels: DataFrame, usable, per_class: int = 1500, shape: Shape = Shape(), epochs: int = 5) -> ByteNet:
    """Train on whole texts of a bounded sample, at most ``per_class`` documents of each label.

    ``usable`` is a condition on ``doc_id``: rows it rejects are never learnt from. The output is then
    moved to the share of good labels among all usable ones. Without rows of both labels the score is
    that share for every text, or 0.5.
    """
    rows = training_rows(docs, labels, usable, per_class)
    rows.sort(key=lambda r: (r.label, r.text))
    counts = dict(labels.filter("quality IN (0, 1)").filter(usable).groupBy("quality").count().collect())
    net = train([r.text.encode("utf-8", "surrogatepass") for r in rows], [r.label for r in rows], shape, epochs)
    ones, zeros = counts.get(1, 0) + 1, counts.get(0, 0) + 1
    if len({r.label for r in rows}) < 2:
        net.out[:] = 0
    net.offset = float(np.log(ones / zeros))
    return net


def score_quality(docs: DataFrame, net: ByteNet) -> DataFrame:
    """(doc_id, score) of every row, over the whole text.

    A null text counts as an empty one and is scored as such; repeated rows are scored each; an empty
    table gives no rows; no column but the text is looked at.
    """
    ready_for_python(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = [net.score(t.encode("utf-8", "surrogatepass")) for t in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id, "score": scores})

    return texts(docs).mapInPandas(run, "doc_id long, score double")
