"""Language-model scores by prediction by partial matching over bytes, beside a word unigram base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlab.llm.common import ready_for_python
from boutlab.sources.tables import stage

# Longest context in bytes. A symbol is a byte or BOUNDARY, which stands before and after a text.
ORDER = 5
BOUNDARY = 256
SYMBOLS = 257
BITS = 9
# At most this many longest grams, the most frequent ones, have their scores looked up at once; all
# others are joined. Only speed depends on it.
LOOKED_UP = 1_000_000
# Contexts up to this length are few whatever the corpus, so they go to every task as a trie.
SHORT = 1
# Words of at least this share of the training tokens are looked up at once, at most 1 / WORD_SHARE;
# all others are joined.
WORD_SHARE = 5e-6
# Symbols counted or scored at a time, and distinct grams and words that a task holds before it sends them.
BLOCK = 2_000_000
_HELD_GRAMS = 2_000_000
_HELD_WORDS = 300_000


def _mask(length: int) -> int:
    return (1 << (BITS * length)) - 1


def grams(text: bytes) -> np.ndarray:
    """For every symbol of a text, its end included, itself (lowest bits) and the ORDER before it."""
    symbols = np.full(len(text) + ORDER + 1, BOUNDARY, np.int64)
    symbols[ORDER:-1] = np.frombuffer(text, np.uint8)
    n, keys = len(text) + 1, np.zeros(len(text) + 1, np.int64)
    for back in range(ORDER + 1):
        keys |= symbols[ORDER - back : ORDER - back + n] << (BITS * back)
    return keys


@dataclass
class Trie:
    """Per order k: sorted grams (context and symbol) with counts, and the sorted contexts with the
    total and number of their grams, the count of those left out, and what their symbols count
    for one order lower."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]
    pruned: list[np.ndarray]
    excluded: list[np.ndarray]

    @staticmethod
    def build(tables: list[tuple[np.ndarray, ...]]) -> Trie:
        """From (grams, counts, contexts, counts of all their grams) of every order."""
        trie = Trie([], [], [], [], [], [], [])
        for k, (keys, counts, whole, sums) in enumerate(tables):
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order].astype(float)
            contexts, first, distinct = np.unique(keys >> BITS, return_index=True, return_counts=True)
            lower = np.zeros(len(keys))
            if k and len(keys):
                at = np.searchsorted(trie.grams[k - 1], keys & _mask(k))
                lower = trie.counts[k - 1][at]
            empty = np.zeros(0)
            trie.grams.append(keys)
            trie.counts.append(counts)
            trie.contexts.append(contexts)
            trie.totals.append(np.add.reduceat(counts, first) if len(first) else empty)
            place = np.argsort(whole)
            at = np.searchsorted(whole[place], contexts)
            trie.pruned.append(sums[place][at] - trie.totals[k])
            trie.distinct.append(distinct.astype(float))
            trie.excluded.append(np.add.reduceat(lower, first) if len(first) else empty)
        return trie

    def log10(self, keys: np.ndarray, less: np.ndarray | None = None, fewer: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each key's symbol after its context.

        ``less`` and ``fewer`` say what a longer context, not in this trie, has excluded already: counts
        at the highest order, and symbols.

        From the longest context in the trie downwards: a symbol seen there gets its share, and
        escape gets as many counts as there are distinct symbols, plus those of the grams that are too
        rare for the trie. On escape, the symbols seen are excluded from the next lower order. Below
        order 0, all symbols not seen are equal.
        """
        result = np.zeros(len(keys))
        left = np.arange(len(keys))
        less = np.zeros(len(keys)) if less is None else np.array(less, float)
        fewer = np.zeros(len(keys)) if fewer is None else np.array(fewer, float)
        for k in reversed(range(len(self.grams))):
            if not len(self.grams[k]):
                continue
            own = keys[left]
            at, known = _find(self.contexts[k], (own >> BITS) & _mask(k))
            rest = np.where(known, self.totals[k][at] - less[left], 0.0)
            escape = np.where(known, self.distinct[k][at] - fewer[left] + self.pruned[k][at], 0.0)
            if k == 0 and len(self.grams[0]) == SYMBOLS:
                escape[:] = 0.0  # no symbol is left to escape to
            whole = np.maximum(rest + escape, 1e-300)
            place, found = _find(self.grams[k], own & _mask(k + 1))
            hit = found & known
            result[left[hit]] += np.log10(self.counts[k][place[hit]] / whole[hit])
            gone = ~hit & known & (escape > 0)
            result[left[gone]] += np.log10(escape[gone] / whole[gone])
            less[left] = np.where(known, self.excluded[k][at], 0.0)
            fewer[left] = np.where(known, self.distinct[k][at], 0.0)
            left = left[~hit]
        result[left] -= np.log10(max(1, SYMBOLS - len(self.grams[0])))
        return result


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def words(text: bytes) -> list[bytes]:
    """Of bytes, lower() and split() know A-Z and ASCII white space alone."""
    return text.lower().split()


def corpus_counts(training: DataFrame) -> DataFrame:
    """(word, gram, n): every word, and every longest gram, of the training texts with its count.

    The end of a text is the word '' . Tasks count what they read and send sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                seen.update(words(data))
                seen[b""] += 1
                held.append(grams(data))
                size += len(data) + 1
                if size >= BLOCK:
                    keys, n = _merged(keys, n, held)
                    held, size = [], 0
                if len(keys) >= _HELD_GRAMS:
                    yield _gram_rows(keys, n)
                    keys, n = keys[:0], n[:0]
                if len(seen) >= _HELD_WORDS:
                    yield _word_rows(seen)
                    seen.clear()
        if held:
            keys, n = _merged(keys, n, held)
        yield _gram_rows(keys, n)
        yield _word_rows(seen)

    rows = training.select("text").mapInArrow(run, "word binary, gram long, n long")
    return rows.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _merged(keys: np.ndarray, n: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, counts = np.unique(np.concatenate(held), return_counts=True)
    both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
    return both, np.bincount(place, np.concatenate([n, counts])).astype(np.int64)


def _gram_rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return _batch(_COUNTED, len(keys), gram=keys, n=n)


def _word_rows(seen: Counter) -> pa.RecordBatch:
    return _batch(_COUNTED, len(seen), word=list(seen), n=list(seen.values()))


def _batch(schema: pa.Schema, rows: int, **given) -> pa.RecordBatch:
    """Rows of the given columns; all others are null, which costs nothing a row."""
    columns = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_COUNTED = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])


@dataclass
class Model:
    """All counts of a byte trie as stored tables.

    ``seen`` has (gram, log) of every longest gram in training. For orders above SHORT, ``levels[k]`` has
    (gram, n) of every gram and ``contexts[k]`` (context, total, distinct, excluded) of every context;
    ``short`` is the trie of the orders up to SHORT.
    """

    seen: DataFrame
    levels: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    short: Trie


def build_model(counts: DataFrame) -> Model:
    """Every gram of the training texts, of all orders, whatever its count."""
    levels = {ORDER: counts.filter("gram IS NOT NULL").select("gram", "n")}
    for k in reversed(range(ORDER)):
        shorter = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(_mask(k + 1))).alias("gram"))
        levels[k] = stage(shorter.agg(F.sum("n").alias("n")), f"grams_{k}")
    contexts = {}
    for k in range(SHORT + 1, ORDER + 1):
        lower = levels[k - 1].select(F.col("gram").alias("_lower"), F.col("n").alias("_n"))
        below = F.col("gram").bitwiseAND(F.lit(_mask(k))) == F.col("_lower")
        sums = levels[k].join(lower, below).groupBy(F.shiftright("gram", BITS).alias("context"))
        contexts[k] = stage(
            sums.agg(
                F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("_n").alias("excluded")
            ),
            f"contexts_{k}",
        )
    whole = levels[ORDER].withColumn("context", F.shiftright("gram", BITS)).join(contexts[ORDER], "context")
    seen = whole.select("gram", "n", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("log"))
    tables = []
    for k in range(SHORT + 1):
        keys, n = _arrays(levels[k], "gram", "n")
        own, place = np.unique(keys >> BITS, return_inverse=True)
        tables.append((keys, n, own, np.bincount(place, n, len(own)) if len(own) else np.zeros(0)))
    return Model(stage(seen, "seen_grams"), levels, contexts, Trie.build(tables))


def _frequent(seen: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams and their scores: those of the highest counts, by eighths of a power of two."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.step, r.rows) for r in seen.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    least, held = float("inf"), 0
    for at, rows in sizes:
        held += rows
        if held > most:
            break
        least = at
    if least == float("inf"):
        return np.zeros(0, np.int64), np.zeros(0)
    grams_of, logs = _arrays(seen.filter(step >= F.lit(least)), "gram", "log")
    order = np.argsort(grams_of)
    return grams_of[order], logs[order]


def _arrays(frame: DataFrame, whole: str, number: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of longs and one of doubles, fetched as bytes: rows would take many times the memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            a, b = part[whole].to_numpy("<i8"), part[number].to_numpy("<f8")
            yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    ready_for_python(frame.sparkSession, 10_000)
    rows = frame.select(whole, F.col(number).cast("double").alias(number)).mapInPandas(run, "a binary, b binary").collect()
    return np.frombuffer(b"".join(r.a for r in rows), "<i8"), np.frombuffer(b"".join(r.b for r in rows), "<f8")


def unseen_scores(unseen: DataFrame, model: Model) -> DataFrame:
    """(gram, log) of distinct longest grams that training does not have.

    Escapes as ``Trie.log10`` does, one order after another: from the context's row, if there is one, to
    the gram of that order, if there is one; the shortest contexts are settled by ``model.short``.
    """
    zero = F.lit(0.0)
    state = unseen.select("gram", zero.alias("log"), zero.alias("less"), zero.alias("fewer"), F.lit(False).alias("done"))
    for k in reversed(range(SHORT + 1, ORDER + 1)):
        context = F.shiftright("gram", BITS).bitwiseAND(F.lit(_mask(k)))
        # At two symbols and fewer a few contexts would be hot keys; they are at most 257 ** 2.
        contexts = F.broadcast(model.contexts[k]) if k <= 2 else model.contexts[k]
        met = state.withColumn("context", context).join(contexts, "context", "left")
        if k < ORDER:
            shorter = model.levels[k].select(F.col("gram").alias("_short"), "n")
            met = met.join(shorter, F.col("gram").bitwiseAND(F.lit(_mask(k + 1))) == F.col("_short"), "left")
        else:
            met = met.withColumn("n", F.lit(None).cast("long"))
        escape = F.col("distinct") - F.col("fewer")
        whole = F.greatest(F.col("total") - F.col("less") + escape, F.lit(1e-300))
        gain = (
            F.when(F.col("done") | F.col("total").isNull(), zero)
            .when(F.col("n").isNotNull(), F.log10(F.col("n") / whole))
            .when(escape > 0, F.log10(escape / whole))
            .otherwise(zero)
        )
        state = met.select(
            "gram",
            (F.col("log") + gain).alias("log"),
            F.coalesce(F.col("excluded").cast("double"), zero).alias("less"),
            F.coalesce(F.col("distinct").cast("double"), zero).alias("fewer"),
            (F.col("done") | F.col("n").isNotNull()).alias("done"),
        )
    shared = unseen.sparkSession.sparkContext.broadcast(model.short)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, logs = frame.gram.to_numpy(np.int64), frame.log.to_numpy(float).copy()
            left = ~frame.done.to_numpy(bool)
            logs[left] += shared.value.log10(keys[left], frame.less.to_numpy(float)[left], frame.fewer.to_numpy(float)[left])
            yield pd.DataFrame({"gram": keys, "log": logs})

    return state.mapInPandas(run, "gram long, log double")


def score(docs: DataFrame, held_out: Column, looked_up: int = LOOKED_UP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``score`` is the log10 probability of the whole text, its end included, under a byte trie learnt
    from the rows that ``held_out``, a condition on doc_id, does not name. ``base_score`` is that of
    its words, and of one end, under counts of the same rows plus one.

    Frequent words and grams, of which there can be only so many, are looked up in the task that reads
    the text; the others go by (row, word) and (row, gram) to the count of the word and the score of the
    gram, and back as sums. No count is left out.

    A null text counts as an empty one, which has only its end; rows of one doc_id are scored each; a
    null doc_id is not held out; without training rows counts are zero and every symbol is equally likely;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    number = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(number, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = stage(corpus_counts(rows.filter("NOT held_out")), "corpus_counts")
    counted = counts.filter("word IS NOT NULL")
    total, vocabulary = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = counted.filter((F.col("n") >= WORD_SHARE * total) | (F.octet_length("word") == 0))
    known = {bytes(r.word): r.n for r in frequent.select("word", "n").toLocalIterator()}
    model = build_model(counts)
    shared = spark.sparkContext.broadcast((_frequent(model.seen, looked_up), known))
    ready_for_python(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often = shared.value
        logs = {w: (n, float(np.log10(n + 1))) for w, n in often.items()}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            first, plain, rare = row, [], []
            for text in data:
                tokens = words(text)
                sure, base = 0, 0.0
                end = logs.get(b"")
                for word, n in [*Counter(tokens).items(), (b"", 1)]:
                    found = logs.get(word) if word else end
                    if found:
                        sure += n
                        base += n * found[1]
                    elif word:
                        rare.append((row, word, n))
                plain.append((row, len(tokens) + 1, sure, base))
                row += 1
            if not plain:
                continue
            own = dict(zip(("row", "n_tokens", "n_known", "base"), zip(*plain, strict=True), strict=True))
            scores, left = _text_scores(table, data)
            yield _batch(_SCORED, len(data), doc_id=batch.column(0), held_out=batch.column(2), score=scores, **own)
            for texts_of, keys, n in left:
                for at in range(0, len(keys), _HELD_GRAMS):
                    part = slice(at, at + _HELD_GRAMS)
                    some = keys[part]
                    yield _batch(_SCORED, len(some), row=first + texts_of[part], gram=some, n=n[part])
            if rare:
                of, word, n = zip(*rare, strict=True)
                yield _batch(_SCORED, len(rare), row=of, word=word, n=n)

    # Written once: the documents' own sums, their rare words and their rare grams are read apart.
    scored = stage(rows.mapInArrow(run, _SCHEMA), "scored")
    rest = counted.filter((F.col("n") < WORD_SHARE * total) & (F.octet_length("word") > 0))
    joined = scored.filter("word IS NOT NULL").select("row", "word", "n").join(
        rest.select("word", F.col("n").alias("c")), "word"
    )
    more = joined.groupBy("row").agg(
        F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("_base")
    )
    asked = scored.filter("gram IS NOT NULL").select("row", "gram", "n")
    ready_for_python(spark, 10_000)
    unseen = asked.select("gram").distinct().join(model.seen.select("gram"), "gram", "left_anti")
    logs_of = stage(model.seen.select("gram", "log").unionByName(unseen_scores(unseen, model)), "gram_scores")
    rest_of = asked.join(logs_of, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("_score"))
    own = scored.filter("word IS NULL AND gram IS NULL")
    scale = float(np.log10(total + vocabulary + 1))
    return own.join(more, "row", "left").join(rest_of, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


_SCHEMA = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "word binary, gram long, n long"
)
_SCORED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("score", pa.float64()),
        ("word", pa.binary()),
        ("gram", pa.int64()),
        ("n", pa.int64()),
    ]
)


def _text_scores(table: tuple[np.ndarray, np.ndarray], data: list[bytes]) -> tuple[np.ndarray, list[tuple]]:
    """Scores of several texts over the grams of ``table``, and (text, gram, count) of all others.

    Every distinct gram of a block is looked up once.
    """
    result, left, at = np.zeros(len(data)), [], 0
    while at < len(data):
        to, size = at, 0
        while to < len(data) and (size == 0 or size + len(data[to]) < BLOCK):
            size += len(data[to]) + 1
            to += 1
        keys = [grams(t) for t in data[at:to]]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        lengths = [len(k) for k in keys]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        where, found = _find(table[0], distinct)
        logs = np.zeros(len(distinct))
        logs[found] = table[1][where[found]]
        result[at:to] = np.add.reduceat(logs[place], starts)
        missing = np.flatnonzero(~found[place])
        if len(missing):
            text = np.repeat(np.arange(at, to), lengths)[missing]
            both, n = np.unique(text * len(distinct) + place[missing], return_counts=True)
            left.append((both // len(distinct), distinct[both % len(distinct)], n))
        at = to
    return result, left
