"""Vector codes: each quarter of a vector as the index of its nearest codebook entry.

Rounds of assignment and averaging keep, for every part, its ``b`` closest entries with a lower bound on
the distance to each, in order, and one outer bound for all other entries. Entries move a little between
rounds, so most parts are settled by these bounds alone; what they leave open is compared in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlab.llm.common import ready_for_python, unpacked
from boutlab.operators.skew import lookup
from boutlab.session import scratch_path
from boutlab.sources.tables import save_snapshot, stage

PARTS = 4
SCALE = 1024
STATE = "_row {row}, _x array<int>, _near binary, _low binary, _outer binary, _error long, _needed binary"
# Components up to this size keep every sum below 2^53, where doubles are exact whole numbers.
LARGEST = 1 << 22


@dataclass(frozen=True)
class Settings:
    entries: int = 256
    rounds: int = 4
    # Entries that a part remembers at first, at least and at most.
    b: int = 8
    least_b: int = 2
    most_b: int = 32
    # Share of the parts that the remembered entries have to settle.
    settled: float = 0.98

    def __post_init__(self):
        if not 1 <= self.least_b <= self.b <= self.most_b or not 1 <= self.entries <= 256:
            raise ValueError("least_b <= b <= most_b, and 1 to 256 entries")


@dataclass
class Codes:
    """Every row with ``code`` and ``error``, and the final codebooks: parts x entries x components."""

    rows: DataFrame
    codebooks: np.ndarray
    # Per round: remembered entries, and the parts that needed 1, 2, ... entries or all of them.
    history: list[tuple[int, np.ndarray]] = field(default_factory=list)


def below(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are never greater."""
    small = x.astype(np.float32)
    return np.where(small > x, np.nextafter(small, np.float32(-np.inf)), small)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries; whole numbers, exact in doubles (see LARGEST)."""
    return (x * x).sum(1)[:, None] - 2.0 * (x @ book.T) + (book * book).sum(1)[None, :]


@dataclass
class Part:
    """One part of a batch of vectors: its closest entries, their bounds and the outer bound."""

    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray
    error: np.ndarray
    needed: np.ndarray

    @classmethod
    def fresh(cls, x: np.ndarray, book: np.ndarray, b: int) -> Part:
        """All distances; the ``b`` smallest are kept, ties to the lower index."""
        squared = distances(x, book)
        order = np.argsort(squared, axis=1, kind="stable")
        near = order[:, :b]
        low = np.sqrt(np.take_along_axis(squared, near, 1))
        rest = order[:, b : b + 1]
        outer = np.sqrt(np.take_along_axis(squared, rest, 1)[:, 0]) if rest.size else np.full(len(x), np.inf)
        low, outer = below(_less(low)), below(_less(outer))
        error = np.take_along_axis(squared, near[:, :1], 1)[:, 0].astype(np.int64)
        return cls(near.astype(np.uint8), low, outer, error, np.full(len(x), 255, np.uint8))

    def resized(self, b: int) -> Part:
        """Keep ``b`` entries: the bounds of those left out go into the outer one; new places hold none."""
        have = self.near.shape[1]
        if b < have:
            outer = np.minimum(self.outer, self.low[:, b:].min(1))
            return Part(self.near[:, :b], self.low[:, :b], outer, self.error, self.needed)
        more = ((0, 0), (0, b - have))
        near = np.pad(self.near, more, mode="edge")
        low = np.pad(self.low, more, constant_values=np.inf)
        return Part(near, low, self.outer, self.error, self.needed)

    def moved(self, moves: np.ndarray) -> Part:
        """Bounds after every entry went at most ``moves`` far."""
        low = below(_less(self.low.astype(float) - moves[self.near]))
        outer = below(_less(self.outer.astype(float) - moves.max(initial=0.0)))
        return Part(self.near, low, outer, self.error, self.needed)

    def assigned(self, x: np.ndarray, book: np.ndarray, b: int) -> Part:
        """Nearest entries again, comparing only what the bounds leave open."""
        part = self.resized(b)
        own = ((x - book[part.near[:, 0]]) ** 2).sum(1)
        # Smallest bound of this place and all later ones: from the first one above the distance on,
        # no entry can be as near.
        ordered = np.minimum.accumulate(np.column_stack([part.low, part.outer])[:, ::-1], 1)[:, ::-1]
        open_ = ordered[:, 1:] <= _more(np.sqrt(own))[:, None]
        needed = 1 + open_.sum(1)
        near, low, outer = part.near.copy(), part.low.copy(), part.outer.copy()
        error = own.astype(np.int64)
        low[:, 0] = below(_less(np.sqrt(own)))
        start, width = 1, 2
        while start < b:
            width = min(width, b)
            some = np.flatnonzero((needed > start) & (needed <= width))
            if some.size:
                tried = near[some, :width].astype(np.int64)
                squared = ((x[some, None, :] - book[tried]) ** 2).sum(2)
                # A place without an entry repeats another one and has no bound.
                absent = np.isinf(low[some, :width])
                squared[absent] = np.inf
                order = np.lexsort((tried, squared), axis=1)
                squared = np.take_along_axis(squared, order, 1)
                near[some, :width] = np.take_along_axis(tried, order, 1)
                low[some, :width] = below(_less(np.sqrt(squared)))
                error[some] = squared[:, 0].astype(np.int64)
            start, width = width, width * 2
        some = np.flatnonzero(needed > b)
        if some.size:
            again = Part.fresh(x[some], book, b)
            kept = again.near.shape[1]
            near[some, :kept], low[some, :kept] = again.near, again.low
            low[some, kept:], outer[some], error[some] = np.inf, again.outer, again.error
        return Part(near, low, outer, error, np.minimum(needed, 255).astype(np.uint8))


def _less(x: np.ndarray) -> np.ndarray:
    """A little less than a computed length, by more than rounding can have added; infinite stays so."""
    return np.where(np.isinf(x), x, x - np.abs(np.where(np.isinf(x), 0, x)) * 1e-12)


def _more(x: np.ndarray) -> np.ndarray:
    return -_less(-x)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is known and holds finite numbers only."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(column).isNotNull() & finite)


def encode(vectors: DataFrame, column: str = "embedding", settings: Settings = Settings()) -> Codes:
    """Learn the codebooks on all vectors and code every one of them.

    Each component becomes floor(1024 * x), and a vector four equal parts. A codebook starts as that part
    of the vectors with the smallest ``vec_id`` (null last, equal ids by their numbers); then come
    ``rounds`` rounds of assigning every part to its nearest entry, ties to the lower index, and moving
    each entry to the floored mean of its parts; then one more assignment.

    Rows travel once into a table in the shared folder; each assignment is one pass over that table and
    writes the next one, after which the one before is deleted: no shuffle but that of 4 x 256 sums per
    task, and a lost executor costs a task of the current pass. The driver holds the codebooks. ``b`` is
    adapted after each round to what settles 98 % of the parts.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors shorter than
    the longest, or of a length that four does not divide, count as followed by zeros. Fewer rows than
    entries make a codebook of so many entries; an empty table gives no rows; repeated rows are coded
    alike and count each. A component beyond 4,096 in size raises a ValueError, as distances would no
    longer be exact. All columns go along; those named ``code`` and ``error`` are replaced.
    """
    spark = vectors.sparkSession
    ready_for_python(spark, 4096)
    kept = usable(vectors, column)
    size, largest = kept.agg(F.max(F.size(column)), F.max(F.array_max(F.transform(column, F.abs)))).first()
    if (largest or 0) * SCALE >= LARGEST:
        raise ValueError(f"a component of size {largest} is too large")
    length = -(-(size or 0) // PARTS) * PARTS
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    padded = F.concat(scaled, F.array_repeat(F.lit(0), F.lit(length) - F.size(column)))
    names = vectors.columns
    rows = stage(kept.select(F.struct(*names).alias("_row"), padded.alias("_x")), "coded_vectors")
    first = rows.orderBy(F.col("_row.vec_id").asc_nulls_last(), "_x").limit(settings.entries)
    start = [r["_x"] for r in first.select("_x").collect()]
    books = _cut(np.array(start, float).reshape(len(start), length))
    schema = STATE.format(row=rows.schema["_row"].dataType.simpleString())
    b, state, history = min(settings.b, max(1, len(start))), rows, []
    older, moves = None, None
    for turn in range(settings.rounds + 1):
        path = scratch_path(spark, f"codes_{turn}")
        state = save_snapshot(_assigned(state, books, moves, b, schema), path)
        if older:
            _delete(spark, older)
        older = path
        if turn == settings.rounds:
            break
        if turn:
            history.append((b, _needed(state, b)))
            b = _adapted(b, history[-1][1], settings, len(start))
        grown = _averaged(state, books)
        moves = [_more(np.sqrt(((new - old) ** 2).sum(1))) for new, old in zip(grown, books, strict=True)]
        books = grown
    # The nearest entry is the first of each part's remembered ones.
    nearest = [f"substring(_near, 1 + {i} * length(_near) div {PARTS}, 1)" for i in range(PARTS)]
    code = F.expr(f"lower(hex(concat({', '.join(nearest)})))")
    coded = unpacked(state.select("_row", code.alias("code"), F.col("_error").alias("error")), names, ["code", "error"])
    return Codes(coded, books.astype(np.int64), history)


def _cut(x: np.ndarray) -> np.ndarray:
    """Rows of vectors as parts x rows x components."""
    return x.reshape(len(x), PARTS, x.shape[1] // PARTS).transpose(1, 0, 2)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float)
    return _cut(flat.reshape(batch.num_rows, PARTS * width))


def _assigned(state: DataFrame, books: np.ndarray, moves, b: int, schema: str) -> DataFrame:
    """The next state of every row: from bounds if it has some, else from all distances."""

    def parts_of(batch: pa.RecordBatch, x: np.ndarray) -> Iterator[Part]:
        for k in range(PARTS):
            if moves is None:
                yield Part.fresh(x[k], books[k], b)
                continue

            def read(name, kind, k=k):
                whole = np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
                return whole.reshape(batch.num_rows, PARTS, -1)[:, k]

            low = read("_low", "<f4")
            kept = Part(read("_near", np.uint8), low, read("_outer", "<f4")[:, 0], low[:, 0], low[:, 0])
            yield kept.moved(moves[k]).assigned(x[k], books[k], b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = list(parts_of(batch, _vectors(batch, books.shape[2])))

            def packed(name, parts=parts):
                whole = np.stack([getattr(p, name).reshape(len(p.near), -1) for p in parts], 1)
                return pa.array([row.tobytes() for row in whole], pa.binary())

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"),
                    batch.column("_x"),
                    *[packed(n) for n in ("near", "low", "outer")],
                    pa.array(sum(p.error for p in parts), pa.int64()),
                    packed("needed"),
                ],
                names=["_row", "_x", "_near", "_low", "_outer", "_error", "_needed"],
            )

    return state.mapInArrow(run, schema)


def _averaged(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries moved to the floored mean of their parts; unused ones stay."""
    count, width = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, count, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, width).astype(np.int64)
            near = np.frombuffer(b"".join(batch.column("_near").to_pylist()), np.uint8)
            near = near.reshape(batch.num_rows, PARTS, -1)[:, :, 0]
            for k in range(PARTS):
                np.add.at(sums[k, :, 1:], near[:, k], x[k])
                sums[k, :, 0] += np.bincount(near[:, k], minlength=count)
        part, entry = np.nonzero(sums[:, :, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "sums"],
        )

    partial = state.select("_x", "_near").mapInArrow(run, "part int, entry int, sums array<long>")
    totals = partial.groupBy("part", "entry").agg(
        F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 1)]).alias("sums")
    )
    moved = books.copy()
    # At most one row per entry.
    for row in totals.collect():
        rows, *whole = row["sums"]
        moved[row["part"], row["entry"]] = [s // rows for s in whole]
    return moved


def _needed(state: DataFrame, b: int) -> np.ndarray:
    """How many parts needed 1, 2, ..., b entries, and more than that."""
    numbers = [F.conv(F.hex(F.substring("_needed", i + 1, 1)), 16, 10).cast("int") for i in range(PARTS)]
    each = F.explode(F.array(*numbers))
    counts = np.zeros(b + 1, np.int64)
    for row in state.select(each.alias("n")).groupBy("n").count().collect():
        counts[min(row["n"], b + 1) - 1] += row["count"]
    return counts


def _adapted(b: int, needed: np.ndarray, settings: Settings, entries: int) -> int:
    """The fewest entries that would have settled enough parts; twice as many where none would."""
    share = np.cumsum(needed) / max(1, needed.sum())
    if share[b - 1] < settings.settled:
        wanted = 2 * b
    else:
        wanted = int(np.argmax(share >= settings.settled)) + 1
    return max(1, min(max(wanted, settings.least_b), settings.most_b, entries))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(codebooks: np.ndarray) -> str:
    """All numbers of the codebooks by part, entry and position."""
    return ",".join(map(str, codebooks.reshape(-1).tolist()))


def coded_with_label_errors(vectors: DataFrame, column: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``encode`` with the errors summed per label, nulls together, and the checksum of the codebooks.

    The sums are one row per label; rows of a label that holds much of the table are spread over copies
    of its sum where these are too many to broadcast.
    """
    codes = encode(vectors, column, settings)
    keyed = codes.rows.withColumns(
        {"_label": F.coalesce(F.col("label").cast("string"), F.lit("")), "_none": F.col("label").isNull()}
    )
    sums = keyed.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"))
    joined = lookup(keyed, stage(sums, "label_errors"), ["_label", "_none"], ["vec_id", "code"])
    digest = hashlib.sha256(written(codes.codebooks).encode()).hexdigest()
    return joined.drop("_label", "_none").withColumn("codebooks_sha256", F.lit(digest))
