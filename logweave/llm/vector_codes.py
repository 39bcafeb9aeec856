"""Vector code compression: product codes found by equal-average search.

Every component becomes an integer, each vector is cut into equal consecutive
parts, and each part is replaced by the index of the nearest entry of that part
position's codebook. Codebooks start as the parts of the first vectors and are
refined in rounds: assign every part, then replace each entry by the floored
mean of its parts; an entry without parts stays.

The nearest entry is found without looking at all of them. For two vectors of d
components whose sums differ by g, the squared distance is at least g * g / d.
The entries are sorted by component sum; the search starts at the part's own
sum and goes outward on both sides, and a side ends as soon as its squared gap
over d strictly exceeds the best distance so far. Strictly, so that an equally
near entry with a lower index is still met.

Each pass reads the vectors once in `mapInArrow`; a task returns one row for
each entry (count and component sums), which Spark adds up. Only codebooks
(parts x entries x components) reach the driver.

Defined cases: a vector that is null or holds a null or non-finite component is
dropped. A vector that cannot be coded - its length is not the most frequent
one (ties: the longer), that length is no multiple of the number of parts, or a
component is so large that 64-bit distances could overflow - keeps its row with
null code and errors. Rows that repeat an id are coded one by one; among them
the first entries are taken in order of their components; rows without an id
come last. Empty tables give empty codebooks and an empty result. Only the
named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Scratch


@dataclass
class Codebooks:
    """`entries[p, e]` is entry e of part position p: parts x entries x
    components. `limit` bounds the components whose distances fit 64 bits."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    @property
    def limit(self) -> int:
        parts, _, d = self.entries.shape
        return (1 << 29) // max(1, d * math.isqrt(4 * parts))

    def sha256(self) -> str:
        """Digest of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of every part:
    `points` is vectors x parts x components, `books` parts x entries x
    components, all integers. Ties go to the lower index."""
    n, parts, d = points.shape
    size = books.shape[1]
    sums = books.sum(2)
    order = np.argsort(sums, axis=1, kind="stable")
    ranked = np.take_along_axis(sums, order, 1)
    flat = np.ascontiguousarray(points.transpose(1, 0, 2)).reshape(parts * n, d)
    own = flat.sum(1)
    part = np.repeat(np.arange(parts), n)
    start = np.concatenate([np.searchsorted(ranked[p], own[p * n:(p + 1) * n]) for p in range(parts)] or [np.zeros(0, np.int64)])
    best = np.full(parts * n, np.iinfo(np.int64).max // max(1, d))
    index = np.full(parts * n, size)
    searching = {-1: np.arange(parts * n), 1: np.arange(parts * n)}
    for step in range(size):
        for side, offset in ((-1, -1 - step), (1, step)):
            rows = searching[side]
            rows = rows[(start[rows] + offset >= 0) & (start[rows] + offset < size)]
            at = start[rows] + offset
            gap = ranked[part[rows], at] - own[rows]
            within = gap * gap <= d * best[rows]
            rows, at = rows[within], at[within]
            searching[side] = rows
            entry = order[part[rows], at]
            diff = flat[rows] - books[part[rows], entry]
            dist = np.einsum("ij,ij->i", diff, diff)
            better = (dist < best[rows]) | ((dist == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = dist[better], entry[better]
        if not len(searching[-1]) and not len(searching[1]):
            break
    return index.reshape(parts, n).T, best.reshape(parts, n).T


def _vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, values) of the usable vectors of a list column: places
    of those without null or non-finite components, and their components after
    scaling and flooring, as doubles one vector after the other."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), lengths)
    with np.errstate(over="ignore", invalid="ignore"):
        bad = bad | ~np.isfinite(values)
        values = np.floor(values * scale)
    usable = column.is_valid().to_numpy(zero_copy_only=False)
    usable[owner[bad]] = False
    return np.flatnonzero(usable), lengths[usable], values[usable[owner]]


def _first_vectors(vectors: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """The initial codebooks: parts of the `entries` smallest ids. Each batch
    returns its own smallest ids of every length and how many it has seen."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, values = _vectors(batch.column(1), scale)
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            ids = batch.column(0).take(pa.array(rows))
            chosen, counted = [], []
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                cols = [values[starts[i]:starts[i + 1]] for i in at.tolist()]
                known = ids.take(pa.array(at)).to_pylist()
                first = sorted(range(len(at)), key=lambda i: (known[i] is None, known[i] if known[i] is not None else 0, cols[i].tolist()))[:entries]
                chosen += [(known[i], cols[i].tolist(), length) for i in first]
                counted += [len(at), *[0] * (len(first) - 1)]
            ids_, cols_, lens_ = zip(*chosen) if chosen else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_, batch.schema.field(0).type), pa.array(cols_, pa.list_(pa.float64())), pa.array(lens_, pa.int64()), pa.array(counted, pa.int64())],
                names=["vec_id", "vec", "length", "n"])

    scratch = Scratch(vectors.sparkSession, "vector_codes")
    first = scratch.write(vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, vec array<double>, length long, n long"), "first")
    common = first.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if common is None or common.length == 0 or common.length % parts:
        return np.zeros((parts, 0, 0), np.int64)
    d = common.length // parts
    limit = Codebooks(np.zeros((parts, 0, d), np.int64), scale).limit
    rows = (first.where(F.col("length") == common.length).where(F.expr(f"forall(vec, x -> abs(x) <= {limit})"))
            .orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect())
    if not rows:
        return np.zeros((parts, 0, d), np.int64)
    return np.array([r.vec for r in rows], np.float64).astype(np.int64).reshape(len(rows), parts, d).transpose(1, 0, 2).copy()


def _assigned(column: pa.Array, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, coded, points, index, distance) of a batch: places of the usable
    vectors, which of those can be coded, and for these their parts, entries
    and distances."""
    parts, _, d = books.entries.shape
    rows, lengths, values = _vectors(column, books.scale)
    coded = lengths == books.width if books.entries.size else np.zeros(len(rows), bool)
    owner = np.repeat(np.arange(len(rows)), lengths)
    coded[owner[np.abs(values) > books.limit]] = False
    points = values[coded[owner]].astype(np.int64).reshape(int(coded.sum()), parts, d)
    index, dist = nearest(points, books.entries) if len(points) else (np.zeros((0, parts), np.int64), np.zeros((0, parts), np.int64))
    return rows, coded, points, index, dist


def _refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: assign every part, then floored means."""
    parts, size, d = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * size, d), np.int64), np.zeros(parts * size, np.int64)
        for batch in batches:
            _, _, points, index, _ = _assigned(batch.column(0), books)
            cell = (index + np.arange(parts) * size).ravel()
            count += np.bincount(cell, minlength=parts * size)
            for j in range(d):       # a batch's sums are exact in doubles
                total[:, j] += np.bincount(cell, points[:, :, j].ravel(), parts * size).astype(np.int64)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), *[pa.array(total[used, j]) for j in range(d)]], names=["cell", "n", *[f"s{j}" for j in range(d)]])

    sums = [f"s{j}" for j in range(d)]
    seen = vectors.select("embedding").mapInArrow(run, ", ".join(f"{c} long" for c in ["cell", "n", *sums]))
    out = books.entries.reshape(parts * size, d).copy()
    for r in seen.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).collect():
        out[r.cell] = [r[c] // r.n for c in sums]
    return Codebooks(out.reshape(parts, size, d), books.scale)


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of all rows of `vectors` (vec_id, embedding): a component x
    counts as floor(scale * x)."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries must be from 1 to 256, parts at least 1")
    books = Codebooks(_first_vectors(vectors, parts, entries, scale), scale)
    for _ in range(rounds if books.entries.size else 0):
        books = _refined(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every usable row of `vectors` (vec_id,
    embedding, label): code has two hexadecimal digits for each part, error is
    the sum of the parts' squared distances."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, coded, _, index, dist = _assigned(batch.column(2), books)
            code, error = np.full(len(rows), None, object), np.zeros(len(rows), np.int64)
            if len(index):
                code[coded] = [row.tobytes().hex() for row in np.ascontiguousarray(index, np.uint8)]
            error[coded] = dist.sum(1)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=~coded)],
                names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of every usable row, and the
    codebooks. label_error sums error over equal labels, nulls together; null
    where no row of the label could be coded."""
    scratch = Scratch(vectors.sparkSession, "vector_codes")
    books = fit(vectors, parts, entries, rounds, scale)
    coded = scratch.write(encode(vectors, books), "coded")
    totals = scratch.write(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    joined = coded.join(scratch.small(totals, "labels"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error"), books


def decoder(books: Codebooks) -> Callable[[str], list[float]]:
    """The vector that a code stands for."""
    def decode(code: str) -> list[float]:
        return [x / books.scale for p in range(books.entries.shape[0]) for x in books.entries[p, int(code[2 * p:2 * p + 2], 16)].tolist()]
    return decode
