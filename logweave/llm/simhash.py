"""SimHash near-duplicates by pigeonring filtering.

Fingerprint: the majority of the bits of the XXH64 hashes (seed 42) of all
word shingles. Two fingerprints link when they differ in at most `max_bits`
bits; documents in one connected component are near-duplicates.

Links are found without comparing all pairs. The 64 bits are cut into
m = max_bits + 1 segments laid on a ring. If two fingerprints differ in at
most d bits, then some segment starts a chain in which the first l segments
together differ in at most floor(l * d / m) bits, for every l (the pigeonring
principle, stricter than "one segment is equal"). So the first segment of the
chain is equal and the second differs in one bit at most: one side is entered
under (start, first, second), the other under the same key and its one-bit
neighbours in the second segment. An equi-join on that key yields candidates,
the remaining budgets of the chain prune them, and only then the whole
distance is checked. The join runs over distinct fingerprints, so a group of
equal texts enters once; its rows only meet their label in the last join,
which adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, connected_components

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of `size` words joined by a space; one for the
    whole sequence if it is shorter, none without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1:].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(text: bytes, size: int = 3) -> int:
    """64-bit fingerprint as a signed long; 0 for a text without words."""
    hashes = shingle_hashes(text, size)
    total, votes = len(hashes), np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):      # bounded memory for very long texts
        part = np.ascontiguousarray(hashes[at:at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total).view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of `docs` (doc_id, text); fp is a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [fingerprint(t.as_py() or b"", size) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the max_bits + 1 segments of 64 bits."""
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]


def _segment(fp: Column | str, shift: int, width: int) -> Column:
    mask = (1 << width) - 1 if width < 64 else -1
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(mask).cast("long"))


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of different values in `fps` (fp, distinct)
    that differ in 1 to `max_bits` bits."""
    if not 0 <= max_bits <= 15:
        raise ValueError("max_bits must be from 0 to 15")
    segs = segments(max_bits)
    m = len(segs)
    if m == 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a < b")
    starts = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), _segment("fp", *segs[i]).alias("s"), _segment("fp", *segs[(i + 1) % m]).alias("t"),
                 F.lit(segs[(i + 1) % m][1]).alias("w"))
        for i in range(m)]))
    heads = fps.select("fp", starts.alias("c")).select("fp", "c.*")
    exact = heads.select(F.col("fp").alias("a"), "i", "s", "t")
    flips = F.explode(F.sequence(F.lit(-1), F.col("w") - 1))
    near = heads.select(F.col("fp").alias("b"), "i", "s", "t", flips.alias("bit")).select(
        "b", "i", "s", F.when(F.col("bit") < 0, F.col("t")).otherwise(F.col("t").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).alias("t"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    parts = [F.bit_count(_segment(diff, *s)) for s in segs]
    chains = F.lit(False)
    for i in range(m):
        within, total = F.lit(True), F.lit(0)
        for length in range(1, m + 1):
            total = total + parts[(i + length - 1) % m]
            within = within & (total <= length * max_bits // m)
        chains = chains | ((F.col("i") == i) & within)
    # both sides are several times as large as Spark takes them for, which counts an exploded row as one
    pairs = exact.join(near.hint("merge"), ["i", "s", "t"]).where(F.col("a") < F.col("b"))
    return pairs.where(chains).where(F.bit_count(diff) <= max_bits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs` (doc_id, text).

    component_id is the smallest document id reachable over links of at most
    `max_bits` differing bits (equal fingerprints are linked). Null and empty
    texts have fingerprint 0 and link like any other; a component in which no
    row has an id has a null component_id.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, size), "rows")
    reps = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = scratch.write(connected_components(scratch, links(reps.select("fp"), max_bits)), "roots")
    grouped = reps.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = grouped.groupBy("root").agg(F.min("rep").alias("low"))
    labels = scratch.write(
        reps.join(roots.withColumnRenamed("node", "fp").join(lowest, "root").select("fp", "low"), "fp", "left")
        .select("fp", F.coalesce("low", "rep").alias("component_id")), "labels")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def fp_hex(fp: Column | str) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
