"""Substring dedup by level-wise doubling.

A word goes if it is covered by a window of `window` words whose sequence also
starts in a document with a smaller id; windows are judged on the input.

Windows are hashed by level, each twice as long as the one before (13, 26, 50
words for a window of 50; the last level is the window itself). Only where a
window of one level is repeated across documents are the windows of the next
level formed, so after the first level the work follows the repeated text, not
the corpus; a level without survivors ends the search.

On the levels below the last, not every window is needed: of all windows of a
level inside one full window, the smallest hash is kept. Equal full windows
keep the same one, so none is lost, and the first level enters about one word
in twenty. Whole texts with equal word sequences are collapsed to their first
document beforehand; the later copies go entirely if they hold a full window.

Counting is a minimum and maximum document per hash (partially aggregated, so
a passage shared by a third of all documents crosses the shuffle once a task);
occurrences are joined with the written table of repeated hashes, which
adaptive execution can split. Word hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.bytewords import NOT_SPACE, run_hashes, slices, word_counts, word_hashes, word_spans
from logweave.llm.common import Scratch, keyed_texts

#: No level is shorter than this many words.
SHORTEST = 8


def levels(window: int) -> list[int]:
    """Window lengths, each at most twice the one before."""
    out = [window]
    while out[0] > 2 * SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def _sliding(values: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """op (minimum or maximum) over every run of `width` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    at = np.arange(max(len(words) - length + 1, 0))
    return run_hashes(words, at, at + length)


def selected(hashes: np.ndarray, run: int) -> np.ndarray:
    """Places of all values that are the smallest of some `run` consecutive ones."""
    if len(hashes) < run:
        return np.zeros(0, np.int64)
    if run == 1:
        return np.arange(len(hashes))
    low = _sliding(hashes, run, np.minimum)
    pad = np.zeros(run - 1, np.uint64)
    best = _sliding(np.concatenate([pad, low, pad]), run, np.maximum)   # largest minimum of the runs around each place
    return np.flatnonzero(hashes == best)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the spans [lo, hi) as sorted, disjoint spans."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1] if len(lo) else hi


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)).cast(kind))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _texts_to_windows(length: int, run: int):
    """(did, th, text) -> (did, th, n, seq, hs, ps): selected windows of a level."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                starts, ends = word_spans(part, NOT_SPACE)
                words = word_hashes(part.data, starts, ends)
                count = word_counts(part, starts)
                hs, ps = [], []
                for a, b in zip(count[:-1], count[1:]):
                    w = window_hashes(words[a:b], length) if b - a >= length else np.zeros(0, np.uint64)
                    at = selected(w, run)
                    hs.append(_signed(w[at]))
                    ps.append(at)
                rows = batch.slice(part.rows.start, part.rows.stop - part.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(np.diff(count).astype(np.int64)),
                     pa.array(_signed(run_hashes(words, count[:-1], count[1:]))), _lists(hs, pa.int64()), _lists(ps, pa.int32())],
                    names=["did", "th", "n", "seq", "hs", "ps"])

    return each, "did long, th long, n long, seq long, hs array<long>, ps array<int>"


def _texts_to_regions():
    """(did, th, text, lo, hi) -> (did, th, at, words): word hashes of the spans."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                starts, ends = word_spans(part, NOT_SPACE)
                words = word_hashes(part.data, starts, ends)
                count = word_counts(part, starts)
                did, th, at, runs = [], [], [], []
                for i in range(len(part)):
                    row = part.rows.start + i
                    own = words[count[i]:count[i + 1]]
                    for lo, hi in zip(batch.column(3)[row].as_py(), batch.column(4)[row].as_py()):
                        lo = max(lo, 0)
                        did.append(batch.column(0)[row].as_py())
                        th.append(batch.column(1)[row].as_py())
                        at.append(lo)
                        runs.append(_signed(own[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array(at, pa.int32()), _lists(runs, pa.int64())],
                    names=["did", "th", "at", "words"])

    return each, "did long, th long, at int, words array<long>"


def _regions_to_windows(length: int, run: int):
    """(did, th, at, words, lo, hi) -> (did, th, hs, ps): selected windows of a
    level that lie in the spans, one row a region."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ps = [], []
            for at, words, los, his in zip(*(batch.column(k) for k in range(2, 6))):
                at, own = at.as_py(), np.asarray(words.values, np.int64).view(np.uint64)
                h, p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for lo, hi in zip(los.as_py(), his.as_py()):
                    lo, hi = max(lo, at), min(hi, at + len(own))
                    if hi - lo >= length:
                        w = window_hashes(own[lo - at:hi - at], length)
                        keep = selected(w, run)
                        h.append(_signed(w[keep]))
                        p.append(keep + lo)
                hs.append(np.concatenate(h))
                ps.append(np.concatenate(p))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(hs, pa.int64()), _lists(ps, pa.int32())], names=["did", "th", "hs", "ps"])

    return each, "did long, th long, hs array<long>, ps array<int>"


def _places_to_spans(before: int, after: int):
    """(did, th, ps) -> (did, th, lo, hi): union of [p - before, p + after)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for ps in batch.column(2):
                at = np.unique(np.asarray(ps.values, np.int64))
                lo, hi = merged(at - before, at + after)
                lows.append(lo)
                highs.append(hi)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(lows, pa.int32()), _lists(highs, pa.int32())], names=["did", "th", "lo", "hi"])

    return each, "did long, th long, lo array<int>, hi array<int>"


def _kept_words():
    """(doc_id, text, lo, hi) -> (doc_id, n_words, n_removed, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, texts = [], [], []
            for text, lo, hi in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = (text.as_py() or "").encode("utf-8").split()
                n, kept = len(words), words
                if lo.is_valid:
                    gone = np.zeros(n, bool)
                    for a, b in zip(lo.as_py(), hi.as_py()):
                        gone[max(a, 0):b] = True
                    kept = [words[i] for i in np.flatnonzero(~gone)]
                total.append(n)
                removed.append(n - len(kept))
                texts.append(b" ".join(kept).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"])

    return each, "doc_id long, n_words long, n_removed long, text string"


def _survivors(scratch: Scratch, occurrences: DataFrame, name: str, later_only: bool = False) -> DataFrame:
    """Occurrences (did, th, h, p) of windows found in several documents, as
    (did, th, ps); with `later_only` those not in the first of them."""
    firsts = scratch.write(
        occurrences.groupBy("h").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last").select("h", "first"),
        f"repeated_{name}")
    found = occurrences.join(firsts, "h")
    if later_only:
        found = found.where("did > first")
    return found.groupBy("did", "th").agg(F.collect_set("p").alias("ps"))


def removed_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(did, th, lo, hi): sorted, disjoint word spans to remove of each document
    of `docs` (doc_id, text) that has any; keys as in `common.doc_order`.
    Rows with one id never remove each other's words."""
    if window < 2:
        raise ValueError("window must be at least 2")
    scratch = Scratch(docs.sparkSession, "substrings")
    sizes = levels(window)
    texts = keyed_texts(docs).select("did", "th", "text")
    base = scratch.write(texts.mapInArrow(*_texts_to_windows(sizes[0], window - sizes[0] + 1)), "base")
    full = base.where(F.col("n") >= window)
    firsts = scratch.write(full.groupBy("seq").agg(F.min("did").alias("first")), "firsts")
    marked = full.join(firsts, "seq")
    copies = scratch.write(
        marked.where("did > first").select("did", "th", F.array(F.lit(0)).alias("lo"), F.array(F.col("n").cast("int")).alias("hi")).distinct(),
        "copies")
    occurrences = scratch.write(
        marked.where("did = first").select("did", "th", F.explode(F.arrays_zip("hs", "ps")).alias("w"))
        .select("did", "th", F.col("w.hs").alias("h"), F.col("w.ps").alias("p")), "windows_0")
    scratch.drop("base", "firsts")
    regions = None
    for k, size in enumerate(sizes):
        last = size == window
        places = _survivors(scratch, occurrences, str(k), later_only=last)
        reach = (0, window) if last else (window - size, window)
        spans = scratch.write(places.mapInArrow(*_places_to_spans(*reach)), f"spans_{k}")
        scratch.drop(f"windows_{k}", f"repeated_{k}")
        if last or spans.isEmpty():
            return scratch.write(spans.unionByName(copies), "removed")
        size = sizes[k + 1]
        near = scratch.small(spans, f"spans_{k}")
        if regions is None:
            regions = scratch.write(texts.join(near, ["did", "th"]).mapInArrow(*_texts_to_regions()).distinct(), "regions")
        inside = regions.join(near, ["did", "th"]).select("did", "th", "at", "words", "lo", "hi")
        found = inside.mapInArrow(*_regions_to_windows(size, window - size + 1))
        occurrences = scratch.write(
            found.select("did", "th", F.explode(F.arrays_zip("hs", "ps")).alias("w"))
            .select("did", "th", F.col("w.hs").alias("h"), F.col("w.ps").alias("p")), f"windows_{k + 1}")


def remove_repeated(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row of `docs` (doc_id, text):
    the kept words joined by one space; a null text has no words."""
    spans = removed_spans(docs, window)
    scratch = Scratch(docs.sparkSession, "substring_spans")
    spans = scratch.small(scratch.write(spans, "spans"), "spans")
    joined = keyed_texts(docs).join(spans, ["did", "th"], "left").select(F.col("doc_id").cast("long"), "text", "lo", "hi")
    return joined.mapInArrow(*_kept_words())
