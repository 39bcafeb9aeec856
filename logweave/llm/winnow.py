"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters of the lower-cased
text. A window is `window` consecutive words of a benchmark item (an item with
fewer words is one window by itself). Every document word that lies inside any
occurrence of any window is a hit.

1. Winnowing: each text keeps the smallest k-gram hash of every run of w
   consecutive k-grams, w = window - k + 1. Two texts that share `window`
   consecutive words share such a run, hence a fingerprint: no shared span of
   that length is missed, whatever its place.
2. Join of document and benchmark fingerprints. The benchmark side is sent to
   every task if its written size allows, else both sides are shuffled.
   Items of fewer than `window` words join on the hash of all their words.
3. Extension: the documents of matching fingerprints are read again and their
   windows joined with the items' windows on the words themselves, so a hit is
   exact, not a hash match.

DataFrame expressions only. A document's own hits are gathered per document
(bounded by its length times the items that share a window); nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, ascii_lower, doc_order, keyed_texts, unused

#: What separates words: ASCII other than digits and lower-case letters.
SEPARATORS = r"[\x00-/:-`{-\x7f]+"


def item_words(text: Column | str) -> Column:
    """Words of a text, lower-cased in ASCII; an empty array for a null text."""
    lowered = ascii_lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _grams(n: int, words: str) -> Column:
    """Hashes of the n-grams of an array of words, in order."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    grams = F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<bigint>"))


def fingerprints(texts: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """`texts` (words array<string>, ids...) -> ids and fp, one row for each
    different winnowed fingerprint; none for fewer than `window` words."""
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    w = window - k + 1
    ids = [c for c in texts.columns if c != "words"]
    hashed = texts.where(F.size("words") >= window).select(*ids, F.transform("words", lambda x: F.xxhash64(x)).alias("lw_h"))
    grams = hashed.select(*ids, _grams(k, "lw_h").alias("lw_g"))
    if w == 1:
        minima = F.col("lw_g")
    else:
        minima = F.transform(F.sequence(F.lit(1), F.size("lw_g") - (w - 1)),
                             lambda i: F.least(*[F.element_at("lw_g", i + j) for j in range(w)]))
    return grams.select(*ids, F.explode(F.array_distinct(minima)).alias("fp"))


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """ids, s (start from 0) and gram (words joined by a space) of all runs of
    `length` words."""
    ids = [c for c in texts.columns if c != "words"]
    at = F.sequence(F.lit(0), F.size("words") - length)
    return texts.where(F.size("words") >= length).select(*ids, "words", F.explode(at).alias("s")).select(
        *ids, "s", F.array_join(F.slice("words", F.col("s") + 1, length), " ").alias("gram"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(did, th, n_hit, items): documents of `docs` (doc_id, text) with a hit,
    the number of words hit and the sorted distinct ids, as text, of the items
    of `benchmark` (item_id, text) that have an occurring window.

    did and th are the document's key (`common.doc_order`): rows with equal id
    and text are one. Items without words never match; an item without an id
    counts for hits but is not listed.
    """
    scratch = Scratch(docs.sparkSession, "winnow")
    items = scratch.write(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), item_words("text").alias("words"))
        .where(F.size("words") > 0), "items")
    texts = docs.select(*doc_order(), item_words("text").alias("words"))

    # candidates: document keys with a window length to be extended at
    long_fps = scratch.write(fingerprints(items, window, k).select("fp").distinct(), "fps")
    found = fingerprints(texts, window, k).join(scratch.small(long_fps, "fps"), "fp").select("did", "th", F.lit(window).alias("length"))
    lengths = sorted(r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().collect())
    for n in lengths:   # at most window - 1 of them
        grams = items.where(F.size("words") == n).select(_grams(n, "words")[0].alias("fp")).distinct()
        grams = scratch.write(grams, f"fps_{n}")
        short = texts.select("did", "th", F.explode(F.array_distinct(_grams(n, "words"))).alias("fp"))
        found = found.unionByName(short.join(scratch.small(grams, f"fps_{n}"), "fp").select("did", "th", F.lit(n).alias("length")))
    found = scratch.write(found.distinct(), "found")

    # extension on the words of the candidate documents
    starts = None
    for n in [window, *lengths]:
        own = items.where(F.size("words") >= window) if n == window else items.where(F.size("words") == n)
        grams = scratch.write(_windows(own, n).select("item_id", "gram").distinct(), f"grams_{n}")
        keys = scratch.write(found.where(F.col("length") == n).select("did", "th"), f"keys_{n}")
        again = keyed_texts(docs).join(scratch.small(keys, f"keys_{n}"), ["did", "th"])
        match = _windows(again.select("did", "th", item_words("text").alias("words")), n).join(scratch.small(grams, f"grams_{n}"), "gram").select(
            "did", "th", "item_id", F.col("s").cast("int").alias("s"), F.lit(n).alias("length"))
        starts = match if starts is None else starts.unionByName(match)
    runs = F.collect_set(F.struct("s", "length"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(runs, lambda x: F.sequence(x["s"], x["s"] + x["length"] - 1)))))
    return scratch.write(
        starts.groupBy("did", "th").agg(covered.cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row of `docs`; a null text has
    no words, an empty benchmark hits nothing."""
    found = hits(docs, benchmark, window, k)
    sizes = docs.select("doc_id", *doc_order(), F.size(item_words("text")).cast("long").alias("n_words"))
    return sizes.join(found, ["did", "th"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of `docs` (doc_id, text, any other columns) without a hit."""
    names = unused(docs, "lw_did", "lw_th")
    found = hits(docs, benchmark, window, k).select(F.col("did").alias(names[0]), F.col("th").alias(names[1]))
    keyed = docs.withColumns(dict(zip(names, doc_order())))
    return keyed.join(found, names, "left_anti").select(*docs.columns)
