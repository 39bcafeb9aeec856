"""Spelling variant grouping by a trie-node pair dictionary.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. The prefixes of all words are the nodes of a trie, their suffixes
the nodes of a trie of the reversed words; every node has a number. A word then
enters a dictionary of integer pairs (prefix node, suffix node):

* as `skip` at every position i, under the prefix before i and the suffix after
  i, that is without its code point i;
* as `split` at every position i, under the prefix before i and the suffix from
  i on, that is with room for one more code point.

Equal pairs are equal strings, so the neighbours are exact: two skips of one
pair are words that differ in that place, a skip and a split of one pair are a
word and the same word with one code point more. Where equal code points stand
together only the first of them is skipped for that second kind, so no pair of
words is found twice. A pair holds one word for each code point of the alphabet
at most in each role, so no group grows with the corpus.

A node that only one word passes through can join nothing; it gets no number.
Nodes of up to two code points, which many words share, are numbered by rule
from those code points, so only longer prefixes and suffixes are shuffled.

Null texts have no words; an empty table gives an empty result; a repeated row
counts its words again; a row without an id hashes an empty id. Words are
compared by code points. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, ascii_lower

#: Letters of a word, as a regular expression class.
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, drop_every: int | None = 199) -> DataFrame:
    """(word, n) of the lower-cased letter runs of `docs` (doc_id, text) with
    at least `min_length` code points and `min_count` occurrences.

    With `drop_every` m, a run of a document whose h = crc32("<doc_id>:<run>")
    is a multiple of m loses its code point h % length, which plants variants.
    """
    # a shorter run cannot become a word, so it is not even taken out of the text
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    words = words.select("d", ascii_lower("run").alias("word"))
    if drop_every:
        hashed = words.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "word")))
        at = F.expr("cast(h % length(word) as int)")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = hashed.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("word")).alias("word"))
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def _by_rule(part: Column) -> Column:
    """Number of a node of at most two code points: negative, one for each."""
    first = F.when(F.length(part) > 0, F.ascii(part)).otherwise(0).cast("long")
    second = F.when(F.length(part) > 1, F.ascii(F.substring(part, 2, 1))).otherwise(0).cast("long")
    return -(F.lit(1) + first + F.shiftleft(second, 21))


def _numbered(scratch: Scratch, rows: DataFrame, words: DataFrame, text: str, number: str, of: Column) -> DataFrame:
    """`rows` with the node of column `text` as `number`; rows of nodes of one
    word drop out. `of` is the array of a word's prefixes (or suffixes)."""
    found = words.select(F.explode(of).alias(text)).where(F.length(text) > 2)
    nodes = scratch.write(
        found.groupBy(text).agg(F.count("*").alias("c")).where("c > 1").select(text, F.monotonically_increasing_id().alias(number)), f"nodes_{number}")
    short = rows.where(F.length(text) <= 2).withColumn(number, _by_rule(F.col(text)))
    return short.drop(text).unionByName(rows.where(F.length(text) > 2).join(nodes, text).drop(text))


def dictionary(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(p, s, skip, first, word, n): the pairs of every word of `words` (word,
    n), a written table. `skip` tells skips from splits, `first` marks skips
    of the first of equal code points."""
    size = F.length("word")
    heads = F.transform(F.sequence(F.lit(0), size), lambda i: F.substring(F.col("word"), F.lit(1), i))
    tails = F.transform(F.sequence(F.lit(0), size), lambda i: F.substring(F.col("word"), i + 1, F.length("word")))
    splits = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i")).withColumn("skip", F.lit(False))
    skips = words.select("word", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("i")).withColumn("skip", F.lit(True))
    at = lambda k: F.substring(F.col("word"), F.col("i") + k, F.lit(1))
    rows = splits.unionByName(skips).select(
        "word", "n", "skip", (F.col("skip") & ((F.col("i") == 0) | (at(1) != at(0)))).alias("first"),
        F.substring(F.col("word"), F.lit(1), F.col("i")).alias("head"),
        F.substring(F.col("word"), F.col("i") + 1 + F.col("skip").cast("int"), F.length("word")).alias("tail"))
    rows = _numbered(scratch, rows, words, "head", "p", heads)
    return scratch.write(_numbered(scratch, rows, words, "tail", "s", tails), "pairs")


def near_words(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of near words of `words`
    (word, n; distinct words, none null or empty), once."""
    pairs = dictionary(scratch, words)
    skips = pairs.where("skip")
    others = pairs.select("p", "s", F.col("skip").alias("other_skip"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    joined = skips.join(others, ["p", "s"]).where(
        (F.col("other_skip") & (F.col("word") != F.col("near"))) | (~F.col("other_skip") & F.col("first")))
    # skips meet each other from both sides; a skip and a split meet once
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    forth = F.struct("word", "n", "near", "near_n")
    ways = F.when(F.col("other_skip"), F.array(forth)).otherwise(F.array(forth, back))
    return joined.select(F.explode(ways).alias("w")).select("w.*")


def variants(docs_words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of `docs_words`
    (word, n; distinct words; null and empty ones drop out).

    form is the near word of largest n (ties: smallest in code-point order) if
    that n is at least `ratio` times the word's, else null; root follows forms
    to the last, or is the word itself.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    scratch = Scratch(docs_words.sparkSession, "spelling")
    words = scratch.write(docs_words.select("word", "n").where("word <> ''"), "words")
    best = near_words(scratch, words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near"))).alias("best"))
    strong = -F.col("best.neg") >= ratio * F.col("n")
    known = scratch.write(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.neg")).alias("form_n")), "forms")
    # a form has `ratio` times the count, so chains are short; each round doubles what has been followed
    most = known.agg(F.max("n")).first()[0] or 1
    steps = scratch.write(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots_0")
    for k in range(1, 1 + max(0, math.ceil(math.log2(max(1.0, math.log(most, ratio)))))):
        on = steps.select(F.col("word").alias("via"), F.col("root").alias("next"))
        steps = scratch.write(
            steps.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root")), f"roots_{k}")
    out = known.join(steps, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
