"""Line dedup by an exact set-similarity join.

A line is the set of its words; lines of fewer than `min_words` different words
(by default those without words) are left alone. A line goes if an earlier line of the corpus (by
document order, then line number) has a Jaccard similarity of `threshold` or
more; judged on the input, so a removed line still removes later ones.

1. Counts of all words give each frequent word a rarity, kept in a table of
   fixed size by hash. Any total order is correct, rarity makes prefixes rare.
2. Lines with equal sets collapse to their earliest line before any join.
3. Prefix filter: of n words in order of rarity, two similar sets share one of
   the first n - ceil(t*n) + 1. Length and positional filters bound the
   overlap that a shared prefix word still allows, and a 128-bit map of
   the words bounds it from above once more (words of one set whose bit is not set
   in the other are surely missing there), all within the join.
4. Two passes. First each line meets only the earliest document that holds
   one of its six rarest words; in a dense group this settles almost all
   lines with a candidate or two each. Then the lines not settled
   meet all earlier lines with a common prefix word. So a large group of near
   copies never yields all its pairs, and no candidate of an unsettled line is
   dropped.
5. Candidates are verified on 64-bit hashes of their words: each line against its
   earliest partner, and where that fails against all of them.

Everything is DataFrame expressions; hot prefix words are split by adaptive
execution, since both sides of the joins are read from written tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.common import LOWEST, SPACES, Scratch, doc_order, keyed_texts, unused, with_constant, words_of

BUCKETS = 1 << 20
#: Words of at least this share of all words are told apart by frequency; the
#: others count as equally rare.
FREQUENT = 3e-7
#: Number of the rarest words looked at in the first pass: enough that edits of
#: a copy, which are its rarest words, leave some it shares. Does not change the
#: result, the second pass covers whatever the first leaves.
FIRST = 6
KEY = ["did", "th", "line"]


def _short(h: Column) -> Column:
    """The upper half of a word's hash: enough to count by."""
    return F.shiftright(h, 32).cast("int")


def _bucket(short: Column) -> Column:
    return short.bitwiseAND(F.lit(BUCKETS - 1))


def _spaced(text: Column) -> Column:
    """`text` split at white space, with empty words: at single blanks where it
    holds no other white space, which needs no regular expression."""
    other = F.lit(False)
    for c in "\t\n\x0b\x0c\r":
        other = other | F.contains(text, F.lit(c))
    return F.when(other, F.split(text, SPACES)).otherwise(F.split(text, " "))


def _rarity_table(docs: DataFrame) -> bytes:
    """A byte for each hash bucket: twice the binary logarithm of the count of
    the bucket's most frequent word, 0 if that is below a share of FREQUENT of
    all words that occur twice. What comes to the driver is one row a bucket at
    most, whatever the corpus."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(_spaced(text)).alias("w")).select(_short(F.xxhash64("w")).alias("h"))
    counts = words.groupBy("h").count().where("count > 1")
    tops = counts.groupBy(_bucket(F.col("h")).alias("b")).agg(F.max("count").alias("n"), F.sum("count").alias("all"))
    rows = tops.withColumn("total", F.sum("all").over(W.partitionBy(F.lit(1)))).where(F.col("n") >= F.col("total") * FREQUENT)
    table = bytearray(BUCKETS)
    for bucket, n in rows.select("b", "n").toLocalIterator():     # never all rows at once
        table[bucket] = min(127, int(2 * math.log2(n)))
    return bytes(table)


def text_lines(docs: DataFrame) -> DataFrame:
    """(did, th, line, s): the lines of every text, numbered from 0."""
    return keyed_texts(docs).select("did", "th", F.posexplode(F.split("text", "\n")).alias("line", "s"))


def _min_overlap(na: Column, nb: Column, t: float) -> Column:
    return F.ceil(F.lit(t) / (1 + t) * (na + nb) - F.lit(1e-9))


def _bitmap(codes: Column) -> list[Column]:
    """128 bits, one by the low bits of each code, as two longs."""
    low = lambda x, bits: x.bitwiseAND(F.lit(bits).cast("long"))
    # the seventh bit of a code says in which half its bit is set, 0 in the other
    half = lambda one: F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(
        F.call_function("shiftleft", one(low(F.shiftright(x, 6), 1)), low(x, 63).cast("int"))))
    return [half(lambda b: b.bitwiseXOR(F.lit(1).cast("long"))).alias("m0"), half(lambda b: b).alias("m1")]


def _prefix_tokens(sets: DataFrame) -> DataFrame:
    """(token, h, did, m0, m1, meta, j) of every prefix word of every set. meta is
    the set's size and, in its lowest bit, whether earlier matches are sought
    (column `open`). No key is null; without saying so the optimizer would put
    a filter of its own under each side of a join of the tokens with
    themselves, and shuffle them twice."""
    known = sets.where("h IS NOT NULL AND did IS NOT NULL AND n IS NOT NULL")
    meta = F.shiftleft(F.col("n").cast("long"), 1) + F.col("open").cast("int")
    return known.select("h", "did", "m0", "m1", meta.alias("meta"), F.posexplode("prefix").alias("j", "token"))


def _candidates(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(a, b) set hashes of pairs that share a prefix word and pass the length,
    positional and bitmap filters; b is open and a in no later document. Both
    sides use the same columns, so a join of one table with itself is one
    shuffle."""
    a, b = left.alias("a"), right.alias("b")
    na, nb = F.shiftright("a.meta", 1), F.shiftright("b.meta", 1)
    until = F.when(F.col("b.meta").bitwiseAND(F.lit(1).cast("long")) == 1, F.col("b.did")).otherwise(F.lit(LOWEST))
    need = _min_overlap(na, nb, t)
    bound = F.least(na - F.col("a.j"), nb - F.col("b.j"))   # the shared word and what may follow it
    lacks = lambda x, y, m: F.bit_count(F.col(f"{x}.{m}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{m}"))))
    missing = lambda x, y: lacks(x, y, "m0") + lacks(x, y, "m1")
    return a.join(b, F.col("a.token") == F.col("b.token")).where(
        (F.col("a.did") <= until) & (F.col("a.h") != F.col("b.h"))
        & (F.least(na, nb) >= F.ceil(F.lit(t) * F.greatest(na, nb) - F.lit(1e-9))) & (bound >= need)
        & (na - missing("a", "b") >= need) & (nb - missing("b", "a") >= need)).select(F.col("a.h").alias("a"), F.col("b.h").alias("b"))


def _verified(scratch: Scratch, docs: DataFrame, sets: DataFrame, pairs: DataFrame, t: float, name: str) -> DataFrame:
    """(h) of the later set of every candidate pair that is similar enough."""
    pairs = scratch.write(pairs.distinct(), f"pairs_{name}")
    scratch.release()
    ends = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h")))
    ends = scratch.write(ends.distinct(), f"ends_{name}")
    info = scratch.write(sets.select("h", *KEY).join(scratch.small(ends, f"ends_{name}"), "h"), f"info_{name}")
    side = lambda s: info.select(*[F.col(c).alias(f"{c}_{s}") for c in info.columns])
    both = pairs.join(side("a"), F.col("a") == F.col("h_a")).join(side("b"), F.col("b") == F.col("h_b"))
    earlier = F.struct(*[F.col(f"{c}_a") for c in KEY]) < F.struct(*[F.col(f"{c}_b") for c in KEY])
    close = scratch.write(both.where(earlier).select("a", "b", *[f"{c}_{s}" for s in "ab" for c in KEY]), f"close_{name}")
    # the words of those lines only, as hashes, which are smaller than the words to
    # shuffle: whole documents are matched first, lines next
    wanted = close.select(*[F.col(f"{c}_a").alias(c) for c in KEY]).unionByName(close.select(*[F.col(f"{c}_b").alias(c) for c in KEY]))
    wanted = scratch.write(wanted.groupBy("did", "th").agg(F.collect_set("line").alias("wanted")), f"wanted_{name}")
    found = keyed_texts(docs).join(scratch.small(wanted, f"wanted_{name}"), ["did", "th"]).select(
        "did", "th", "wanted", F.posexplode(F.split("text", "\n")).alias("line", "s")).where(F.array_contains("wanted", F.col("line")))
    words = scratch.write(found.select(*KEY, F.array_distinct(F.transform(words_of("s"), lambda w: F.xxhash64(w))).alias("words")), f"words_{name}")
    scratch.drop(*[f"{part}_{name}" for part in ("pairs", "ends", "info", "wanted")])

    def similar(rows: DataFrame, part: str) -> DataFrame:
        side = lambda s: words.select(*[F.col(c).alias(f"{c}_{s}") for c in KEY], F.col("words").alias(f"words_{s}"))
        full = rows.join(side("a"), [f"{c}_a" for c in KEY]).join(side("b"), [f"{c}_b" for c in KEY])
        common = F.size(F.array_intersect("words_a", "words_b"))
        union = F.size("words_a") + F.size("words_b") - common
        return scratch.write(full.where(common >= F.lit(t) * union - F.lit(1e-9)).select(F.col("b").alias("h")).distinct(), f"similar_{name}_{part}")

    # one earlier line settles a line: first each against its earliest partner, then
    # whatever is left against all of its partners
    keys = [f"{c}_{s}" for s in "ab" for c in KEY]
    one = similar(close.groupBy("b").agg(F.min(F.struct(*keys)).alias("k")).select("b", "k.*"), "one")
    left = scratch.write(close.join(scratch.small(one, f"similar_{name}_one").withColumnRenamed("h", "b"), "b", "left_anti").select("b", *keys), f"left_{name}")
    out = scratch.write(one.unionByName(similar(left, "all")), f"similar_{name}")
    scratch.drop(*[f"{part}_{name}" for part in ("close", "words", "left")], f"similar_{name}_one", f"similar_{name}_all")
    return out


def later_lines(docs: DataFrame, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """(did, th, line) of every line of `docs` (doc_id, text) to remove.

    did and th are the document's id (lowest long if null) and text hash, see
    `common.doc_order`; rows with equal id and text are told apart by
    `remove_later_lines` only, here they are the first of them. Ties cannot
    occur: a line's place is unique.
    """
    return _later(docs, threshold, min_words)[0]


def _later(docs: DataFrame, threshold: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """`later_lines`, and (did, th) of documents that are there more than once."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")

    def codes(rarity: Column) -> Column:
        def code(h: Column) -> Column:
            # rarity in the high bits, 56 bits of the word's hash below: ascending order is order of rarity
            rare = F.ascii(F.substring(rarity, _bucket(_short(h)) + 1, 1).cast("string")).cast("long")
            return F.shiftleft(rare, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

        return F.transform("d", code)

    # distinct and sort stay outside the lambdas, where they are compiled for longs
    words = F.array_remove(_spaced(F.col("s")), "")
    hashed = text_lines(docs).select(*KEY, F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))).alias("d"))
    coded = hashed.select(*KEY, F.size("d").alias("n"), F.sort_array(with_constant(_rarity_table(docs), codes)).alias("codes"))
    n = F.col("n")
    prefix = F.slice("codes", 1, (n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)) + 1).cast("int"))
    # short lines are filtered on the written table: a filter here would code every line twice
    every = scratch.write(
        coded.select(*KEY, F.xxhash64("codes").alias("h"), "n", F.transform(prefix, lambda x: F.hash(x)).alias("prefix"),
                     *_bitmap(F.col("codes"))), "lines")
    repeated = every.where("line = 0").groupBy("did", "th").agg(F.count("*").alias("k")).where("k > 1").select("did", "th")
    repeated = scratch.write(repeated, "repeated")
    lines = every.where(F.col("n") >= min_words)
    # equal sets: their earliest line stands for all; every other attribute follows from the set
    first = F.min(F.struct(*KEY, "n", "prefix", "m0", "m1")).alias("f")
    sets = scratch.write(lines.groupBy("h").agg(first).select("h", "f.*"), "sets")
    scratch.release()

    rare = _prefix_tokens(sets.withColumn("open", F.lit(True))).where(F.col("j") < FIRST)
    earliest = scratch.write(
        rare.groupBy("token").agg(F.min("did").alias("of"), F.count("*").alias("k")).where("k > 1").select(F.col("token").alias("t"), "of"), "earliest")
    # no document is before the earliest; as an inequality it leaves the word as the
    # only join key, so that one shuffle of `rare` serves both joins. A row of two
    # numbers takes up to 16 times its encoded size in a hash table
    pivots = rare.join(scratch.small(earliest, "earliest", 16), (F.col("token") == F.col("t")) & (F.col("did") <= F.col("of"))).drop("t", "of")
    settled = _verified(scratch, docs, sets, _candidates(pivots, rare, threshold), threshold, "first")
    scratch.drop("earliest")

    marked = sets.select("h", "did", "n", "m0", "m1", "prefix").join(
        scratch.small(settled, "similar_first").withColumn("settled", F.lit(True)), "h", "left")
    tokens = _prefix_tokens(marked.withColumn("open", F.col("settled").isNull()))
    rest = _verified(scratch, docs, sets, _candidates(tokens, tokens, threshold), threshold, "rest")

    similar = settled.unionByName(rest).distinct().withColumn("similar", F.lit(True))
    verdict = sets.select("h", F.struct(*KEY).alias("first")).join(similar, "h", "left")
    out = lines.select(*KEY, "h").join(verdict, "h").where(
        F.col("similar").isNotNull() | (F.struct(*KEY) > F.col("first")))
    out = scratch.write(out.select(*KEY).distinct(), "later")
    scratch.drop("lines", "sets")
    return out, scratch.small(repeated, "repeated")


def remove_later_lines(docs: DataFrame, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """`docs` (doc_id, text, any other columns) with the later lines taken out
    of the text; adds n_lines and n_removed, in place of columns of that name.
    A text with nothing removed is unchanged, a null text stays null with no
    lines; a text that loses all its lines becomes empty. Of rows with equal id
    and text (also of those without an id) one is the first; the others are
    later copies and lose all their lines of at least `min_words` words."""
    later, repeated = _later(docs, threshold, min_words)
    scratch = Scratch(docs.sparkSession, "line_lists")
    lists = scratch.write(later.groupBy("did", "th").agg(F.collect_set("line").alias("gone")), "lists")
    did, th, gone, copy, chosen = unused(docs, "lw_did", "lw_th", "lw_gone", "lw_copy", "lw_chosen")
    lists = scratch.small(lists.select(F.col("did").alias(did), F.col("th").alias(th), F.col("gone").alias(gone)), "lists")
    keyed = docs.withColumns(dict(zip((did, th), doc_order())))
    twice = repeated.select(F.col("did").alias(did), F.col("th").alias(th))
    once = keyed.join(twice, [did, th], "left_anti").withColumn(copy, F.lit(False))
    # rows that are there more than once are written with a number, the lowest is the first
    again = scratch.write(keyed.join(twice, [did, th], "left_semi").withColumn(copy, F.monotonically_increasing_id()), "again")
    first = scratch.write(again.groupBy(did, th).agg(F.min(copy).alias("lw_first")), "first")
    first = scratch.small(first.select(F.col("lw_first").alias(copy)), "first").withColumn(chosen, F.lit(True))
    marked = again.join(first, copy, "left").withColumn(copy, F.col(chosen).isNull()).select(*once.columns)
    parts = F.split("text", "\n")
    words = lambda s: F.size(F.array_distinct(words_of(s)))
    kept = F.when(F.col(copy), F.filter(parts, lambda s: words(s) < min_words)).otherwise(
        F.filter(parts, lambda _, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False))))
    whole = F.col(gone).isNull() & ~F.col(copy)
    removed = F.when(F.col(copy), F.size(parts) - F.size(kept)).otherwise(F.coalesce(F.size(gone), F.lit(0)))
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return once.unionAll(marked).join(lists, [did, th], "left").select(
        *own, F.when(whole | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(removed).cast("long").alias("n_removed"))
