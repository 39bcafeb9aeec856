"""I-Match document fingerprints with randomised lexicons.

The lexicon holds the words whose inverse document frequency lies in a band:
their share of all documents is between `low` and `high`. A text keeps its
distinct lexicon words, sorted. Several randomised subsets of the lexicon are
drawn by the words' hashes; the words of the text in one subset are hashed in
order, and the fingerprint is the list of these hashes. One changed word then
spoils only the subsets it belongs to.

Subsets come in families of SUBSETS each, which take all, an eighth and a
sixty-fourth of the lexicon, so that long texts, too, have subsets with only
a few of their words. The likeness of two fingerprints is the best family's
share of equal subsets, e / (n + 1) with n the subsets in which either has a
word, or 1 if the fingerprints are equal. A text with fewer than `min_words`
lexicon words has a hash of the whole text as its fingerprint.

At most (mean distinct words of a text) / `low` words can be in the band, so
the lexicon is bounded whatever the corpus. It is a cuckoo hash table of whole
63-bit hashes, a constant of the expressions: every word of the lexicon lies at
one of its two places, and no other word is found there. So a text finds its
lexicon words without being taken apart into rows, and the texts are shuffled
once, to meet their successors. DataFrame expressions only.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.common import LOWEST, Scratch, keyed_texts, with_constant, words_of

#: Subsets of a family, and for each family the bits that tell its subsets
#: apart and how many of those bits' values are subsets (1 / 2**thin of them).
SUBSETS = 32
THIN = (0, 3, 6)
_TERM_BITS = 48


def terms(text: Column | str) -> Column:
    """Distinct words of a text as 63-bit hashes."""
    hashes = F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(w)))
    return F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1))


def lexicon(texts: DataFrame, low: float = 1e-3, high: float = 0.1) -> DataFrame:
    """(term) of every word in between `low` and `high` of the rows of `texts`
    (text), and in two of them at least."""
    if not 0 < low <= high <= 1:
        raise ValueError("0 < low <= high <= 1 is needed")
    n = texts.count()
    counts = texts.select(F.explode(terms("text")).alias("term")).groupBy("term").count()
    return counts.where(F.col("count").between(max(2, low * n), high * n)).select("term")


def _members(found: Column, family: int, thin: int, shift: int) -> Column:
    """subset << 48 | 48 bits of the word, for the words in a subset of the family."""

    def cell(term: Column) -> Column:
        return F.shiftrightunsigned(term, shift).bitwiseAND(F.lit((1 << (5 + thin)) - 1).cast("long"))

    own = F.filter(found, lambda t: cell(t) < SUBSETS) if thin else found
    return F.transform(own, lambda t: F.shiftleft(cell(t) + family * SUBSETS, _TERM_BITS).bitwiseOR(
        F.shiftrightunsigned(t, 63 - _TERM_BITS)))


def _subset_hashes(found: Column) -> Column:
    """Sorted lexicon words of a text -> sorted array of subset << 16 | hash."""
    members, shift = [], 0
    for family, thin in enumerate(THIN):
        members.append(_members(found, family, thin, shift))
        shift += 5 + thin
    ordered = F.sort_array(F.concat(*members))
    entry = lambda s: F.array(F.shiftleft(s["subset"], 16).bitwiseOR(s["hash"].bitwiseAND(F.lit(0xFFFF).cast("long"))))
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(-1).cast("long").alias("subset"), F.lit(0).cast("long").alias("hash"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        subset = F.shiftrightunsigned(x, _TERM_BITS)
        same = s["subset"] == subset
        return F.struct(
            subset.alias("subset"), F.xxhash64(F.when(same, s["hash"]).otherwise(F.lit(0).cast("long")), x).alias("hash"),
            F.when(same | (s["subset"] < 0), s["out"]).otherwise(F.concat(s["out"], entry(s))).alias("out"))

    return F.aggregate(ordered, start, step, lambda s: F.when(s["subset"] < 0, none).otherwise(F.concat(s["out"], entry(s))))


def likeness(a: str, b: str, same: Column) -> Column:
    """Likeness of two lists of subset hashes (null or empty: no lexicon words);
    `same` says that the fingerprints are equal."""
    best = F.lit(0.0)
    none = F.array().cast("array<bigint>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    for family in range(len(THIN)):
        lo, hi = family * SUBSETS << 16, (family + 1) * SUBSETS << 16
        u, v = (F.filter(z, lambda e: (e >= lo) & (e < hi)) for z in (x, y))
        equal = F.size(F.array_intersect(u, v))
        shared = F.array_intersect(F.transform(u, lambda e: F.shiftright(e, 16)), F.transform(v, lambda e: F.shiftright(e, 16)))
        either = F.size(u) + F.size(v) - F.size(shared)
        best = F.greatest(best, equal / (either + 1.0))
    return F.when(same, F.lit(1.0)).otherwise(best)


def fingerprint_string(hashes: str, text: Column) -> Column:
    """A fingerprint as text: hexadecimal subset hashes, or `t` and a hash of the whole text."""
    return F.when(F.size(F.coalesce(hashes, F.array().cast("array<bigint>"))) > 0,
                  F.array_join(F.transform(hashes, lambda e: F.lower(F.lpad(F.hex(e), 6, "0"))), "")
                  ).otherwise(F.concat(F.lit("t"), F.lower(F.hex(text))))


#: Bytes of an entry of the table, and how far a hash is shifted for its other place.
_ENTRY, _OTHER = 8, 31


def packed(words: list[int]) -> bytes:
    """The cuckoo hash table of a lexicon of 63-bit hashes: a new word takes one
    of its two places and sends the word there, if any, to that one's other
    place. The table is doubled until all words lie in it. Empty entries are -1,
    which is no hash."""
    size = 16
    while size * 0.45 < len(words):
        size *= 2
    while (table := _placed(words, size)) is None:
        size *= 2
    return b"".join(w.to_bytes(_ENTRY, "big", signed=True) for w in table)


def _placed(words: list[int], size: int) -> list[int] | None:
    """`size` entries with every word, None if some find no place."""
    table, moves = [-1] * size, 64 + 8 * size.bit_length()
    for word in sorted(set(words)):
        at = word & (size - 1)
        if table[at] >= 0 > table[(word >> _OTHER) & (size - 1)]:
            at = (word >> _OTHER) & (size - 1)
        for _ in range(moves):
            word, table[at] = table[at], word
            if word < 0:
                break
            one, two = word & (size - 1), (word >> _OTHER) & (size - 1)
            at = two if at == one else one
        else:
            return None
    return table


def lexicon_words(found: Column, table: Column, size: int) -> Column:
    """The terms of an array that are in the packed lexicon of `size` bytes, sorted."""

    def at(place: Column) -> Column:
        spot = place.bitwiseAND(F.lit(size // _ENTRY - 1).cast("long")).cast("int")
        return F.substring(table, spot * _ENTRY + 1, F.lit(_ENTRY))

    def within(t: Column) -> Column:
        entry = F.to_binary(F.lpad(F.hex(t), 2 * _ENTRY, "0"), F.lit("hex"))
        return entry.isin(at(t), at(F.shiftright(t, _OTHER)))

    return F.sort_array(F.filter(found, within))


def fingerprint(text: Column, table: bytes, min_words: int = 4) -> Column:
    """The subset hashes of a text, empty for fewer than `min_words` lexicon words."""
    own = F.array(with_constant(table, lambda t: lexicon_words(terms(text), t, len(table))))
    hashes = F.transform(own, lambda found: F.when(
        F.size(found) >= min_words, _subset_hashes(found)).otherwise(F.array().cast("array<bigint>")))
    return F.get(hashes, F.lit(0))


MAX_RANGES = 1 << 16
#: Equal rows that are written from one row of the table of repeated rows.
COPIES = 1000


def _cuts(rows: DataFrame, n: int, rows_each: int) -> list[tuple[int, int]]:
    """First (did, th) of every range but the lowest. An id with the rows of
    several ranges is cut evenly over th, which is a hash."""
    parts = max(1, min(MAX_RANGES, n // rows_each))
    if parts == 1:
        return []
    found = rows.agg(F.percentile_approx("did", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0]
    return [(did, LOWEST + (k << 64) // m) for did, m in sorted(Counter(found or []).items()) for k in range(m)]


def with_ranges(docs: DataFrame, rows_each: int = 256) -> DataFrame:
    """(did, th, doc_id, text, times, part, guest) of every distinct row and how
    many times it is there, in ranges of about `rows_each` rows by id and text
    hash (more if that takes over MAX_RANGES ranges). Each range also holds, as
    a guest, the first row after it; the last range that of the first. So a
    row's successor is always in its own range."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranges")
    every = keyed_texts(docs)
    # rows that are there more than once: only their keys are counted for all rows
    counts = every.select("did", "th").groupBy("did", "th").agg(F.count("*").alias("times")).where("times > 1")
    again = scratch.small(scratch.write(counts, "again"), "again")
    first = every.join(again.drop("times"), ["did", "th"]).groupBy("did", "th").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    first = scratch.write(first.join(again, ["did", "th"]), "first")
    columns = ["doc_id", "did", "th", "text", "times"]
    once = every.join(again.drop("times"), ["did", "th"], "left_anti").withColumn("times", F.lit(1).cast("long"))
    rows = once.select(columns).unionByName(first.select(columns))
    cuts = _cuts(every, docs.count(), rows_each)
    part = F.lit(0)
    if cuts:
        dids, ths = (F.split(F.lit(",".join(str(c[k]) for c in cuts)), ",").cast("array<bigint>") for k in (0, 1))
        steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]

        def from_cut(k: Column) -> Column:
            did = F.get(dids, k)
            return (did < F.col("did")) | ((did == F.col("did")) & (F.get(ths, k) <= F.col("th")))

        part = F.aggregate(
            F.array(*map(F.lit, steps)), F.lit(0),
            lambda at, s: F.when((at + s <= len(cuts)) & from_cut(at + s - 1), at + s).otherwise(at))
    own = rows.withColumn("part", part)
    firsts = sorted(own.groupBy("part").agg(F.min(F.struct("did", "th")).alias("f")).select("part", "f.did", "f.th").collect())
    if not firsts:
        return own.withColumn("guest", F.lit(0))
    guests = [(f["did"], f["th"], firsts[k - 1]["part"]) for k, f in enumerate(firsts)]
    small = F.broadcast(spark.createDataFrame(guests, "did long, th long, part int"))
    visiting = rows.join(small, ["did", "th"]).select(*rows.columns, "part", F.lit(1).alias("guest"))
    return own.withColumn("guest", F.lit(0)).unionByName(visiting)


def edited_fingerprints(docs: DataFrame, low: float = 1e-3, high: float = 0.1) -> DataFrame:
    """Fingerprints of all texts of `docs` (doc_id, text) and of their edited
    texts, whose last quarter of code points gives way to the beginning of the
    next document's.

    (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next) for every row; a null text is an empty one, rows with one id
    follow each other by the hash of their text, a single row is its own next.
    """
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    table = packed([r["term"] for r in lexicon(own, low, high).toLocalIterator()])
    line = W.partitionBy("part").orderBy("guest", "did", "th")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")

    def edit(rows: DataFrame) -> DataFrame:
        edited = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut)))
        marked = edited.withColumn("a", fingerprint(F.col("text"), table)).withColumn("b", fingerprint(F.col("edited"), table))
        return marked.withColumn("fingerprint", fingerprint_string("a", F.xxhash64("text"))).withColumn(
            "edited_fingerprint", fingerprint_string("b", F.xxhash64("edited")))

    ranged = with_ranges(docs)
    rows = edit(ranged.withColumn("next", F.coalesce(F.lead("text").over(line), F.lit(""))))
    after = rows.withColumn("na", F.lead("a").over(line)).withColumn("next_fingerprint", F.lead("fingerprint").over(line)).where("guest = 0")
    # all but the last of equal rows are followed by their own text
    more = Scratch(docs.sparkSession, "more").write(ranged.where("times > 1 AND guest = 0").select("doc_id", "text", "times"), "rows")
    more = more.withColumn("from", F.explode(F.sequence(F.lit(2).cast("long"), "times", F.lit(COPIES).cast("long"))))
    more = more.repartition(F.xxhash64("text"), "from")             # a task makes COPIES of a row at a time
    equal = edit(more.withColumn("next", F.col("text"))).withColumn("na", F.col("a")).withColumn("next_fingerprint", F.col("fingerprint"))
    equal = equal.withColumn("copy", F.explode(F.sequence("from", F.least("times", F.col("from") + COPIES - 1))))
    columns = ["doc_id", "text", "edited", "a", "b", "na", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    return after.select(columns).unionByName(equal.select(columns)).select(
        "doc_id", n.cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
        likeness("a", "b", F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
        likeness("a", "na", F.col("fingerprint") == F.col("next_fingerprint")).alias("near_next"))
