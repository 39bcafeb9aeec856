"""Language-model scoring with Katz backoff.

Counts of words, word pairs and triples over all training documents, kept in a
table partitioned by order. Counts up to K are discounted by Good-Turing; the
mass set free, and that of n-grams not kept, goes to the next lower order by a
backoff weight that makes every context's distribution sum to exactly 1:

    P(w | u v) = d c(u v w) / c(u v)      if the triple is kept, else
                 a(u v) P(w | v),         and likewise from pairs to words;
    P(w)       = d c(w) / N               for a word seen in training, and
    P(unseen)  = 1 - sum of P(w)          for any other (one class).

All words, pairs and triples are kept, with exact counts, however rare. A pair
or triple is a row (a, b): the key of its context and the key of the n-gram one
order down that it ends with. Its own key is Spark's xxhash64 of the two, which
tasks compute alike. Backoff weights are sums grouped by context; scoring looks
triples up by a join, what misses goes on to pairs, then to words.

Texts are cut into token hashes once, in a written table. Pairs are counted and
weighted in some rounds dealt by their first word, triples counted, weighted
and looked up in as many by their middle word, which their context and the pair
they end with hold: each round meets its own part of the tables only, resolves
its tokens down to the words, and its files go before the next one starts. The
words of share `word_share`, at most 1 / word_share of them, are held in memory
for the base score; rarer ones are looked up by a join on the word table.

A text is its words, ASCII-lower-cased, and one end token. Its score is the sum
of the base-10 logarithms of its tokens' probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from logweave.llm.bytewords import LOWER, NOT_SPACE, mix, slices, word_counts, word_hashes, word_spans
from logweave.llm.common import Scratch

#: Counts up to K are discounted.
K = 5
#: Hash of the end token; words hash to other values but for a chance of 2**-64.
END = np.uint64(1)
#: Rounds of the pairs and of the triples; each needs about its share of the disk that all would.
ROUNDS = 6
#: Keys gathered in a task before they are counted and handed on.
BUFFER = 1 << 22


def tokens(part) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a slice, text after text, each closed by END;
    and the place of each text's first token (one more at the end)."""
    data = LOWER[part.data]
    starts, ends = word_spans(part, NOT_SPACE)
    count = word_counts(part, starts)
    hashes = word_hashes(data, starts, ends)
    return np.insert(hashes, count[1:], END), count + np.arange(len(count))


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _texts(lists: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, tokens, places of the texts' first tokens and the end) of the
    texts lo to hi of a column of token lists, or of their bytes, some half
    million tokens at once."""
    if pa.types.is_binary(lists.type):
        at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1].astype(np.int64)
        at, values = (at - at[0]) // 8, np.frombuffer(lists.buffers()[2], np.uint8)[at[0]:at[-1]].view(np.uint64)
    else:
        at = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy().view(np.uint64)
    lo = 0
    while lo < len(lists):
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 19), "right")) - 1), len(lists))
        yield lo, hi, values[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def _round(words: np.ndarray, rounds: int) -> np.ndarray:
    """The round of the pairs with these first words and of the triples with
    these middle words, as F.pmod of the word's hash."""
    return words.view(np.int64) % rounds


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _xxhash64(values: np.ndarray, seed) -> np.ndarray:
    """Spark's xxhash64 of longs."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = (seed + _P5 + np.uint64(8)) ^ (turn(values * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def gram_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of the n-grams (a, b), as F.xxhash64("a", "b")."""
    return _xxhash64(b, _xxhash64(a, np.full(1, 42, np.uint64)))


def _pairs(k: int, rounds: int):
    """The pairs of round k."""

    def of(toks: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.ones(len(toks), bool)
        inner[heads] = False
        at = np.flatnonzero(inner)
        at = at[_round(toks[at - 1], rounds) == k]
        return toks[at - 1], toks[at]

    return of


def _triples(k: int, rounds: int):
    """The triples of round k."""

    def of(toks: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.ones(len(toks), bool)
        inner[heads] = False
        at = np.flatnonzero(inner[1:] & inner[:-1]) + 1
        at = at[_round(toks[at - 1], rounds) == k]
        return gram_keys(toks[at - 2], toks[at - 1]), gram_keys(toks[at - 1], toks[at])

    return of


def _gram_counts(learned: DataFrame, grams_of) -> DataFrame:
    """(a, b, c) of all n-grams of `learned` (toks). Counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            _, at, n = np.unique(gram_keys(a, b), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array(n.astype(np.int64))], names=["a", "b", "c"])

        for batch in batches:
            for _, _, toks, heads in _texts(batch.column(0)):
                held.append(grams_of(toks, heads[:-1]))
                size += len(held[-1][0])
                if size >= BUFFER // 4:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return learned.select("toks").mapInArrow(run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def _word_counts(learned: DataFrame) -> DataFrame:
    """(key, c) of all tokens of `learned` (toks). Counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "c"])

        for batch in batches:
            for _, _, toks, _ in _texts(batch.column(0)):
                held.append(toks)
                size += len(toks)
                if size >= BUFFER:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return learned.select("toks").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(0)):
            toks, heads = tokens(part)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.array(toks.view(np.int64)))], names=["toks"])


def _factors(n: np.ndarray) -> np.ndarray | None:
    """Katz's factors of the counts 1 .. K from n[1 .. K + 1], if all are in (0, 1]."""
    if n[1:].min() <= 0:
        return None
    r = np.arange(1, K + 1)
    top = (K + 1) * n[K + 1] / n[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top)
    return d if np.all(np.isfinite(d)) and d.min() > 0 and d.max() <= 1 else None


def discounts(of_counts: dict[int, int]) -> np.ndarray:
    """Good-Turing factor for each count 0 .. K + 1 (counts above K: 1) from the
    numbers of n-grams seen 1 .. K + 1 times. Copied documents can make those
    numbers uneven; where they do not allow factors in (0, 1], a power law
    fitted to them takes their place, and without one nothing is discounted."""
    n = np.array([0.0] + [float(of_counts.get(r, 0)) for r in range(1, K + 2)])
    out = np.ones(K + 2)
    d = _factors(n)
    have = np.flatnonzero(n > 0)
    if d is None and len(have) > 1:
        slope, at = np.polyfit(np.log(have), np.log(n[have]), 1)
        d = _factors(np.concatenate([[0.0], np.exp(at + slope * np.log(np.arange(1, K + 2)))]))
    if d is not None:
        out[1:K + 1] = d
    return out


@dataclass
class Tables:
    """All words as contexts (key, back), all pairs (key, p, back, first: the
    round of their first word) by the round of their last word, and all triples
    (key, p) by round."""

    words: DataFrame
    pairs: list[DataFrame]
    triples: list[DataFrame]
    scratch: Scratch                # where they are written

    def all_pairs(self) -> DataFrame:
        return self.scratch.read("ngrams_2", "key long, p double, back double, first int")


def _factor(factors: np.ndarray, c: Column) -> Column:
    out = F.lit(float(factors[K + 1]))
    for r in range(1, K + 1):
        out = F.when(c == r, F.lit(float(factors[r]))).otherwise(out)
    return out


@dataclass
class Model:
    words: np.ndarray               # hashes of the words held in memory, sorted
    counts: np.ndarray              # their counts
    rare: np.ndarray                # factor of a word's count, 0 .. K + 1
    unseen: float                   # log10 P of the class of unseen words
    total: int
    distinct: int
    tables: Tables

    def word_log(self, c: Column) -> Column:
        """log10 P of a word of the word table by its count (null: unseen)."""
        return F.when(c > 0, F.log10(_word_share(self.rare, self.total, c))).otherwise(F.lit(self.unseen))


def _word_share(factors: np.ndarray, total: int, c: Column) -> Column:
    return _factor(factors, c) * c / F.lit(float(max(total, 1)))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", "c").toArrow()
    key, c = got.column("key").to_numpy(), got.column("c").to_numpy()
    return key, c


def _count_of_counts(df: DataFrame) -> dict[int, int]:
    return {r["c"]: r["n"] for r in df.where(F.col("c") <= K + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}


def word_factors(words: DataFrame, total: int) -> tuple[np.ndarray, float]:
    """The factor of each count of a word, and the probability of the unseen ones:
    the mass of the discounted counts that is left."""
    seen = _count_of_counts(words)
    rare = discounts(seen)
    left = sum(n * r * (1 - rare[r]) for r, n in seen.items() if r <= K) / max(total, 1)
    if left <= 0:       # no usable counts of counts: as much as one more token
        rare, left = rare * total / (total + 1), 1 / (total + 1)
    return rare, float(left)


def fit(scratch: Scratch, texts: DataFrame, word_share: float = 1e-6, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """Learn from all rows of `texts` (text); (model, word table (key, c))."""
    if not (0 < word_share <= 1 and rounds >= 1):
        raise ValueError("word_share must be above 0 and not above 1, rounds at least 1")
    learned = scratch.write(texts.select(F.col("text").cast("string")).mapInArrow(_token_lists, "toks array<long>"), "learned")
    words = scratch.write(_word_counts(learned), "ngrams_1/order=1").select("key", "c")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    key, c = _arrays(words.where(F.col("c") >= max(1.0, word_share * total)))
    by = np.argsort(key.view(np.uint64))

    rare, left = word_factors(words, total)
    tables = _tables(scratch, learned, words.withColumn("p", _word_share(rare, total, F.col("c"))), rounds)
    return Model(key.view(np.uint64)[by], c[by], rare, float(np.log10(left)), int(total), int(distinct), tables), words


def _weighted(scratch: Scratch, found: DataFrame, below: DataFrame, of: DataFrame, factors: np.ndarray, to: str) -> DataFrame:
    """(a, b, c, p) of all n-grams `found` (a, b, c). Their contexts `of` (key,
    c, any other columns) are written as table `to` with (total, back) added.

    below: (b, p) one order down. P is the discounted count by the context's. A
    backoff weight is what the n-grams of a context leave over what they leave
    of the lower order; a context whose n-grams leave nothing counts one token
    more, and one without n-grams has weight 1."""
    mass = _factor(factors, F.col("c")) * F.col("c")
    sums = found.join(below, "b").groupBy("a").agg(F.sum(mass).alias("held"), F.sum("p").alias("base"))
    total = F.when(F.col("held") > F.col("c") * (1 - 1e-9), F.col("held") + 1).otherwise(F.greatest("c", F.lit(1)))
    back = (1 - F.col("held") / F.col("total")) / F.greatest(1 - F.col("base"), F.lit(1e-12))
    before = of.join(sums.withColumnRenamed("a", "key"), "key", "left").withColumn("total", total.cast("double"))
    before = scratch.write(before.withColumn("back", F.coalesce(back, F.lit(1.0))).drop("held", "base"), to)
    scratch.release()
    totals = scratch.small(before.select(F.col("key").alias("a"), "total"), to)
    return found.join(totals, "a").select("a", "b", "c", (mass / F.col("total")).alias("p"))


def _counted(scratch: Scratch, learned: DataFrame, grams_of, name: str, rounds: int) -> tuple[list[DataFrame], np.ndarray]:
    """The n-grams (a, b, c) of each round, written, and the factors of all counts."""
    parts, of_counts = [], {}
    for k in range(rounds):
        parts.append(scratch.write(_gram_counts(learned, grams_of(k, rounds)), f"{name}/part={k}").select("a", "b", "c"))
        scratch.release()
        for c, n in _count_of_counts(parts[-1]).items():
            of_counts[c] = of_counts.get(c, 0) + n
    return parts, discounts(of_counts)


def _tables(scratch: Scratch, learned: DataFrame, words: DataFrame, rounds: int) -> Tables:
    """Count all pairs and triples of `learned` (toks) and drop it; words: (key, c, p)."""
    small = lambda df, name, *cols: scratch.small(df.select(*cols), name)
    of_round = lambda c, k: F.pmod(F.col(c), F.lit(rounds)) == k
    key, below = F.xxhash64("a", "b").alias("key"), (F.col("key").alias("b"), "p")
    parts, factors = _counted(scratch, learned, _pairs, "all_2", rounds)
    for k, found in enumerate(parts):
        weighted = _weighted(
            scratch, found, small(words, "ngrams_1", *below), small(words.where(of_round("key", k)), "ngrams_1", "key", "c"), factors, f"contexts_2/part={k}")
        last = F.pmod(F.col("b"), F.lit(rounds)).cast("int").alias("last")
        scratch.write(weighted.select(key, "c", "p", F.lit(k).alias("first"), last), f"pairs/part={k}")
        scratch.drop(f"all_2/part={k}")

    pairs = scratch.read("pairs", "key long, c long, p double, first int, last int").select("key", "c", "p", "first", "last")
    parts, factors = _counted(scratch, learned, _triples, "all_3", rounds)
    scratch.drop("learned")
    for k, found in enumerate(parts):
        own = scratch.read(f"pairs/part={k}", "key long, p double")
        weighted = _weighted(
            scratch, found, small(own, f"pairs/part={k}", *below), pairs.where(F.col("last") == k).drop("last"), factors, f"ngrams_2/order=2/part={k}")
        scratch.write(weighted.select(key, "c", "p"), f"ngrams_3/order=3/part={k}")
        scratch.drop(f"all_3/part={k}")
    scratch.drop("pairs")
    return Tables(
        scratch.read("contexts_2", "key long, back double").select("key", "back"),
        [scratch.read(f"ngrams_2/order=2/part={k}", "key long, p double, back double, first int") for k in range(rounds)],
        [scratch.read(f"ngrams_3/order=3/part={k}", "key long, p double") for k in range(rounds)], scratch)


def score(scratch: Scratch, docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """`docs` (text, any other columns) with n_tokens, n_known, base_score and
    score added, in place of columns of these names. base_score is the sum over
    the tokens of log10((c + 0.5) / (N + 0.5 (V + 1))); a null text has only its
    end token. Columns of other names are kept, whatever they are."""
    others = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "n_known", "base_score", "score")]
    held = docs.sparkSession.sparkContext.broadcast((model.words, model.counts, model.total, model.distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, total, distinct = held.value
        base_of = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        for batch in batches:
            for part in slices(batch.column(batch.num_columns - 1)):
                toks, heads = tokens(part)
                ids = _find(known, toks)
                base = np.where(ids >= 0, base_of[np.maximum(ids, 0)], 0.0) if len(base_of) else np.zeros(len(toks))
                rare = np.flatnonzero(ids < 0)
                cuts = np.searchsorted(rare, heads)
                hashes, times, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    h, k = np.unique(toks[rare[a:b]].view(np.int64), return_counts=True)
                    hashes.append(h)
                    times.append(k)
                    sizes.append(len(h))
                offsets = pa.array(np.cumsum(sizes).astype(np.int32))
                own = batch.slice(part.rows.start, part.rows.stop - part.rows.start)
                sums = lambda x: np.add.reduceat(x, heads[:-1])  # noqa: E731  every text has a token
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(np.diff(heads).astype(np.int64)), pa.array(sums((ids >= 0).astype(np.int64))), pa.array(sums(base)),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hashes))),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.array(toks.view(np.int64)))],
                    names=["lw_row", "kept", "n_tokens", "n_known", "base", "rare", "times", "toks"])

    whole = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("none"))
    cut = docs.select(F.monotonically_increasing_id().alias("lw_row"), whole.alias("kept"), F.col("text").cast("string").alias("text"))
    schema = cut.drop("text").schema.add("n_tokens", "long").add("n_known", "long").add("base", "double")
    schema = schema.add("rare", ArrayType(LongType())).add("times", ArrayType(IntegerType())).add("toks", ArrayType(LongType()))
    rows = scratch.write(cut.mapInArrow(run, schema), "rows")
    asked = rows.select("lw_row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("lw_row", F.col("w.rare").alias("key"), "w.times")
    floor = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(model.total + 0.5 * (model.distinct + 1)))
    few = words.where(F.col("c") < (int(model.counts.min()) if len(model.counts) else 1)).select("key", "c")
    answers = asked.join(few, "key", "left").groupBy("lw_row").agg(
        F.sum(F.col("times") * F.when(F.col("c") > 0, 1).otherwise(0)).alias("r_known"),
        F.sum(F.col("times") * floor).alias("r_base"))
    logs = _table_logs(scratch, rows.select("lw_row", "toks"), model, words)
    zero = F.lit(0)
    return rows.drop("rare", "times", "toks").join(answers, "lw_row", "left").join(logs, "lw_row", "left").select(
        *(F.col("kept").getField(c).alias(c) for c in others), "n_tokens", (F.col("n_known") + F.coalesce("r_known", zero)).alias("n_known"),
        (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"), F.col("log").alias("score"))


def _asks(k: int, rounds: int):
    """(lw_row, key, a, v, w) of the tokens of (lw_row, toks) whose triples are
    of round k: the triple's key, the key of the pair before the token, the word
    before it, the word. Before each text stand two words made up from its row,
    which no table holds: so its first tokens back off, and no key is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            for lo, hi, toks, heads in _texts(batch.column(1)):
                own = row[lo:hi].view(np.uint64)
                start = mix(np.repeat(own * np.uint64(2), 2) + np.tile(np.array([0, 1], np.uint64), hi - lo))
                owner = np.repeat(row[lo:hi], np.diff(heads) + 2)
                toks = np.insert(toks, np.repeat(heads[:-1], 2), start)
                real = np.ones(len(toks), bool)
                first = heads[:-1] + 2 * np.arange(hi - lo)
                real[first] = real[first + 1] = False
                w = np.flatnonzero(real)
                w = w[_round(toks[w - 1], rounds) == k]
                a = gram_keys(toks[w - 2], toks[w - 1])
                key = gram_keys(a, gram_keys(toks[w - 1], toks[w]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[w]), *(pa.array(x.view(np.int64)) for x in (key, a, toks[w - 1], toks[w]))], names=["lw_row", "key", "a", "v", "w"])

    return run


def _table_logs(scratch: Scratch, rows: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """(lw_row, log) of `rows` (lw_row, toks): the sum of log10 P of all tokens."""
    tables = model.tables
    small = lambda df, key, value, to, name, name_to=None: tables.scratch.small(
        df.select(F.col(key).alias(to), F.col(value).alias(name_to or value)), name)
    log = lambda c: F.log10(F.greatest(F.coalesce(c, F.lit(1.0)), F.lit(1e-300)))
    for k, triples in enumerate(tables.triples):
        asks = rows.mapInArrow(_asks(k, len(tables.triples)), "lw_row long, key long, a long, v long, w long")
        met = asks.join(small(triples, "key", "p", "key", f"ngrams_3/order=3/part={k}"), "key", "left")
        miss = [F.when(F.col("p").isNull(), F.col(c)).alias(c) for c in ("a", "v", "w")]
        met = scratch.write(met.select("lw_row", F.log10("p").alias("log"), *miss), "asked")
        scratch.release()
        left = met.where("log IS NULL").select("lw_row", "a", "v", "w", F.xxhash64("v", "w").alias("vw"))
        left = left.join(small(tables.pairs[k], "key", "back", "a", f"ngrams_2/order=2/part={k}"), "a", "left")
        left = left.join(small(tables.all_pairs().where(F.col("first") == k), "key", "p", "vw", "ngrams_2"), "vw", "left")
        left = left.join(small(tables.words, "key", "back", "v", "contexts_2", "back_v"), "v", "left")
        left = left.join(small(words, "key", "c", "w", "ngrams_1"), "w", "left")
        lower = F.when(F.col("p").isNotNull(), F.log10("p")).otherwise(log(F.col("back_v")) + model.word_log(F.col("c")))
        every = met.where("log IS NOT NULL").select("lw_row", "log").unionByName(left.select("lw_row", (log(F.col("back")) + lower).alias("log")))
        scratch.write(every.groupBy("lw_row").agg(F.sum("log").alias("log")), f"logs/part={k}")
        scratch.drop("asked")
    return scratch.read("logs", "lw_row long, log double").groupBy("lw_row").agg(F.sum("log").alias("log"))
