"""Katz backoff over a corpus that is learned from and scored in one go.

The model is that of `katz`: all words, pairs and triples of the texts to learn
from, with exact counts, however rare. `katz.fit` keeps it in tables of a row an
n-gram; here every token to score meets the counts of its own n-grams, and
nothing of them is kept.

1. Texts are cut into token hashes once, words counted. Pairs and triples, put
   together within tasks, are dealt by their keys and summed, which gives the
   numbers of n-grams seen once, twice and so on, and so the discounts.
2. Then every token, with the two before it, is dealt by the word before it:
   so all pairs after a word meet, and give the probability of each after it.
3. With that it is dealt by the pair before it, and all triples after a pair
   meet likewise. Logarithms go back to blocks of documents and are summed.

Rows that are shuffled hold arrays, an n-gram or token an element. Steps 1 to 3
are done in rounds dealt by the (middle) word, so that the disk holds a round.
What is frequent is not gathered in one place: what follows a word or pair seen
`hot` times or more is spread by pair or triple over as many places as it needs,
and the sums over all that follows are made first and sent to all tasks (at most
1 / `hot` of the tokens are such words or pairs).
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.bytewords import mix, slices
from logweave.llm.common import Scratch
from logweave.llm.katz import (
    BUFFER, K, _find, _pairs, _texts, _triples, _word_counts, discounts, gram_keys, tokens, word_factors)

#: Rounds of the tokens; and of the counts, whose rows are fewer.
ROUNDS, COUNT_ROUNDS = 9, 2
#: Tokens that are gathered in one place, about.
SHARE = 1 << 19
#: What follows words and pairs seen so often is dealt by pair or triple.
HOT = 1 << 18
#: Documents of a block are 1 << BLOCK.
BLOCK = 12


#: Types of the packed elements; what is not named is a long.
HASHES = dict.fromkeys(("a", "b", "u", "v", "w", "key", "gram"), np.uint64)
TYPES = {**HASHES, "low": np.float64, "log": np.float64, "base": np.float64, "own": np.int8}
_GRAMS = "bucket long, a binary, b binary, n binary"
_KEYS = "bucket long, key binary, n binary"
_WORDS = "bucket long, key binary, c binary"
_FOUND = "kind int, a long, b long, c long, u binary, w binary"
_TOKENS = "bucket long, row binary, u binary, v binary, w binary, c binary, own binary"
_AFTER = "bucket long, row binary, a binary, gram binary, low binary, c binary, own binary"
_LOGS = "bucket long, row binary, log binary, base binary, known binary, size binary"
_HOT = "a long, held double, c long, base double"
_SUMS = "lw_row long, log double, base double, known long, size long"


def _rows(ids: np.ndarray, offsets: np.ndarray, names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each id with the elements of each column from its offset on."""
    one = lambda x: pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), *(one(x.astype(TYPES.get(n, np.int64), copy=False)) for n, x in zip(names, columns))], names=["bucket", *names])


def _packed(bucket: np.ndarray, names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket with its elements."""
    by = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    ids, first = np.unique(bucket[by], return_index=True)
    return _rows(ids, np.append(first, len(by)), names, [x[by] for x in columns])


def _flat(table: pa.Table, *names: str) -> list[np.ndarray]:
    """The elements of packed columns, of all rows."""
    return [np.frombuffer(b"".join(x.as_buffer() for x in table.column(n) if x.is_valid), TYPES.get(n, np.int64)) for n in names]


def _share_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges the hashes are in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")][1:]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and where in it each distinct one starts."""
    by = np.argsort(keys)
    of = keys[by]
    return by, np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)


def _spread(a: np.ndarray, gram: np.ndarray, contexts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Where n-grams are dealt to: by their context, after a hot one over `parts` places."""
    bucket = mix(a)
    at = _find(contexts, a)
    of = np.flatnonzero(at >= 0)
    bucket[of] += gram[of] % parts[at[of]]
    return bucket


def _counting(grams_of, contexts: np.ndarray, parts: np.ndarray, buckets: int):
    """Packed (a, b, n) of the n-grams of texts, counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            keys = gram_keys(a, b)
            by, starts = _runs(keys)
            at, n = by[starts], np.diff(np.append(starts, len(by)))
            keys = keys[at]
            return _packed(_spread(a[at], keys, contexts, parts) % np.uint64(buckets), _names(_GRAMS), [a[at], b[at], n.astype(np.int64)])

        for batch in batches:
            for _, _, toks, heads in _texts(batch.column(0)):
                held.append(grams_of(toks, heads[:-1]))
                size += len(held[-1][0])
                if size >= BUFFER // 4:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return run


def _counting_keys(grams_of, buckets: int):
    """Packed (key, n) of the n-grams of texts, counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            ids, first = np.unique(_share_of(keys, buckets), return_index=True)
            return _rows(ids, np.append(first, len(keys)), _names(_KEYS), [keys, n])

        for batch in batches:
            for _, _, toks, heads in _texts(batch.column(0)):
                held.append(gram_keys(*grams_of(toks, heads[:-1])))
                size += len(held[-1])
                if size >= BUFFER // 4:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return run


def _summing_keys(table: pa.Table) -> pa.Table:
    """(r, number of a bucket's n-grams seen r times), r up to K + 1."""
    keys, n = _flat(table, "key", "n")
    by, starts = _runs(keys)
    c = np.add.reduceat(n[by], starts)
    r, times = np.unique(c[c <= K + 1], return_counts=True)
    return pa.table({"a": r, "c": times})


def _summing(contexts: np.ndarray, hot: int, buckets: int):
    """Of a bucket's n-grams: (0, r, 0, number seen r times); (1, key, b, count) of
    those seen `hot` times; after each of `contexts` (2, a, r, number seen r times)
    and (2, a, 0, all counts); and (3, bucket of w, u, w) of those n-grams, packed."""

    def run(table: pa.Table) -> pa.Table:
        a, b, n = _flat(table, "a", "b", "n")
        keys = gram_keys(a, b)
        by, starts = _runs(keys)
        c, at = np.add.reduceat(n[by], starts), by[starts]
        a, b, keys = a[at], b[at], keys[at]
        r, times = np.unique(c[c <= K + 1], return_counts=True)
        many = np.flatnonzero(c >= hot)
        of = _find(contexts, a)
        after = np.flatnonzero(of >= 0)
        of, few = of[after], c[after] <= K
        all_of, where = np.unique(of, return_inverse=True)
        cells, numbers = np.unique(of[few] * (K + 1) + c[after][few], return_counts=True)
        by = after[np.argsort(of, kind="stable")]
        packed = _packed(b[by] % np.uint64(buckets), ["u", "w"], [a[by], b[by]])
        signed = lambda x: x.view(np.int64)
        rows = [  # (kind, a, b, c)
            (0, r, np.zeros(len(r), np.int64), times), (1, signed(keys[many]), signed(b[many]), c[many]),
            (2, signed(contexts[all_of]), np.zeros(len(all_of), np.int64), np.bincount(where, c[after], len(all_of)).astype(np.int64)),
            (2, signed(contexts[cells // (K + 1)]), cells % (K + 1), numbers)]
        plain = sum(len(x[1]) for x in rows)
        none = pa.nulls(plain, pa.binary())
        wide = lambda k, x: pa.chunked_array([pa.array(np.concatenate([row[k] for row in rows])), x])
        zeros = pa.array(np.zeros(len(packed), np.int64))
        return pa.table({
            "kind": np.concatenate([*(np.full(len(row[1]), row[0], np.int32) for row in rows), np.full(len(packed), 3, np.int32)]),
            "a": wide(1, packed.column(0)), "b": wide(2, zeros), "c": wide(3, zeros),
            "u": pa.chunked_array([none, packed.column(1)]), "w": pa.chunked_array([none, packed.column(2)])})

    return run


def _bases(word):
    """(a, base): the probabilities of the words w that follow u, summed over a bucket."""

    def run(after: pa.Table, words: pa.Table) -> pa.Table:
        a, w = _flat(after, "u", "w")
        key, c = _flat(words, "key", "c")
        by = np.argsort(key)
        at, starts = _runs(a)
        sums = np.add.reduceat(word(c[by])[_find(key[by], w)][at], starts) if len(a) else np.zeros(0)
        return pa.table({"a": a[at[starts]].view(np.int64), "base": sums})

    return run


def _totals(held: np.ndarray, count: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, back) of contexts, as `katz._weighted` has them."""
    total = np.where(held > count * (1 - 1e-9), held + 1, np.maximum(count, 1))
    return total, (1 - held / total) / np.maximum(1 - base, 1e-12)


def _word(factors: np.ndarray, total: int, unseen: float):
    """From counts to the probabilities of words."""
    return lambda c: np.where(c > 0, factors[np.minimum(c, K + 1)] * c / max(total, 1), unseen)


@dataclass
class Level:
    """What all tasks know of one order: discounts, the sums after the contexts
    that are hot, and the counts of the n-grams that are."""

    factors: np.ndarray             # of the counts 0 .. K + 1
    contexts: np.ndarray            # keys of hot ones, sorted
    total: np.ndarray               # and their sums
    back: np.ndarray
    parts: np.ndarray               # places their n-grams are dealt to
    grams: np.ndarray               # keys, sorted
    counts: np.ndarray              # and their counts

    def probabilities(self, a: np.ndarray, gram: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
        """P of each element: an n-gram with its context `a` and the probability
        `low` one order down; n is 1 where it is learned from. All elements of an
        n-gram that is not hot are here, and of a context that is not."""
        by, starts = _runs(gram)
        at = by[starts]
        c, a, low = np.add.reduceat(n[by].astype(np.int64), starts), a[at], low[at]
        hot = _find(self.grams, gram[at])
        c = np.where(hot >= 0, self.counts[hot], c) if len(self.counts) else c
        mass = self.factors[np.minimum(c, K + 1)] * c
        # of the n-grams after a context only those seen count; without any, total and back are 1
        order, first = _runs(a)
        seen = (c > 0)[order]
        total, back = np.ones(len(a)), np.ones(len(a))
        if len(a):
            sums = [np.add.reduceat(np.where(seen, x[order], 0.0), first) for x in (mass, c, low)]
            for out, x in zip((total, back), _totals(*sums)):
                out[order] = np.repeat(x, np.diff(np.append(first, len(a))))
        of = _find(self.contexts, a)
        for out, x in ((total, self.total), (back, self.back)):
            out[of >= 0] = x[of[of >= 0]]
        p = np.empty(len(gram))
        p[by] = np.repeat(np.where(c > 0, mass / total, back * low), np.diff(np.append(starts, len(by))))
        return p


@dataclass
class Corpus:
    """What all tasks know: words held in memory, and the orders."""

    words: np.ndarray               # hashes of the words held in memory, sorted
    counts: np.ndarray              # and their counts
    factors: np.ndarray             # of a word's count, 0 .. K + 1
    unseen: float                   # P of the class of unseen words
    total: int
    distinct: int
    buckets: int
    bits: int                       # leading bits of a hash, and where the words
    first: np.ndarray               # with each value of them start
    pairs: Level | None = None
    triples: Level | None = None

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes among the words held in memory, -1 where absent: looked
        up from where the words with the same leading bits start."""
        shift = np.uint64(64 - self.bits)
        at, end = self.first[hashes >> shift], self.first[(hashes >> shift) + np.uint64(1)]
        out, left = np.full(len(hashes), -1, np.int64), np.flatnonzero(at < end)
        while len(left):
            same = self.words[at[left]] == hashes[left]
            out[left[same]] = at[left[same]]
            at[left] += 1
            left = left[~same & (at[left] < end[left])]
        return out

    def plain(self) -> dict:
        """What a broadcast can hold: its value is read without this package."""
        return {**vars(self), "pairs": vars(self.pairs), "triples": vars(self.triples)}

    @staticmethod
    def of(plain: dict) -> Corpus:
        return Corpus(**{**plain, "pairs": Level(**plain["pairs"]), "triples": Level(**plain["triples"])})

    def dealt(self, row, u, v, w, c, n) -> pa.RecordBatch:
        """Tokens by the word before, by the pair after a hot word, by the triple
        where that pair is hot."""
        gram = gram_keys(v, w)
        hot = np.flatnonzero(_find(self.pairs.grams, gram) >= 0)
        gram[hot] = gram_keys(gram_keys(u[hot], v[hot]), gram[hot])
        bucket = _spread(v, gram, self.pairs.contexts, self.pairs.parts)
        return _packed(bucket % np.uint64(self.buckets), _names(_TOKENS), [row, u, v, w, c, n])


def _entries(held, k: int, known: bool, rounds: int, after: np.ndarray | None = None):
    """Packed tokens of round k (only those after one of the words `after`, if
    given), of (lw_row, learn, toks): those whose word is
    held in memory, with its count, or the others dealt by word. n: 1 if the pair is
    learned from, 3 if the triple is too. Before each text stand two words made
    up from its row, which no other text has."""

    # the hashes of `_share_of` k are these
    least, end = (-(-(i << 32) // rounds) << 32 for i in (k, k + 1))
    least, most = np.uint64(least), np.uint64(end - least - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = Corpus.of(held.value)
        for batch in batches:
            row, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, toks, heads in _texts(batch.column(2)):
                own = row[lo:hi].view(np.uint64) * np.uint64(2)
                starts = mix(own), mix(own + np.uint64(1))
                # all tokens are looked at in every round: only by the range of the word before
                chosen = np.empty(len(toks), bool)
                chosen[1:] = toks[:-1] - least <= most
                chosen[heads[:-1]] = starts[1] - least <= most
                w = np.flatnonzero(chosen)
                owner = np.searchsorted(heads, w, "right") - 1
                place = w - heads[owner]
                v = np.where(place > 0, toks[w - 1], starts[1][owner])
                keep = np.ones(len(w), bool) if after is None else _find(after, v) >= 0
                at = corpus.held(toks[w])
                keep &= (at >= 0) == known
                w, owner, place, v, at = (x[keep] for x in (w, owner, place, v, at))
                u = np.where(place > 1, toks[w - 2], np.where(place > 0, starts[1][owner], starts[0][owner]))
                owner += lo
                n = (learn[owner] * ((place > 0) + 2 * (place > 1))).astype(np.int8)
                columns = [row[owner], u, v, toks[w]]
                if known:
                    yield corpus.dealt(*columns, corpus.counts[at], n)
                else:
                    yield _packed(toks[w] % np.uint64(corpus.buckets), _names(_TOKENS), [*columns, np.zeros(len(w), np.int64), n])

    return run


def _by_word(buckets: int):
    """Packed (key, c) of the word table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            yield _packed(key % np.uint64(buckets), ["key", "c"], [key, batch.column(1).to_numpy()])

    return run


def _counts_met(held):
    def run(tokens: pa.Table, words: pa.Table) -> pa.Table:
        row, u, v, w, n = _flat(tokens, "row", "u", "v", "w", "own")
        key, c = _flat(words, "key", "c")
        by = np.argsort(key)
        at = _find(key[by], w)
        found = np.where(at >= 0, c[by][at], 0) if len(c) else np.zeros(len(w), np.int64)
        return pa.Table.from_batches([Corpus.of(held.value).dealt(row, u, v, w, found, n)])

    return run


def _met(corpus: Corpus, table: pa.Table):
    """(row, c, n, a, gram, low) of packed tokens: n of the triple, a the pair
    before the token, low the probability after the word before it."""
    row, u, v, w, c, n = _flat(table, *_names(_TOKENS))
    pair = gram_keys(v, w)
    low = corpus.pairs.probabilities(v, pair, n & 1, _word(corpus.factors, corpus.total, corpus.unseen)(c))
    a = gram_keys(u, v)
    return row, c, n >> 1, a, gram_keys(a, pair), low


def _after_words(held):
    def run(table: pa.Table) -> pa.Table:
        corpus = Corpus.of(held.value)
        row, c, n, a, gram, low = _met(corpus, table)
        bucket = _spread(a, gram, corpus.triples.contexts, corpus.triples.parts) % np.uint64(corpus.buckets)
        return pa.Table.from_batches([_packed(bucket, _names(_AFTER), [row, a, gram, low, c, n])])

    return run


def _hot_sums(held):
    """(a, held, c, base) of the triples after hot pairs; all of a triple are here."""

    def run(table: pa.Table) -> pa.Table:
        corpus = Corpus.of(held.value)
        _, _, n, a, gram, low = _met(corpus, table)
        of = np.flatnonzero((n > 0) & (_find(corpus.triples.contexts, a) >= 0))
        by, starts = _runs(gram[of])
        c, at = np.add.reduceat(n[of][by].astype(np.int64), starts), of[by[starts]]
        order, first = _runs(a[at])
        sums = [np.add.reduceat(x[order], first) for x in (corpus.triples.factors[np.minimum(c, K + 1)] * c, c, low[at])]
        return pa.table(dict(zip(("a", "held", "c", "base"), [a[at][order[first]].view(np.int64), *sums])))

    return run


def _row_sums(row: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    by, starts = _runs(row)
    return [row[by[starts]], *(np.add.reduceat(x[by], starts) for x in columns)]


def _after_pairs(held):
    def run(table: pa.Table) -> pa.Table:
        corpus = Corpus.of(held.value)
        row, a, gram, low, c, n = _flat(table, *_names(_AFTER))
        log = np.log10(np.maximum(corpus.triples.probabilities(a, gram, n, low), 1e-300))
        base = np.log10((c + 0.5) / (corpus.total + 0.5 * (corpus.distinct + 1)))
        sums = _row_sums(row, log, base, (c > 0).astype(np.int64), np.ones(len(row), np.int64))
        return pa.Table.from_batches([_packed(sums[0] >> BLOCK, _names(_LOGS), sums)])

    return run


def _rows_of_block(table: pa.Table) -> pa.Table:
    return pa.table(dict(zip(["lw_row", *_names(_LOGS)[1:]], _row_sums(*_flat(table, *_names(_LOGS))))))


def _in_rounds(scratch: Scratch, name: str, schema: str, rounds: int, of_round) -> DataFrame:
    """What `of_round` makes of each round, written; the files of a round go
    before the next. Py4J lets go of what Python has freed once a second only."""
    for k in range(rounds):
        scratch.write(of_round(k), f"{name}/part={k}")
        scratch.release()
        time.sleep(1.2)
        scratch.release()
    return scratch.read(name, schema)


def _discounts(found: DataFrame) -> np.ndarray:
    """From (a, c): c n-grams were seen a times."""
    return discounts({r["a"]: r["c"] for r in found.groupBy("a").agg(F.sum("c").alias("c")).collect()})


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a small result, by its first, a key."""
    got = df.toArrow()
    first, *others = (got.column(c).to_numpy() for c in got.column_names)
    by = np.argsort(first.view(np.uint64))
    return [first.view(np.uint64)[by], *(x[by] for x in others)]


def _pairs_level(scratch: Scratch, learned: DataFrame, words: DataFrame, word, buckets: int, hot: int) -> tuple[Level, np.ndarray]:
    """The level of the pairs, and the last words of the hot ones."""
    contexts, count = _columns(words.where(F.col("c") >= hot).select("key", "c"))
    parts = (-(-count // hot)).astype(np.uint64)

    def counted(k: int) -> DataFrame:
        packed = learned.select("toks").mapInArrow(_counting(_pairs(k, COUNT_ROUNDS), contexts, parts, buckets), _GRAMS)
        return packed.groupBy("bucket").applyInArrow(_summing(contexts, hot, buckets), _FOUND)

    found = _in_rounds(scratch, "pairs", _FOUND, COUNT_ROUNDS, counted)
    factors = _discounts(found.where("kind = 0"))
    grams, last, counts = _columns(found.where("kind = 1").select("a", "b", "c"))
    total, back = np.ones(len(contexts)), np.ones(len(contexts))
    if len(contexts):
        pairs = found.where("kind = 3").select(F.col("a").alias("bucket"), "u", "w")
        by_word = words.mapInArrow(_by_word(buckets), _WORDS)
        of, base = _columns(pairs.groupBy("bucket").cogroup(by_word.groupBy("bucket")).applyInArrow(_bases(word), "a long, base double").groupBy("a").agg(F.sum("base").alias("base")))
        a, r, c = _columns(found.where("kind = 2").groupBy("a", "b").agg(F.sum("c").alias("c")))
        count, held = np.zeros(len(of)), np.zeros(len(of))
        at = _find(of, a)
        np.add.at(count, at[r == 0], c[r == 0])
        np.add.at(held, at, np.where(r == 0, 1.0, (factors[r] - 1) * r) * c)
        where = _find(contexts, of)
        total[where], back[where] = _totals(held, count, base)
    scratch.drop("pairs")
    return Level(factors, contexts, total, back, parts, grams, counts), last.view(np.uint64)


def _triples_level(scratch: Scratch, corpus: Corpus, rows: DataFrame, words_by: DataFrame, words: DataFrame, last: np.ndarray, buckets: int, hot: int, rounds: int, every: int) -> Level:
    none = np.zeros(0, np.uint64)
    learned = rows.where("learn")

    def counted(k: int) -> DataFrame:
        packed = learned.select("toks").mapInArrow(_counting_keys(_triples(k, COUNT_ROUNDS), buckets), _KEYS)
        return packed.groupBy("bucket").applyInArrow(_summing_keys, "a long, c long")

    factors = _discounts(_in_rounds(scratch, "triples", "a long, c long", COUNT_ROUNDS, counted))
    contexts, counts = corpus.pairs.grams, corpus.pairs.counts
    level = Level(factors, contexts, np.ones(len(contexts)), np.ones(len(contexts)), (-(-counts // hot)).astype(np.uint64), none, np.zeros(0, np.int64))
    if len(contexts):
        # all that follows the last words of the hot pairs, in rounds of the same size
        last = np.unique(last)
        corpus.triples, few = level, rows.sparkSession.createDataFrame([(x,) for x in last.view(np.int64).tolist()], "key long")
        tokens_after = words.join(F.broadcast(few), "key").agg(F.sum("c")).first()[0]
        own = max(1, math.ceil(tokens_after * rounds / max(every, 1)))
        held = rows.sparkSession.sparkContext.broadcast(corpus.plain())
        sums_of = lambda k: _round_of(held, learned, words_by, k, own, last).groupBy("bucket").applyInArrow(_hot_sums(held), _HOT)
        sums = _in_rounds(scratch, "hot", _HOT, own, sums_of)
        of, mass, count, base = _columns(sums.groupBy("a").agg(F.sum("held").alias("held"), F.sum("c").alias("c"), F.sum("base").alias("base")))
        where = _find(contexts, of)
        level.total[where], level.back[where] = _totals(mass, count.astype(float), base)
    return level


def _round_of(held, rows: DataFrame, words_by: DataFrame, k: int, rounds: int, after: np.ndarray | None = None) -> DataFrame:
    """The packed tokens of round k, where `Corpus.dealt` deals them to."""
    rare = rows.mapInArrow(_entries(held, k, False, rounds, after), _TOKENS)
    rare = rare.groupBy("bucket").cogroup(words_by.groupBy("bucket")).applyInArrow(_counts_met(held), _TOKENS)
    return rows.mapInArrow(_entries(held, k, True, rounds, after), _TOKENS).unionByName(rare)


def score_corpus(
        scratch: Scratch, docs: DataFrame, word_share: float = 1e-6, rounds: int = ROUNDS, share: int = SHARE, hot: int = HOT) -> tuple[DataFrame, int]:
    """`docs` (text, learn, any other columns) with n_tokens, n_known, base_score
    and score in place of text, learn and columns of these names; and the number
    of tokens learned from. The model learns from the rows where `learn` holds
    and scores all; scores are those of `katz.fit` and `katz.score`."""
    if not (0 < word_share <= 1 and min(rounds, share, hot) >= 1):
        raise ValueError("word_share must be above 0 and not above 1, rounds, share and hot at least 1")
    spark = docs.sparkSession
    others = [c for c in docs.columns if c.lower() not in ("text", "learn", "n_tokens", "n_known", "base_score", "score")]
    whole = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("none"))
    cut = docs.select(F.monotonically_increasing_id().alias("lw_row"), whole.alias("kept"), F.coalesce("learn", F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(batch.num_columns - 1)):
                toks, heads = tokens(part)
                own = batch.slice(part.rows.start, part.rows.stop - part.rows.start)
                data = [None, pa.py_buffer((heads * 8).astype(np.int32)), pa.py_buffer(toks)]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(np.diff(heads).astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(part), data)],
                    names=["lw_row", "kept", "learn", "size", "toks"])

    rows = scratch.write(cut.mapInArrow(run, cut.drop("text").schema.add("size", "long").add("toks", "binary")), "rows")
    learned = rows.where("learn")
    words = scratch.write(_word_counts(learned), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    every = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    floor = max(1, math.ceil(word_share * total))
    key, c = _columns(words.where(F.col("c") >= floor).select("key", "c"))
    factors, unseen = word_factors(words, total)
    bits = max(1, len(key).bit_length())
    first = np.append(np.searchsorted(key >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)), len(key))
    corpus = Corpus(key, c, factors, unseen, total, distinct, max(1, math.ceil(every / (rounds * share))), bits, first)
    few = words.where(F.col("c") < floor).select("key", "c").mapInArrow(_by_word(corpus.buckets), _WORDS)
    of = rows.select("lw_row", "learn", "toks")
    counting = max(1, math.ceil(total / (COUNT_ROUNDS * share)))
    corpus.pairs, last = _pairs_level(scratch, learned, words.select("key", "c"), _word(factors, total, unseen), counting, hot)
    corpus.triples = _triples_level(scratch, corpus, of, few, words, last, counting, hot, rounds, every)
    held = spark.sparkContext.broadcast(corpus.plain())

    def scored(k: int) -> DataFrame:
        after_words = _round_of(held, of, few, k, rounds).groupBy("bucket").applyInArrow(_after_words(held), _AFTER)
        logs = after_words.groupBy("bucket").applyInArrow(_after_pairs(held), _LOGS)
        return logs.groupBy("bucket").applyInArrow(_rows_of_block, _SUMS)

    sums = _in_rounds(scratch, "logs", _SUMS, rounds, scored)
    sums = sums.groupBy("lw_row").agg(*(F.sum(c).alias(c) for c in ("log", "base", "known", "size")))
    return rows.select("lw_row", "kept").join(sums, "lw_row").select(
        *(F.col("kept").getField(c).alias(c) for c in others), F.col("size").alias("n_tokens"), F.col("known").alias("n_known"),
        F.col("base").alias("base_score"), F.col("log").alias("score")), int(total)
