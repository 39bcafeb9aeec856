"""Language identification with a linear-chain conditional random field.

Every word of a sentence gets a language. A word's score for a language is a
sum of learned weights of its features: affixes (its first and last one to
three bytes), n-grams (its byte pairs and triples, with the word's ends) and
lexicon (the word itself), all hashed into fixed tables. Learned transitions
tie neighbouring words. Forward-backward over a sentence gives each word's
posterior, so code-switched text gets a share for each language; a document's
language is the one with the largest sum of posteriors, its score that sum's
share of the words.

A sentence ends with a line or a full stop; one of more than PIECE words is
decoded in pieces of that length side by side, whose transfer matrices carry the
forward and backward vectors over the cuts, so the posteriors are those of the
whole chain. `label_words` returns each word's place, language and posterior.

Training maximises the conditional likelihood by Adagrad on a bounded sample of
labelled documents (`per_language` documents of at most `max_chars` characters
for each language, chosen by a hash of the id); every word carries its
document's label. So that transitions are learned from changes of language too,
one in SWITCHED texts is followed by a sentence joined from its words and those
of the next text. Prediction covers whole texts and is one narrow pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from logweave.llm.bytewords import LETTERS, LOWER, Slice, mix, slices, word_counts, word_hashes, word_spans

PIECE = 256
#: One joined sentence for so many texts, of so many words of each of two.
SWITCHED, JOINED_WORDS = 4, 8
NGRAM_BITS, AFFIX_BITS, WORD_BITS = 16, 15, 17
_SIZES = (1 << NGRAM_BITS, 1 << AFFIX_BITS, 1 << WORD_BITS)
_ENDS = np.zeros(256, bool)
_ENDS[[10, 46]] = True
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]        # n-grams, affixes, words: weights by language
    bias: np.ndarray
    transitions: np.ndarray         # from, to


def _bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values) >> np.uint64(64 - bits)).astype(np.int64)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table (places of features, the word each belongs to)."""
    lens = ends - starts
    owner = np.repeat(np.arange(len(starts)), lens)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
    at = starts[owner] + within
    here = data[at].astype(np.uint64) + np.uint64(1)
    left = np.where(within > 0, data[np.maximum(at - 1, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    right = np.where(within + 1 < lens[owner], data[np.minimum(at + 1, len(data) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    pair = left * np.uint64(257) + here + np.uint64(1 << 40)
    triple = (left * np.uint64(257) + here) * np.uint64(257) + right + np.uint64(2 << 40)
    grams = np.concatenate([_bucket(pair, NGRAM_BITS), _bucket(triple, NGRAM_BITS)])
    affixes, who = [], []
    for size in (1, 2, 3):
        long = np.flatnonzero(lens >= size)
        for kind, first in ((0, starts[long]), (1, ends[long] - size)):
            code = np.full(len(long), 1 + size * 2 + kind, np.uint64)
            for k in range(size):
                code = code * np.uint64(257) + data[first + k].astype(np.uint64)
            affixes.append(_bucket(code, AFFIX_BITS))
            who.append(long)
    return [(grams, np.concatenate([owner, owner])), (np.concatenate(affixes), np.concatenate(who)),
            (_bucket(hashes, WORD_BITS), np.arange(len(starts)))]


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], 1)


def word_scores(model: Model, features: list, n: int) -> np.ndarray:
    out = np.tile(model.bias, (n, 1))
    for table, (places, owner) in zip(model.tables, features):
        out += _sums(owner, table[places], n)
    return out


@dataclass
class Chains:
    """Pieces of the sentences of a slice, longest first: `at(t)` are the places
    of their t-th words. `nth` counts a sentence's pieces, `before` is the piece
    that one continues (-1: none)."""

    starts: np.ndarray
    lens: np.ndarray
    nth: np.ndarray
    before: np.ndarray

    def at(self, t: int) -> np.ndarray:
        return self.starts[: int(np.searchsorted(-self.lens, -t, "left"))] + t


def sentences(part: Slice, starts: np.ndarray) -> Chains:
    ended = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum(_ENDS[part.data], out=ended[1:])
    texts = np.searchsorted(part.bounds, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(ended[starts]) > 0) | (np.diff(texts) > 0)
    first = np.flatnonzero(new)
    lens = np.diff(np.append(first, len(starts)))
    pieces = -(-lens // PIECE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + nth * PIECE
    size = np.minimum(np.repeat(first + lens, pieces) - begin, PIECE)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    before = np.where(nth[order] > 0, place[order - 1], -1)
    return Chains(begin[order], size[order], nth[order], before)


def _over_cuts(local: np.ndarray, move: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the scaled forward vector of the word before it and the
    scaled backward vector of its last word (ones where the sentence ends)."""
    n, k = len(chains.lens), local.shape[1]
    enter, leave = np.ones((n, k)), np.ones((n, k))
    rest = np.flatnonzero(chains.before >= 0)
    if not len(rest):
        return enter, leave
    cut = np.union1d(rest, chains.before[rest])
    carry = np.tile(np.eye(k), (len(cut), 1, 1))
    for t in range(int(chains.lens[cut].max())):
        on = np.flatnonzero(chains.lens[cut] > t)
        first = (chains.nth[cut[on]] == 0) & (t == 0)
        step = np.where(first[:, None, None], carry[on], carry[on] @ move) * local[chains.starts[cut[on]] + t][:, None, :]
        carry[on] = step / step.sum((1, 2), keepdims=True)
    where = np.zeros(n, np.int64)
    where[cut] = np.arange(len(cut))
    by = rest[np.argsort(chains.nth[rest], kind="stable")]
    rounds = np.split(by, np.flatnonzero(np.diff(chains.nth[by])) + 1)
    for now in rounds:
        last = chains.before[now]
        v = np.einsum("ij,ijk->ik", enter[last], carry[where[last]])
        enter[now] = v / v.sum(1, keepdims=True)
    for now in reversed(rounds):
        v = np.einsum("ijk,ik->ij", carry[where[now]], leave[now])
        leave[chains.before[now]] = v / v.sum(1, keepdims=True)
    return enter, leave


def forward_backward(scores: np.ndarray, chains: Chains, transitions: np.ndarray, pairs: bool = False):
    """Posteriors of every word; with `pairs` also the expected number of each
    transition. Probabilities are scaled at every word, so chains of any
    length neither under- nor overflow."""
    local = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(transitions)
    ahead, back = np.empty_like(local), np.ones_like(local)
    enter, leave = _over_cuts(local, move, chains)
    if len(chains.lens):
        back[chains.starts + chains.lens - 1] = leave
    start = np.where(chains.before[:, None] >= 0, enter @ move, 1.0)
    longest = int(chains.lens[0]) if len(chains.lens) else 0
    for t in range(longest):
        at = chains.at(t)
        a = (start if t == 0 else ahead[at - 1] @ move) * local[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros_like(move)
    for t in range(longest - 1, 0, -1):
        at = chains.at(t)
        right = local[at] * back[at]
        b = right @ move.T
        if pairs:
            norm = (ahead[at - 1] * b).sum(1, keepdims=True)
            expected += (ahead[at - 1] / norm).T @ right * move
        back[at - 1] = b / b.sum(1, keepdims=True)
    at = chains.starts[chains.before >= 0]
    if pairs and len(at):
        right = local[at] * back[at]
        norm = (ahead[at - 1] * (right @ move.T)).sum(1, keepdims=True)
        expected += (ahead[at - 1] / norm).T @ right * move
    post = ahead * back
    post /= post.sum(1, keepdims=True)
    return (post, expected) if pairs else post


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.3, batch_bytes: int = 1 << 17) -> Model:
    """Fit the field; deterministic. Languages are sorted, so ties fall alike."""
    languages = sorted(set(labels))
    n = len(languages)
    model = Model(languages, [np.zeros((s, n)) for s in _SIZES], np.zeros(n), np.zeros((n, n)))
    order = np.random.default_rng(7).permutation(len(texts))
    rows = []                       # text, its language, the language of what stands from a byte on
    for j, i in enumerate(order):
        own = languages.index(labels[i])
        rows.append((texts[i], own, own, 0))
        after = order[(j + 1) % len(order)]
        if j % SWITCHED == 0 and labels[after] != labels[i]:
            head, tail = (" ".join(texts[x].replace(".", " ").split()[:JOINED_WORDS]) for x in (i, after))
            rows.append((f"{head} {tail}", own, languages.index(labels[after]), len(head.encode()) + 1))
    arr = pa.array([r[0] for r in rows], pa.string())
    gold, later, from_byte = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    past = [np.full_like(t, 1e-2) for t in model.tables] + [np.full(n, 1e-2), np.full((n, n), 1e-2)]
    for _ in range(epochs):
        for part in slices(arr, batch_bytes):
            data = LOWER[part.data]
            starts, ends = word_spans(part, LETTERS)
            if not len(starts):
                continue
            features = word_features(data, starts, ends, word_hashes(data, starts, ends))
            chains = sentences(part, starts)
            post, expected = forward_backward(word_scores(model, features, len(starts)), chains, model.transitions, True)
            text = np.searchsorted(part.bounds, starts, "right") - 1
            truth = np.where(starts - part.bounds[text] >= from_byte[part.rows][text], later[part.rows][text], gold[part.rows][text])
            delta = -post
            delta[np.arange(len(starts)), truth] += 1
            inner = np.concatenate([chains.starts[chains.before >= 0], *(chains.at(t) for t in range(1, int(chains.lens[0])))])
            seen = np.zeros((n, n))
            np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
            grads = [_sums(places, delta[owner], len(table)) for table, (places, owner) in zip(model.tables, features)]
            grads += [delta.sum(0), seen - expected]
            for value, grad, sq in zip([*model.tables, model.bias, model.transitions], grads, past):
                grad = grad / int((chains.nth == 0).sum())
                sq += grad * grad
                value += rate * grad / np.sqrt(sq)
    model.tables = [t.astype(np.float32) for t in model.tables]
    return model


def word_posteriors(model: Model, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, posteriors by language) of all words of a slice."""
    data = LOWER[part.data]
    starts, ends = word_spans(part, LETTERS)
    if not len(starts):
        return starts, ends, np.zeros((0, len(model.languages)))
    hashes = word_hashes(data, starts, ends)
    kinds, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    scores = word_scores(model, word_features(data, starts[first], ends[first], kinds), len(kinds))[kind]
    return starts, ends, forward_backward(scores, sentences(part, starts), model.transitions)


def predict_slice(model: Model, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, number of words) of each text of a slice."""
    starts, _, post = word_posteriors(model, part)
    count = word_counts(part, starts)
    words = np.diff(count)
    if not len(starts):
        return np.zeros(len(part), np.int64), np.zeros(len(part)), words
    total = np.zeros((len(starts) + 1, post.shape[1]))
    np.cumsum(post, 0, out=total[1:])
    sums = total[count[1:]] - total[count[:-1]]
    best = sums.argmax(1)
    return best, np.clip(sums[np.arange(len(part)), best] / np.maximum(words, 1), 0.0, 1.0), words


def fit(labelled: DataFrame, per_language: int = 300, max_chars: int = 20_000) -> Model | None:
    """Train on a bounded sample of `labelled` (doc_id, text, lang): about
    `per_language` documents of each language with 1 to `max_chars` characters,
    taken by a hash of the id. None if there is nothing to learn from."""
    rows = labelled.select(F.col("doc_id").cast("string").alias("id"), F.col("text"), F.col("lang")).where(
        F.col("lang").isNotNull() & F.col("id").isNotNull() & F.length("text").between(1, max_chars))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (draw < per_language / n))
    sample = rows.where(chosen).select("text", "lang", F.xxhash64("id").alias("k")).orderBy("k", "text").limit(2 * per_language * len(counts))
    got = sample.collect()
    return train([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with any columns, among them text -> the same rows with lang_pred
    and score added. A null text, or one without a letter, is `und` with score
    0, as is every text if there is no model."""
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where)
            langs, scores = [], []
            for part in slices(texts):
                if model is None:
                    langs += [UNDETERMINED] * len(part)
                    scores.append(np.zeros(len(part)))
                    continue
                best, score, words = predict_slice(model, part)
                # words of non-ASCII bytes alone may be signs without any letter
                ascii_letters = np.concatenate([[0], np.cumsum(LETTERS[part.data] & (part.data < 128))])
                has = np.diff(ascii_letters[part.bounds]) > 0
                for i in np.flatnonzero(~has & (words > 0)):
                    raw = bytes(part.data[part.bounds[i]:part.bounds[i + 1]])
                    has[i] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
                langs += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has)]
                scores.append(np.where(has, score, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
                names=[*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with any columns, among them text -> the same rows with `words`
    added: an array of (start, length, lang, p) for each word, places in code
    points from 0, p the posterior of its language. Null texts have no words."""
    kept = [f for f in docs.schema.fields if f.name != "words"]
    names = [f.name for f in kept]
    where = names.index("text")
    kind = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(where)):
                starts, ends, post = word_posteriors(model, part)
                chars = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])      # code points before each byte
                text = np.searchsorted(part.bounds, starts, "right") - 1
                best = post.argmax(1)
                words = pa.StructArray.from_arrays([
                    pa.array((chars[starts] - chars[part.bounds[text]]).astype(np.int32)), pa.array((chars[ends] - chars[starts]).astype(np.int32)),
                    pa.array([model.languages[k] for k in best], pa.string()), pa.array(post[np.arange(len(best)), best])], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(word_counts(part, starts).astype(np.int32)), words)
                own = batch.slice(part.rows.start, part.rows.stop - part.rows.start)
                yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*names, "words"])

    schema = docs.select(*names).schema.add("words", ArrayType(
        StructType().add("start", "integer").add("length", "integer").add("lang", "string").add("p", "double")))
    return docs.select(*names).mapInArrow(run, schema)
