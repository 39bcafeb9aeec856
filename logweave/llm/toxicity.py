"""Toxicity scores from a convolutional text classifier.

A word's embedding is the sum of hashed ones: of the word and of its first
five and four bytes, so an unseen form of a known stem is not lost. Filters of several widths slide over a
text; the largest response of each filter anywhere in the text (max pooling)
feeds a logistic output, so one phrase decides however long the text is. The
network is trained in numpy on a bounded sample of labelled documents
(`per_label` of each label, chosen by a hash of the id, of at most `max_chars`
characters); the output is shifted from the sample's to the labelled rows' share
of toxic documents. Scoring is one narrow pass over whole texts: the product of
every embedding with every filter column is tabulated once, so a response is a
sum of table rows.

`language_thresholds` calibrates decisions by language: the threshold with the
best F1 on labelled rows; give it the rows that are `kept_back` from training.
The language is no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.bytewords import LETTERS, LOWER, Slice, slices, word_counts, word_hashes, word_spans

#: Bits of the hash tables of embeddings: whole words, and beginnings of so many bytes.
BITS = (18, 16, 16)
BEGINNINGS = (5, 4)
WIDTHS = (1, 2, 3)
FILTERS = 4
DIMENSIONS = 8
#: Empty places after each text, so that every filter fits; embedding 0.
PAD = max(WIDTHS) - 1
#: The tables lie one after the other; the last row is the pad.
FIRST = [sum(1 << b for b in BITS[:k]) for k in range(len(BITS))]
ROWS = sum(1 << b for b in BITS)


@dataclass
class Network:
    embeddings: np.ndarray          # ROWS + 1, DIMENSIONS
    filters: list[np.ndarray]       # for each width: width, DIMENSIONS, FILTERS
    bias: np.ndarray                # of all filters
    weights: np.ndarray
    offset: float


def buckets(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embeddings of each word of a slice (one column a table), each
    text followed by PAD pads; and the place of each text's first."""
    data = LOWER[part.data]
    starts, ends = word_spans(part, LETTERS)
    count = word_counts(part, starts)
    ids = np.empty((len(starts), len(BITS)), np.int32)
    for k, bits in enumerate(BITS):
        stops = ends if k == 0 else np.minimum(ends, starts + BEGINNINGS[k - 1])
        ids[:, k] = (word_hashes(data, starts, stops) >> np.uint64(64 - bits)).astype(np.int32) + FIRST[k]
    return np.insert(ids, np.repeat(count[1:], PAD), ROWS, axis=0), count[:-1] + PAD * np.arange(len(part))


def _responses(tables: list[list[np.ndarray]], ids: np.ndarray) -> list[np.ndarray]:
    """For each width the filters' responses at every place; what is beyond a
    text's end counts as pads, so a filter that begins at a pad answers 0 and
    sees nothing of the next text."""
    look = lambda table, rows: sum(table[rows[:, k]] for k in range(rows.shape[1]))
    out = []
    for columns in tables:
        total = look(columns[0], ids)
        for j, column in enumerate(columns[1:], 1):
            total[:-j] += look(column, ids[j:])
        total[ids[:, 0] == ROWS] = 0
        out.append(total)
    return out


def tabulate(net: Network) -> list[list[np.ndarray]]:
    return [[(net.embeddings @ w[j]).astype(np.float32) for j in range(len(w))] for w in net.filters]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scores(net: Network, tables: list[list[np.ndarray]], part: Slice) -> np.ndarray:
    ids, first = buckets(part)
    if not len(first):
        return np.zeros(0)
    pooled = np.concatenate([np.maximum.reduceat(r, first, axis=0) for r in _responses(tables, ids)], 1)
    return _sigmoid(np.maximum(pooled + net.bias, 0) @ net.weights + net.offset)


def _log_odds(parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Shrunken log odds of a toxic label for the texts that hold each bucket."""
    seen = np.zeros((2, ROWS + 1))
    for (ids, first), own in zip(parts, labels):
        text = np.searchsorted(first, np.arange(len(ids)), "right") - 1
        pair = np.unique((text * (ROWS + 1))[:, None] + ids)
        np.add.at(seen, (own[pair // (ROWS + 1)], pair % (ROWS + 1)), 1)
    n = [max(1, sum(int((own == k).sum()) for own in labels)) for k in (0, 1)]
    z = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    z *= seen.sum(0) / (seen.sum(0) + 4)
    z[ROWS] = 0
    return z


def _calibration(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale (at least 0) and offset of a logistic fit of y on x by damped
    Newton steps, with a weak pull of the scale towards 1."""
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = _sigmoid(a @ w)
        grad = a.T @ (p - y) + np.array([w[0] - 1, 1e-3 * w[1]])
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1.0, 1e-3])
        w = w - np.clip(np.linalg.solve(curve + 1e-9 * np.eye(2), grad), -1, 1)
    return max(float(w[0]), 0.0), float(w[1])


def train(texts: list[str], labels: list[int], share: float, epochs: int = 6, least_steps: int = 600, batch_bytes: int = 1 << 16,
          rate: float = 0.02, back: list[bool] | None = None) -> Network:
    """Fit the network by Adagrad on the mean logistic loss; deterministic.

    The texts marked in `back` (by default a fifth) are kept back to calibrate
    the output, if there are ten of each label at least; `share` is the
    share of label 1 it is calibrated to. The first embedding dimension starts
    from the buckets' log odds, the first filter of every width looks at it.
    Small samples are gone through more often, for `least_steps` steps."""
    rng = np.random.default_rng(11)
    net = Network(np.zeros((ROWS + 1, DIMENSIONS)), [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)) for w in WIDTHS],
                  np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.1, len(WIDTHS) * FILTERS), 0.0)
    order = rng.permutation(len(texts))
    gold = np.array([labels[i] for i in order], np.int64)
    if back is not None:
        order = np.array(sorted(order, key=lambda i: not back[i]), order.dtype)     # in place, those kept back first
        gold = np.array([labels[i] for i in order], np.int64)
    held = len(order) // 5 if back is None else sum(back)
    if min(gold.sum(), len(gold) - gold.sum()) < 10 or len(set(gold[held:])) < 2:
        held = 0
    held_texts, held_gold = pa.array([texts[i] for i in order[:held]], pa.string()), gold[:held]
    order, drawn, gold = order[held:], gold.mean(), gold[held:]
    cut = list(slices(pa.array([texts[i] for i in order], pa.string()), batch_bytes))
    epochs = max(epochs, min(30, -(-least_steps // max(len(cut), 1))))
    parts, own = [buckets(p) for p in cut], [gold[p.rows] for p in cut]
    net.embeddings[:, 0] = _log_odds(parts, own)
    for k in range(len(WIDTHS)):
        net.filters[k][:, :, 0] = 0
        net.filters[k][:, 0, 0] = 1
        net.weights[k * FILTERS] = 1
    past = [np.full_like(p, 1e-3) for p in (net.embeddings, *net.filters, net.bias, net.weights)]
    past_offset = 1e-3
    for _ in range(epochs):
        for (ids, first), y in zip(parts, own):
            ends, pads = np.append(first[1:], len(ids)), ids[:, 0] == ROWS
            padded = np.concatenate([ids, np.full((PAD, ids.shape[1]), ROWS, ids.dtype)])
            x = sum(net.embeddings[padded[:, k]] for k in range(len(BITS)))
            best, pooled = [], []
            for w in net.filters:
                r = sum(x[j:j + len(ids)] @ w[j] for j in range(len(w)))
                r[pads] = 0
                at = np.stack([a + r[a:b].argmax(0) for a, b in zip(first, ends)])
                best.append(at)
                pooled.append(np.take_along_axis(r, at, 0))
            raw = np.concatenate(pooled, 1) + net.bias
            feats = np.maximum(raw, 0)
            error = (_sigmoid(feats @ net.weights + net.offset) - y) / len(y)
            down = np.outer(error, net.weights) * (raw > 0)
            grads_w, rows, values = [], [], []
            for k, w in enumerate(net.filters):
                at = best[k]
                g = down[:, k * FILTERS:(k + 1) * FILTERS] * ~pads[at]
                gw = np.empty_like(w)
                for j in range(len(w)):
                    gw[j] = np.einsum("tf,tfd->df", g, x[at + j])
                    part = (g[:, :, None] * w[j].T[None]).reshape(-1, DIMENSIONS)
                    for channel in range(len(BITS)):
                        rows.append(padded[at + j, channel].ravel())
                        values.append(part)
                grads_w.append(gw)
            touched, place = np.unique(np.concatenate(rows), return_inverse=True)
            ge = np.zeros((len(touched), DIMENSIONS))
            np.add.at(ge, place, np.concatenate(values))
            ge[touched == ROWS] = 0
            past[0][touched] += ge * ge
            net.embeddings[touched] -= rate * ge / np.sqrt(past[0][touched])
            for p, g, s in zip((*net.filters, net.bias, net.weights), (*grads_w, down.sum(0), feats.T @ error), past[1:]):
                s += g * g
                p -= rate * g / np.sqrt(s)
            past_offset += error.sum() ** 2
            net.offset -= rate * error.sum() / np.sqrt(past_offset)
    if held and 0 < held_gold.mean() < 1:
        tables = tabulate(net)
        p = np.concatenate([scores(net, tables, part) for part in slices(held_texts)])
        scale, offset = _calibration(np.log(np.maximum(p, 1e-12)) - np.log(np.maximum(1 - p, 1e-12)), held_gold)
        net.weights, net.offset = net.weights * scale, net.offset * scale + offset
    if 0 < drawn < 1 and 0 < share < 1:
        net.offset += float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return net


def kept_back(doc_id: Column | str) -> Column:
    """Whether a row is one of the fifth, by a hash of the id, that `fit` does
    not train on (where ten rows of each label are in its sample)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("kept back")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, max_chars: int = 20_000) -> Network | None:
    """Train on a bounded sample: about `per_label` rows of each label of
    `labels` (doc_id, toxic 0/1; one row an id), taken by a hash of the id, and
    their texts of at most `max_chars` characters in `docs` (doc_id, text);
    those `kept_back` only calibrate the output.
    None unless both labels occur."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = F.lit(False)
    for label, n in sorted(counts.items()):
        chosen = chosen | ((F.col("toxic") == label) & (F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < per_label / n))
    sample = F.broadcast(labels.where(chosen).limit(4 * per_label))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    got = texts.join(sample, "doc_id").select("text", "toxic", order.alias("k"), kept_back("doc_id").alias("back")).orderBy("k", "text").limit(4 * per_label).collect()
    if len({r["toxic"] for r in got}) < 2:
        return None
    return train([r["text"] for r in got], [r["toxic"] for r in got], counts[1] / (counts[0] + counts[1]),
                 back=[r["back"] for r in got])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """`docs` (text, any other columns) -> the other columns and score (0 to 1;
    0 for all without a network). A null text scores as an empty one."""
    others = [c for c in docs.columns if c not in ("text", "score")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others) + ", score double"
    held = None if net is None else docs.sparkSession.sparkContext.broadcast(tabulate(net))
    head = None if net is None else Network(np.zeros((0, 0)), [], net.bias, net.weights, net.offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            got = [np.zeros(0)] + [np.zeros(len(p)) if head is None else scores(head, held.value, p) for p in slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(got))], names=[*others, "score"])

    return docs.select(*others, F.col("text").cast("string")).mapInArrow(run, schema)


def language_thresholds(scored: DataFrame, default: float = 0.3, steps: int = 100) -> DataFrame:
    """`scored` (lang, toxic, score) -> (lang, threshold): for each language the
    multiple of 1 / steps with the best F1, the one nearest `default` among
    equals; `default` itself where no row is toxic."""
    bins = scored.select("lang", F.floor(F.col("score") * steps).cast("int").alias("bin"), "toxic").groupBy("lang", "bin").agg(
        F.sum(F.col("toxic")).alias("hit"), F.sum(1 - F.col("toxic")).alias("miss"))
    down = W.partitionBy("lang").orderBy(F.desc("bin"))     # at most steps + 1 rows for a language
    f1 = bins.select("lang", "bin", F.sum("hit").over(down).alias("tp"), F.sum("miss").over(down).alias("fp"),
                     F.sum("hit").over(W.partitionBy("lang")).alias("all")).withColumn(
        "f1", 2 * F.col("tp") / F.greatest(F.col("all") + F.col("tp") + F.col("fp"), F.lit(1)))
    best = f1.groupBy("lang").agg(F.max(F.struct("f1", (-F.abs(F.col("bin") / steps - default)).alias("near"), "bin")).alias("b"), F.max("all").alias("all"))
    return best.select("lang", F.when(F.col("all") > 0, F.col("b.bin") / steps).otherwise(F.lit(default)).alias("threshold"))
