"""Trained operators, mixing, chat formatting: brute force, exact round trips,
normalisation and held-out accuracy."""

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import counts, frame, plain, rows
from logweave.llm import bytewords, chat, katz, katz_corpus, langid, mixing, toxicity
from logweave.llm.common import Scratch

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then walks home through the green fields with all of its friends",
    "de": "der schnelle braune fuchs springt ueber den faulen hund und geht dann durch die gruenen felder nach hause mit freunden",
    "es": "el rapido zorro marron salta sobre el perro perezoso y luego camina por los campos verdes hacia su casa con amigos",
}


def language_rows(n=40, seed=5):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        lang = list(SAMPLES)[i % 3]
        words = SAMPLES[lang].split()
        out.append((i, " ".join(rng.choice(words, 25)) + ".\n" + " ".join(rng.choice(words, 9)), lang))
    return out


# --- bytes to words

def test_words_and_hashes():
    texts = ["Ab cd\x0b\tab", None, "", " x ", "é日 é", "ab"] * 3
    for limit in (1, 7, 1 << 20):
        hashed = {}
        parts = list(bytewords.slices(pa.array(texts).slice(1), limit))
        got = []
        for part in parts:
            starts, ends = bytewords.word_spans(part, bytewords.NOT_SPACE)
            count = bytewords.word_counts(part, starts)
            h = bytewords.word_hashes(part.data, starts, ends)
            for a, b in zip(count[:-1], count[1:]):
                got.append([bytes(part.data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])])
                for w, x in zip(got[-1], h[a:b]):
                    assert hashed.setdefault(w, x) == x
        assert got == [(t or "").split() for t in texts[1:]]
        assert len(set(hashed.values())) == len(hashed)


# --- language ID

def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    scores, move = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    chains = langid.Chains(np.array([0, 5]), np.array([5, 2]), np.zeros(2, int), np.full(2, -1))
    post, expected = langid.forward_backward(scores, chains, move, True)
    want, pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for start, size in ((0, 5), (5, 2)):
        total, own, moves = 0.0, np.zeros((size, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=size):
            p = np.exp(sum(scores[start + t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                own[t, y] += p
            for a, b in zip(path, path[1:]):
                moves[a, b] += p
        want[start:start + size] = own / total
        pairs += moves / total
    assert np.allclose(post, want) and np.allclose(expected, pairs)


def test_languages(spark):
    data = language_rows(90)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 1 OR doc_id < 60"))
    other = language_rows(60, seed=9)
    out = langid.identify(spark.createDataFrame(other, "doc_id long, text string, lang string"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    mixed = SAMPLES["en"] + ". " + SAMPLES["de"] + "."
    odd = [(1, None), (2, ""), (3, "123 -- !!"), (4, "– … €"), (5, mixed), (6, (SAMPLES["es"] + " ") * 400)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and all(got[i].score == 0 for i in (1, 2, 3, 4))
    assert got[5].lang_pred in ("en", "de") and got[5].score < 0.75
    assert got[6].lang_pred == "es" and got[6].score > 0.9
    assert langid.fit(df.limit(0)) is None
    none = langid.identify(df, None)
    assert none.where("lang_pred <> 'und'").count() == 0 and none.count() == len(data)


def test_long_sentences_are_cut_not_dropped():
    texts = pa.array(["wort " * 1000])
    part = next(bytewords.slices(texts))
    starts, _ = bytewords.word_spans(part, bytewords.LETTERS)
    chains = langid.sentences(part, starts)
    assert chains.lens.sum() == 1000 and chains.lens.max() == langid.PIECE


def test_pieces_of_a_sentence_are_one_chain(monkeypatch):
    rng = np.random.default_rng(8)
    text = pa.array([" ".join("a" * n) + "\n" + " ".join("b" * m) for n, m in ((1, 23), (40, 7), (5, 5), (0, 64))])
    part = next(bytewords.slices(text))
    starts, _ = bytewords.word_spans(part, bytewords.LETTERS)
    scores, move = rng.normal(size=(len(starts), 3)) * 3, rng.normal(size=(3, 3)) * 2
    whole, moved = langid.forward_backward(scores, langid.sentences(part, starts), move, True)
    for size in (1, 2, 5, 7):
        monkeypatch.setattr(langid, "PIECE", size)
        chains = langid.sentences(part, starts)
        assert chains.lens.max() == size and (chains.before >= 0).any()
        post, expected = langid.forward_backward(scores, chains, move, True)
        assert np.allclose(post, whole) and np.allclose(expected, moved)


def test_words_of_code_switched_text(spark):
    rows = language_rows(240)
    model = langid.train([t for _, t, _ in rows], [lang for _, _, lang in rows])
    assert model.transitions.shape == (3, 3)
    left, right = "the quick brown fox jumps over", "durch die gruenen felder nach hause"
    texts = [f"\u00e9\u00e9 {left} {right}", None, "", "12 34"]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, starts int")
    got = {r.doc_id: r for r in langid.label_words(df, model).collect()}
    assert [list(got[k].words) for k in (1, 2, 3)] == [[], [], []] and got[0].starts == 0
    words = got[0].words
    assert [texts[0][w.start:w.start + w.length] for w in words] == texts[0].split()
    assert [w.lang for w in words[1:]] == ["en"] * 6 + ["de"] * 6
    assert all(1 / 3 <= w.p <= 1 for w in words)
    # the document's columns are sums over its words
    doc = langid.identify(df, model).where("doc_id = 0").first()
    share = sum(w.p for w in words if w.lang == doc.lang_pred)
    assert doc.lang_pred in ("en", "de") and share / len(words) <= doc.score + 1e-9


# --- toxicity

def toxic_rows(n, seed):
    rng, out = np.random.default_rng(seed), []
    words = [f"word{k}" for k in range(300)]
    for i in range(n):
        text = list(rng.choice(words, rng.integers(5, 80)))
        bad = i % 4 == 0
        if bad:
            text.insert(int(rng.integers(len(text))), f"badword{rng.integers(30)}")
        out.append((i, " ".join(text), int(bad), "en" if i % 2 else "de"))
    return out


def test_toxicity(spark):
    kind = "doc_id long, text string, toxic int, lang string"
    learn = spark.createDataFrame(toxic_rows(600, 1), kind)
    net = toxicity.fit(learn.select("doc_id", "text"), learn)
    test = spark.createDataFrame(toxic_rows(300, 2), kind)
    scored = toxicity.score(test, net)
    out = scored.collect()
    assert all(0 <= r.score <= 1 for r in out)
    assert np.mean([(r.score >= 0.3) == bool(r.toxic) for r in out]) > 0.95
    assert toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "..")], "doc_id long, text string"), net).select("score").distinct().count() == 1
    thresholds = {r.lang: r.threshold for r in toxicity.language_thresholds(scored.drop("text")).collect()}
    assert set(thresholds) == {"en", "de"} and all(0 <= t <= 1 for t in thresholds.values())
    right = {}
    for lang in thresholds:      # best F1 of all multiples of 0.01
        own = [r for r in out if r.lang == lang]
        f1 = lambda t: 2 * sum(r.toxic for r in own if r.score >= t) / max(1, sum(r.toxic for r in own) + sum(r.score >= t for r in own))
        right[lang] = f1(thresholds[lang]) >= max(f1(k / 100) for k in range(101)) - 1e-9
    assert all(right.values())
    assert toxicity.fit(test, test.where("toxic = 0")) is None
    assert toxicity.fit(test.limit(0), learn) is None
    assert toxicity.score(test, None).where("score <> 0").count() == 0
    assert toxicity.score(test.limit(0), net).count() == 0


def test_long_text_keeps_its_worst_phrase():
    data = toxic_rows(400, 3)
    net = toxicity.train([r[1] for r in data], [r[2] for r in data], 0.25)
    tables = toxicity.tabulate(net)
    clean = "word1 word2 word3 " * 30_000
    texts = pa.array([clean, clean + "badword3", "badword3 " + clean])
    got = np.concatenate([toxicity.scores(net, tables, p) for p in bytewords.slices(texts)])
    assert got[0] < 0.3 <= min(got[1:])


def test_scores_are_those_of_plain_loops():
    data = toxic_rows(60, 6)
    net = toxicity.train([r[1] for r in data], [r[2] for r in data], 0.25, epochs=2, least_steps=10)
    net.bias = net.bias + 0.05
    texts = [r[1] for r in data[:12]] + ["", "Word7", "word1 badword2", ". ,"]
    got = np.concatenate([toxicity.scores(net, toxicity.tabulate(net), p) for p in bytewords.slices(pa.array(texts))])
    for text, score in zip(texts, got):
        ids, _ = toxicity.buckets(next(bytewords.slices(pa.array([text]))))
        words = [[sum(float(net.embeddings[i][d]) for i in row) for d in range(toxicity.DIMENSIONS)] for row in ids]
        words += [[0.0] * toxicity.DIMENSIONS] * toxicity.PAD
        total = net.offset
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max(sum(words[at + j][d] * net.filters[k][j][d][f] for j in range(width) for d in range(toxicity.DIMENSIONS))
                           for at in range(len(ids)))
                total += max(best + net.bias[k * toxicity.FILTERS + f], 0) * net.weights[k * toxicity.FILTERS + f]
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-5)


def test_rows_kept_back_are_not_trained_on(spark):
    data = toxic_rows(300, 7)
    kind = "doc_id long, text string, toxic int, lang string"
    df = spark.createDataFrame(data, kind)
    back = {r.doc_id for r in df.where(toxicity.kept_back("doc_id")).collect()}
    assert 30 < len(back) < 90
    marked = spark.createDataFrame([(i, t + (" zzbackonly" if i in back else " zztrained"), y, lang) for i, t, y, lang in data], kind)
    net = toxicity.fit(marked.select("doc_id", "text"), marked)
    ids, _ = toxicity.buckets(next(bytewords.slices(pa.array(["zzbackonly zztrained"]))))
    assert not net.embeddings[ids[0, 0]].any() and net.embeddings[ids[1, 0]].any()


# --- Katz

def katz_model(spark, texts, **kw):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return katz.fit(Scratch(spark, "katz_test"), df, rounds=2, **kw)


def hash_of(word):
    part = next(bytewords.slices(pa.array([word])))
    starts, ends = bytewords.word_spans(part, bytewords.NOT_SPACE)
    return int(bytewords.word_hashes(bytewords.LOWER[part.data], starts, ends)[0])


def test_backoff_distributions_sum_to_one(spark):
    """The written tables, read back and followed by the recursion, sum to 1 over all words after any history."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{min(int(k), 60)}" for k in rng.zipf(1.4, rng.integers(1, 30))) for _ in range(120)]
    model, words = katz_model(spark, texts, word_share=1e-4)
    table = {r.key: r.c for r in words.collect()}
    single = {w: float(model.rare[min(c, katz.K + 1)] * c / model.total) for w, c in table.items()}
    assert abs(sum(single.values()) + 10 ** model.unseen - 1) < 1e-9
    of = lambda df, *cols: {r[0]: r[1] for r in df.select(*cols).collect()}
    parts = [of(part, "key", "p") for part in model.tables.triples]
    assert sum(len(part) > 0 for part in parts) > 1
    pairs, triples = of(model.tables.all_pairs(), "key", "p"), {k: p for part in parts for k, p in part.items()}
    backs = [of(model.tables.words, "key", "back"), of(model.tables.all_pairs(), "key", "back")]

    def key(a, b):
        return int(katz.gram_keys(*(np.array([x], np.int64).view(np.uint64) for x in (a, b)))[0].astype(np.int64))

    def p(history, w):
        if not history:
            return single.get(w, 10 ** model.unseen)
        v = history[-1]
        lower = backs[0].get(v, 1.0) * p((), w) if key(v, w) not in pairs else pairs[key(v, w)]
        if len(history) == 1:
            return lower
        found = triples.get(key(key(history[0], v), key(v, w)))
        return backs[1].get(key(history[0], v), 1.0) * lower if found is None else found

    seen = [w for w in table if w != int(katz.END)]
    for history in [(), (seen[0],), (12345,), (seen[1], seen[0]), (seen[0], seen[0]), *((u, seen[2]) for u in seen[:9])]:
        assert abs(sum(p(history, w) for w in table) + p(history, 54321) - 1) < 1e-6


def test_katz_scores(spark):
    data = plain(rows())
    df = frame(spark, data)
    scratch = Scratch(spark, "katz_test")
    model, words = katz.fit(scratch, df.where("doc_id % 2 = 0"), word_share=1e-3, rounds=1)
    got = {r.doc_id: r for r in katz.score(scratch, df.select("doc_id", "did", "text"), model, words).collect()}
    lowered = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() + [None]
    seen = {}
    for r in data:
        if r["doc_id"] % 2 == 0:
            for w in lowered(r["text"]):
                seen[w] = seen.get(w, 0) + 1
    n, v = sum(seen.values()), len(seen)
    assert (model.total, model.distinct) == (n, v)
    for r in data:
        toks, out = lowered(r["text"]), got[r["doc_id"]]
        assert (out.n_tokens, out.n_known) == (len(toks), sum(w in seen for w in toks))
        assert abs(out.base_score - sum(np.log10((seen.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in toks)) < 1e-6
        assert out.score < 0
    # the same scores however many words are held in memory
    again, words = katz.fit(Scratch(spark, "katz_test"), df.where("doc_id % 2 = 0"), word_share=1e-6, rounds=3)
    other = {r.doc_id: r.score for r in katz.score(Scratch(spark, "katz_test"), df.select("doc_id", "text"), again, words).collect()}
    assert other.keys() == got.keys() and all(abs(other[k] - got[k].score) < 1e-6 for k in other)
    # columns of any name are the caller's own
    named = df.select("doc_id", "text", *(F.lit(7).alias(c) for c in ("lw_row", "rare", "toks", "kept", "base", "log", "a.b", "Score")))
    own = katz.score(Scratch(spark, "katz_test"), named, again, words)
    assert own.columns == ["doc_id", "lw_row", "rare", "toks", "kept", "base", "log", "a.b", "n_tokens", "n_known", "base_score", "score"]
    assert all(r["lw_row"] == r["a.b"] == 7 and abs(r.score - other[r.doc_id]) < 1e-6 for r in own.collect())
    empty = df.limit(0)
    nothing, words = katz.fit(Scratch(spark, "katz_test"), empty, rounds=1)
    assert katz.score(Scratch(spark, "katz_test"), empty.select("doc_id", "text"), nothing, words).count() == 0
    assert all(r.n_known == 0 and r.score <= 0 for r in katz.score(Scratch(spark, "katz_test"), df.select("text"), nothing, words).collect())


def test_discounts():
    d = katz.discounts({1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 40})
    assert d[0] == d[6] == 1 and all(0 < x < 1 for x in d[1:6])
    assert list(katz.discounts({})) == [1.0] * 7
    uneven = katz.discounts({1: 1000, 2: 900, 3: 10, 4: 90, 5: 60, 6: 70})
    assert all(0 < x <= 1 for x in uneven)


def brute_katz(train, texts):
    """log10 scores of Katz backoff over all words, pairs and triples."""
    grams = [counts([tuple(t[i:i + n]) for i in range(len(t) - n + 1)] for t in train) for n in (1, 2, 3)]
    d = [katz.discounts(counts([list(g.values())])) for g in grams]
    total = sum(grams[0].values())
    mass = [{g: c * f[min(c, katz.K + 1)] for g, c in by.items()} for by, f in zip(grams, d)]
    left = 1 - sum(mass[0].values()) / total
    scale = 1 if left > 1e-12 else total / (total + 1)
    left = left if left > 1e-12 else 1 / (total + 1)

    def p(gram):
        n = len(gram)
        if n == 1:
            return mass[0][gram] * scale / total if gram in grams[0] else left
        context = gram[:-1]
        after = [g for g in grams[n - 1] if g[:-1] == context]
        if not after:
            return p(gram[1:])
        held, of = sum(mass[n - 1][g] for g in after), grams[n - 2][context]
        norm = held + 1 if held > of * (1 - 1e-9) else of
        if gram in grams[n - 1]:
            return mass[n - 1][gram] / norm
        return (1 - held / norm) / max(1 - sum(p(g[1:]) for g in after), 1e-12) * p(gram[1:])

    return [sum(np.log10(p(tuple(t[max(0, i - 2):i + 1]))) for i in range(len(t))) for t in texts]


def test_katz_in_tables_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{min(int(k), 40)}" for k in rng.zipf(1.5, rng.integers(1, 20))) for _ in range(60)]
    others = ["", "w1", "w1 w2", "new", "w1 new w2 w1 w1", "w3 w39 w1 w1 w2 w2", *texts[:5]]
    scratch = Scratch(spark, "katz_test")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(others)], "doc_id long, text string").repartition(3)
    model, words = katz.fit(scratch, spark.createDataFrame([(t,) for t in texts], "text string"), rounds=2)
    got = {r.doc_id: r.score for r in katz.score(scratch, df, model, words).collect()}
    split = lambda ts: [[*t.split(), "<end>"] for t in ts]
    want = brute_katz(split(texts), split(others))
    assert all(abs(got[k] - s) < 1e-6 for k, s in enumerate(want))


def test_katz_keeps_rare_pairs_of_many_tokens(spark):
    # beyond 4 million tokens a share of 2.5e-7 left out what occurs once
    texts = ["x " * 100_000] * 50 + ["y z"]
    scratch = Scratch(spark, "katz_test")
    model, _ = katz.fit(scratch, spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), rounds=1)
    assert model.total > 4_000_000
    sizes = [spark.read.parquet(f"{scratch.root}/ngrams_{n}").count() for n in (1, 2, 3)]
    assert sizes == [4, 4, 3]       # x y z end; xx, x end, yz, z end; xxx, xx end, yz end


@pytest.mark.parametrize("settings", [{}, {"rounds": 2, "share": 300, "hot": 40}, {"rounds": 3, "share": 60, "hot": 4, "word_share": 0.02}])
def test_corpus_scores_are_those_of_the_tables(spark, settings):
    """In one go, with what is frequent gathered or spread, the scores of fit and score; and no table of n-grams is left."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{min(int(k), 50)}" for k in rng.zipf(1.5, rng.integers(0, 25))) for _ in range(90)]
    data = [(k if k % 7 else 5, None if k % 31 == 30 else t, None if k % 13 == 12 else k % 5 != 1) for k, t in enumerate([*texts, "new", "w1 new w1", texts[3]])]
    df = spark.createDataFrame(data, "doc_id long, text string, learn boolean").repartition(3)
    learned = df.where("learn").select("text")
    model, words = katz.fit(Scratch(spark, "katz_test"), learned, rounds=1)
    columns = ("n_tokens", "n_known", "base_score", "score")
    want = sorted(tuple(r) for r in katz.score(Scratch(spark, "katz_test"), df.select("doc_id", "text"), model, words).select("doc_id", *columns).collect())
    scratch = Scratch(spark, "katz_test")
    named = df.withColumns({c: F.lit(7) for c in ("lw_row", "toks", "kept", "size", "log", "bucket", "score")})
    out, total = katz_corpus.score_corpus(scratch, named, **settings)
    assert out.columns == ["doc_id", "lw_row", "toks", "kept", "size", "log", "bucket", *columns] and total == model.total
    got = sorted(tuple(r) for r in out.select("doc_id", *columns).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(x - y) < 1e-6 for a, b in zip(got, want) for x, y in zip(a[3:], b[3:]))
    assert all(scratch.bytes(name) > 0 for name in ("rows", "words", "logs"))
    for name in ("ngrams_1", "ngrams_2", "ngrams_3", "pairs"):
        with pytest.raises(Exception, match="(?i)not exist|no such"):
            scratch.bytes(name)
    # nothing to learn from, and nothing at all
    none, total = katz_corpus.score_corpus(Scratch(spark, "katz_test"), df.withColumn("learn", F.lit(False)), **settings)
    assert total == 0 and all(r.n_known == 0 and r.score <= 0 for r in none.collect())
    assert katz_corpus.score_corpus(Scratch(spark, "katz_test"), df.limit(0), **settings)[0].count() == 0


def test_gram_keys_are_those_of_spark(spark):
    a, b = np.array([1, 2 ** 63 + 5, 77], np.uint64), np.array([2 ** 64 - 1, 0, 9], np.uint64)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a.view(np.int64), b.view(np.int64))], "a long, b long")
    assert [r[0] for r in df.select(F.xxhash64("a", "b")).collect()] == list(katz.gram_keys(a, b).view(np.int64))


# --- mixing

def test_mix(spark):
    data = rows(n=200)
    targets = {"source": {"src0": 0.9, "src1": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {}}
    out = mixing.mix(frame(spark, data), targets, 0.5)
    got = out.collect()
    assert len(got) == len(data) and out.columns[-4:] == ["n_tokens", "topic", "p", "kept"]
    assert all(r.n_tokens == len((r.text or "").split()) or "É" in r.text for r in got)
    assert all(r.kept for r in got if r.p == 1.0)
    again = {(r.doc_id, r.text): r.kept for r in mixing.mix(frame(spark, data[::-1]), targets, 0.5).collect()}
    assert all(again[(r.doc_id, r.text)] == r.kept for r in got)
    assert mixing.mix(frame(spark, []), targets, 0.5).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(out, targets, 0)


def test_saturated_cells_leave_the_targets_met(spark):
    # raking alone asks for 120 of the 100 of (src0, de)
    targets = {"source": {"src0": 0.5, "src1": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 0.6, "short": 0.4}}
    sizes = {("src0", "de"): 100, ("src0", "en"): 1900, ("src1", "de"): 900, ("src1", "en"): 1100}
    cells = [(*c, topic, n * k) for c, n in sizes.items() for topic, k in (("prose", 6), ("short", 4))]
    factors, report = mixing.calibrate(cells, targets, 0.5)
    p = {c: min(1.0, factors["source"][c[0]] * factors["lang"][c[1]] * factors["topic"][c[2]]) for c in cells}
    assert any(x == 1.0 for x in p.values()) and all(0 < x <= 1 for x in p.values())
    kept = sum(p[c] * c[3] for c in cells)
    assert abs(kept - 20000) < 1e-3
    for k, d in enumerate(mixing.DIMENSIONS):
        for v, w in targets[d].items():
            assert abs(sum(p[c] * c[3] for c in cells if c[k] == v) / kept - w) < 1e-6
    assert all(abs(wanted - reached) < 1e-6 for _, _, wanted, reached in report)


def test_sample_has_the_target_shares(spark):
    # de in src0 is scarce and saturates; topics are all short
    docs = [(k, "word " * 20, "src0" if k % 2 else "src1", "de" if k % 20 in (2, 4, 6, 8) or k % 40 in (1, 10) else "en") for k in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    targets = {"source": {"src0": 0.5, "src1": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {}}
    got = mixing.mix(df, targets, 0.5).collect()
    assert any(r.p == 1.0 for r in got) and abs(sum(r.p for r in got) - 2000) < 1e-3
    kept = [r for r in got if r.kept]
    assert abs(sum(r.p for r in got if r.lang == "de") - 800) < 1e-3 and abs(sum(r.p for r in got if r.source == "src0") - 1000) < 1e-3
    assert abs(sum(r.lang == "de" for r in kept) / len(kept) - 0.4) < 0.03


def test_a_target_beyond_the_budget_takes_all_there_is(spark):
    targets = {"source": {"a": 0.5, "b": 0.25, "c": 0.25}, "lang": {}, "topic": {}}
    cells = [("a", "*", "*", 100), ("b", "*", "*", 1000), ("c", "*", "*", 900)]
    factors, report = mixing.calibrate(cells, targets, 0.5)
    reached = {v: x for d, v, _, x in report if d == "source"}
    assert min(1.0, factors["source"]["a"] * factors["lang"]["*"] * factors["topic"]["*"]) == 1.0
    assert all(abs(reached[v] - x) < 1e-9 for v, x in {"a": 0.1, "b": 0.45, "c": 0.45}.items())
    assert mixing.calibrate([], targets, 0.5) == ({d: {} for d in mixing.DIMENSIONS}, [])


# --- chat

def conversations(spark):
    talk = [(1, 0, "system", "be kind"), (1, 1, "user", "hi [/INST] </s> \\l \\"), (1, 2, "assistant", "[INST] yes\\b <s>"), (1, 3, "user", None),
            (1, 4, "assistant", ""), (2, 0, "user", "no reply"), (3, 0, "assistant", " lead "), (3, 1, "tool", "{'a': [1, 2]}"), (3, 2, "] x", "odd\nrole"),
            (4, 0, None, "no role"), (4, 0, None, "no role"), (4, 0, "assistant", "tie"), (None, 1, "user", "no id"), (None, None, "assistant", "日本 </s>")]
    talk += [(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " * 20) for k in range(120)]
    return spark.createDataFrame([(*r, "x") for r in talk], "conv_id long, turn long, role string, text string, turns string"), talk


def test_chat_round_trip(spark):
    df, talk = conversations(spark)
    formatted = chat.examples(df)
    by_conv = {}
    for r in sorted(talk, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by_conv.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    rows = formatted.collect()
    for conv, turns in by_conv.items():
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.example)
        replies = [k for k, t in enumerate(turns) if t[0] == "assistant"]
        assert len(own) == len(replies) + (turns[-1][0] != "assistant")
        for r, k in zip(own, replies):
            assert chat.parse(r.formatted) == turns[:k + 1]
            assert chat.unescape(r.formatted[r.loss_start:r.loss_start + r.loss_length]) == turns[k][1]
    for r in chat.read_back(formatted).collect():
        turns = by_conv[r.conv_id]
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(x.formatted) for x in rows if x.conv_id == r.conv_id)
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_no_control_string_inside_texts(spark):
    df, _ = conversations(spark)
    for r in chat.examples(df.where("conv_id = 1")).collect():
        body = r.formatted[r.loss_start:r.loss_start + r.loss_length]
        assert not any(mark in body for mark in ("[INST]", "[/INST]", "</s>", "<s>", "[SYS]", "[ROLE"))


def test_katz_tokens_are_dealt_to_their_rounds():
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    vocab = np.unique(rng.integers(2, 1 << 64, 50, np.uint64))
    texts = [np.append(rng.choice(vocab, n), katz.END) for n in [0, 1, 2, 40, 0, 300]]
    rows = np.arange(6) + (2 << 33)
    learn = np.array([1, 0, 1, 1, 0, 0], bool)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array(learn), pa.array([t.tobytes() for t in texts], pa.binary())], names=["lw_row", "learn", "toks"])
    words, none = vocab[::2].copy(), np.zeros(0, np.uint64)
    first = np.append(np.searchsorted(words >> np.uint64(56), np.arange(256, dtype=np.uint64)), len(words))
    level = katz_corpus.Level(np.ones(7), none, np.zeros(0), np.zeros(0), none, none, np.zeros(0, np.int64))
    corpus = katz_corpus.Corpus(words, np.arange(len(words)) + 9, np.ones(7), 1e-9, 100, 50, 3, 8, first, level, level)
    want = []
    for row, own, text in zip(rows.tolist(), learn, texts):
        full = [*bytewords.mix(np.array([2 * row, 2 * row + 1], np.uint64)), *text]
        for i in range(2, len(full)):
            at = np.flatnonzero(words == full[i])
            want.append((row, *map(int, full[i - 2:i + 1]), int(at[0]) + 9 if len(at) else 0, int(own) * [0, 1, 3][min(i - 2, 2)]))
    for rounds in (1, 3, 7):
        got = []
        for k in range(rounds):
            for known in (True, False):
                for b in katz_corpus._entries(SimpleNamespace(value=corpus.plain()), k, known, rounds)(iter([batch])):
                    row, u, v, w, c, n = katz_corpus._flat(pa.Table.from_batches([b]), *katz_corpus._names(katz_corpus._TOKENS))
                    assert all(int(x) * rounds >> 64 == k for x in v) and all((x > 0) == known for x in c)
                    got += zip(*(x.tolist() for x in (row, u, v, w, c, n)))
        assert sorted(got) == sorted(want)
