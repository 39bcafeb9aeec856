"""Vector codes, packing and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from helpers import frame, rows
from logweave.llm import packing, spelling, vector_codes
from logweave.llm.common import Scratch
from logweave.llm.queries import QUERIES, TOKENIZER
from logweave.session import table

# ---------------------------------------------------------------- vector codes


def test_nearest_entry_is_exact():
    rng = np.random.default_rng(5)
    for size, d, spread in [(64, 4, 3), (64, 4, 300), (7, 1, 4), (1, 3, 9), (256, 2, 2)]:
        points = rng.integers(-spread, spread + 1, (50, 5, d))
        books = rng.integers(-spread, spread + 1, (5, size, d))
        index, dist = vector_codes.nearest(points, books)
        every = ((points[:, :, None, :] - books[None]) ** 2).sum(-1)
        assert (index == every.argmin(-1)).all() and (dist == every.min(-1)).all()


def codes_by_brute_force(data, parts, entries, rounds):
    """{(id, vector): (code, error)} of (id, vector) rows that can be coded."""
    ints = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in data]
    order = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * d:(p + 1) * d]
    books = [[cut(v, p) for _, v in order[:entries]] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, v in ints:
            for p in range(parts):
                held[p][near(cut(v, p), p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(h) for c in zip(*h)] if h else e for e, h in zip(books[p], held[p])] for p in range(parts)]
    out = []
    for i, v in ints:
        found = [near(cut(v, p), p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(x for x, _ in found)))
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int, code string, n long, length string, cell int"


def vector_rows(seed=2, n=90, dim=12):
    rng = random.Random(seed)
    good = [(rng.choice([None, *range(40)]), [rng.choice([0.0, -0.0039, 0.01, -1.5, rng.gauss(0, 1)]) for _ in range(dim)], rng.choice([None, 1, 2])) for _ in range(n)]
    good += [good[-1], good[-1]]                                   # a row three times
    dropped = [(1, None, 1), (2, [float("nan")] * dim, 1), (3, [0.5] * (dim - 1) + [float("inf")], None), (4, [None] + [0.1] * (dim - 1), 2)]
    uncoded = [(5, [0.1] * 4, 1), (6, [], 7), (7, [3e37] * dim, 7)]
    return good, dropped, uncoded


def test_codes_of_awkward_vectors(spark):
    good, dropped, uncoded = vector_rows()
    data = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in good + dropped + uncoded], VECTORS).repartition(5)
    out, books = vector_codes.compress(data, parts=4, entries=8, rounds=2)
    exact = [(r.vec_id, list(r.embedding)) for r in data.collect() if r.embedding and len(r.embedding) == 12 and all(x is not None and abs(x) < 1e9 for x in r.embedding)]
    want, want_books = codes_by_brute_force(exact, 4, 8, 2)
    got = out.collect()
    assert books.entries.tolist() == want_books
    assert Counter((r.vec_id, r.code, r.error) for r in got if r.code) == Counter(want)
    assert sorted(r.vec_id for r in got if r.code is None) == [5, 6, 7]
    assert all(r.error is None for r in got if r.code is None)
    for label in (None, 1, 2, 7):
        mine = [r for r in got if r.label == label]
        errors = [r.error for r in mine if r.error is not None]
        assert {r.label_error for r in mine} == {sum(errors) if errors else None}
    decode = vector_codes.decoder(books)
    assert all(len(decode(r.code)) == 12 for r in got if r.code)


def test_codes_of_few_and_no_vectors(spark):
    good, dropped, _ = vector_rows(n=3)
    few = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in good[:3]], VECTORS)
    out, books = vector_codes.compress(few, parts=3, entries=64, rounds=1)
    assert books.entries.shape == (3, 3, 4) and out.count() == 3
    for none in (few.limit(0), spark.createDataFrame([(*r, "x", 1, "y", 2) for r in dropped], VECTORS)):
        out, books = vector_codes.compress(none)
        assert out.count() == 0 and books.entries.size == 0
    out, _ = vector_codes.compress(few, parts=5)                  # 12 components make no 5 equal parts
    assert [r.code for r in out.collect()] == [None] * 3


# -------------------------------------------------------------------- packing

ODD = ["", " ", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "it's we'll  don't", "x\x00\x1c\x1d\x85 　y", "日本語 テスト\n\n  \t x", "12345 ½ ² Ⅷ 漢",
       "퟿\U0001f600👩‍👩‍👧 é ﬁ", " " * 3000 + "x", "a" * 3000, "\r\n" * 50, "!?" * 500, "​᠎﻿"]


@pytest.fixture(scope="module")
def tokenizer():
    with open(TOKENIZER, "rb") as f:
        return f.read()


def test_encoder_equals_the_tokenizer_file(spark, tokenizer, monkeypatch):
    encode, whole = packing.encoder(tokenizer), Tokenizer.from_file(TOKENIZER)
    every = ["".join(map(chr, range(a, a + 64))) + " " + " ".join(map(chr, range(a, a + 64))) for a in [*range(0, 0xD800, 64), *range(0xE000, 0x20000, 64)]]
    texts = ODD + every + [r.text for r in table(spark, SF_SMALL, "documents").where("text IS NOT NULL").collect()]
    for text in texts:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]
    monkeypatch.setattr(packing, "PIECE_CHARS", 50)
    for text in texts:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_encoder_beyond_the_pattern_engine(tokenizer):
    text = " " * 1_500_000 + "x"
    assert packing.encoder(tokenizer)(text).tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_other_tokenizers_take_their_own_file():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        encode = packing.encoder(f.read())
    for text in ODD[:6]:
        assert encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing():
    rng = random.Random(1)
    for n in [1, 2, 3, 17, 64, 200]:
        lengths = [rng.choice([1, 5, 50, 99, 100, rng.randrange(1, 101)]) for _ in range(n)]
        bins, free = [], []
        for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
            at = next((b for b, f in enumerate(free) if f >= lengths[i]), len(bins))
            if at == len(bins):
                bins.append([])
                free.append(100)
            bins[at].append(i)
            free[at] -= lengths[i]
        assert packing.first_fit_decreasing(lengths, 100) == bins
        spans = packing.without_gaps(bins, lengths, 100)
        ids = sorted((i, k) for b in spans for i, first, size in b for k in range(first, first + size))
        assert ids == [(i, k) for i in range(n) for k in range(lengths[i])]
        sizes = [sum(s for _, _, s in b) for b in spans]
        assert all(s == 100 or s & (s - 1) == 0 for s in sizes) and sizes.count(100) == sum(lengths) // 100
    with pytest.raises(ValueError):
        packing.FreeSpace(1, 10).place(11)


def check_packed(pieces, texts, length):
    """Pieces hold every document's ids once, sequences have no gaps."""
    whole = Tokenizer.from_file(TOKENIZER)
    assert all(r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *[r.length for r in rs]])[:-1].tolist()
        total = sum(r.length for r in rs)
        assert total == length or total < length and total & (total - 1) == 0
    want = Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in texts)
    # of rows with one id, pieces are told apart by their document's size and content
    for (i, ids), times in want.items():
        mine = [r for r in pieces if r.doc_id == i and r.doc_tokens == len(ids)]
        same = [r for r in mine if tuple(np.frombuffer(r.ids, "<u4").tolist()) == ids[r.start:r.start + r.length]]
        covered = Counter(k for r in same for k in range(r.start, r.start + r.length))
        assert set(covered) == set(range(len(ids))) and min(covered.values()) >= times
    assert sum(r.length for r in pieces) == sum(len(ids) * n for (_, ids), n in want.items())


def test_packing_round_trip(spark, tokenizer):
    data = rows() + [{**rows()[8], "doc_id": 1000 + i, "text": t} for i, t in enumerate(ODD)]
    docs = frame(spark, data)
    for length, group in [(2048, 4096), (64, 10), (1, 5)]:
        some = docs.where("doc_id % 7 = 0 OR doc_id IS NULL") if length == 1 else docs
        pieces = packing.pack(some, tokenizer, length=length, group_docs=group, keep_ids=True).collect()
        check_packed(pieces, [(r.doc_id, r.text) for r in some.collect()], length)
    assert packing.pack(docs.limit(0), tokenizer).count() == 0


def test_packing_query(spark):
    out = QUERIES["op12_packing"](spark, SF_SMALL).collect()
    docs = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    assert {r.doc_id for r in out} == set(docs)
    whole = Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    assert all(r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) for r in out)
    assert sum(r.length for r in out) == sum(map(len, ids.values()))


# ------------------------------------------------------------------- spelling


def counts_by_brute_force(docs, min_length=6, min_count=5):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_brute_force(words, ratio=5):
    form, n_near = {}, {}
    for w, n in words.items():
        around = [v for v in words if v != w and near(v, w)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w], n_near[w] = best if best is not None and words[best] >= ratio * n else None, len(around)

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items()}


def test_variants_of_small_alphabets(spark):
    rng = random.Random(4)
    for letters, size in [("ab", 6), ("aé", 5), ("abcÿ", 4)]:
        words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, size + 1))): rng.choice([1, 4, 5, 24, 25, 26, 700, 20000]) for _ in range(60)}
        frame_ = spark.createDataFrame([*words.items(), (None, 3), ("", 9)], "word string, n long")
        assert {tuple(r) for r in spelling.variants(frame_).collect()} == variants_by_brute_force(words)


def test_near_pairs_come_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaabaaa", "baaaaaa", "aabaaa", "zzzzzz"]
    got = spelling.near_words(Scratch(spark, "t"), spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    assert Counter((r.word, r.near) for r in got) == Counter((a, b) for a in words for b in words if near(a, b))


def test_word_counts_of_awkward_rows(spark):
    data = rows() + [{**rows()[8], "doc_id": 500 + i, "text": "Straße ÀÉÎõü Àéîõü naïveté×naïveté ÷ " * 40 + "x" * 5000} for i in range(30)]
    for t in (data, data[:0]):
        got = {r.word: r.n for r in spelling.word_counts(frame(spark, t)).collect()}
        assert got == counts_by_brute_force([(r["doc_id"], r["text"]) for r in t])
    assert spelling.variants(spelling.word_counts(frame(spark, data[:0]))).count() == 0


def test_spelling_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    got = QUERIES["op13_spelling"](spark, SF_SMALL)
    assert {tuple(r) for r in got.collect()} == variants_by_brute_force(counts_by_brute_force(docs))
    assert got.where(F.col("form").isNotNull()).count() > 0
