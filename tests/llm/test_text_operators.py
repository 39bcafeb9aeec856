"""Operators on texts against brute force, with awkward rows and empty tables."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import components, frame, later_lines, plain, repeated_windows, rows
from logweave.llm import common, fingerprints, line_dedup, simhash, substring_dedup, winnow
from logweave.llm.common import doc_order


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return frame(spark, data).cache()


@pytest.fixture(scope="module")
def unique(spark, data):
    return frame(spark, plain(data)).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


# --- substring dedup

@pytest.mark.parametrize("window", [2, 9, 50])
def test_substrings(unique, data, window):
    want = repeated_windows(plain(data), window)
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.remove_repeated(unique, window).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert sum(v[1] for v in got.values()) > 0


def test_substring_levels():
    assert substring_dedup.levels(50) == [13, 25, 50]
    assert substring_dedup.levels(2) == [2]
    for window in (17, 64, 100):
        sizes = substring_dedup.levels(window)
        assert sizes[-1] == window and all(b <= 2 * a for a, b in zip(sizes, sizes[1:]))


def test_selected_windows_agree_in_equal_runs():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 30, 400).astype(np.uint64)
    for run in (1, 2, 7, 38):
        places = set(substring_dedup.selected(values, run).tolist())
        for a in range(len(values) - run + 1):
            low = values[a:a + run].min()
            assert {a + i for i in range(run) if values[a + i] == low} <= places


def test_substrings_awkward(docs, empty, data):
    out = substring_dedup.remove_repeated(docs, 50)
    assert out.count() == len(data)
    assert out.where("text IS NULL").count() == 0
    assert substring_dedup.remove_repeated(empty, 50).count() == 0


# --- line dedup

@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_lines(unique, data, threshold):
    got = {(r.did, r.line) for r in line_dedup.later_lines(unique, threshold, 5).collect()}
    assert got == later_lines(plain(data), threshold, 5) and got


def test_dense_group_needs_no_second_partner(spark):
    base = [f"w{i}" for i in range(40)]
    lines = [" ".join(base[:k] + [f"x{k}"] + base[k + 1:]) for k in range(40)]
    data = [{"doc_id": k, "text": t} for k, t in enumerate(lines)]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in data], "doc_id long, text string")
    assert {(r.did, r.line) for r in line_dedup.later_lines(df, 0.8, 5).collect()} == later_lines(data)


def test_lines_removed_from_texts(docs, unique, data, empty):
    gone = later_lines(plain(data))
    out = {r.doc_id: r for r in line_dedup.remove_later_lines(unique, 0.8, 5).collect()}
    for r in plain(data):
        if r["text"] is None:
            assert out[r["doc_id"]].text is None
            continue
        kept = [x for k, x in enumerate(r["text"].split("\n")) if (r["doc_id"], k) not in gone]
        assert out[r["doc_id"]].text == "\n".join(kept)
    assert line_dedup.remove_later_lines(docs).columns == [c for c in docs.columns if c != "text"] + ["text", "n_lines", "n_removed"]
    assert line_dedup.remove_later_lines(docs).count() == len(data)
    assert line_dedup.remove_later_lines(empty).count() == 0


# --- SimHash

def brute_fingerprint(text, size=3):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(grams))


def test_fingerprint_bits(spark, data):
    for r in data[:30]:
        assert simhash.fingerprint((r["text"] or "").encode()) % (1 << 64) == brute_fingerprint(r["text"])
    own = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.shingle_hashes(b"A B C", 3)[0] == own % (1 << 64)


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_links_of_random_fingerprints(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.integers(-(1 << 62), 1 << 62, 12)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(10):
            v = int(c)
            for b in rng.choice(64, rng.integers(0, bits + 3), replace=False):
                v ^= 1 << int(b)
            values.add((v + (1 << 63)) % (1 << 64) - (1 << 63))
    df = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, bits).collect()}
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) % (1 << 64)).count("1") <= bits}
    assert got == want


def test_near_duplicates(docs, unique, data, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(unique).collect()}
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in plain(data)}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == components(fps)
    assert simhash.near_duplicates(docs).count() == len(data)
    assert simhash.near_duplicates(empty).count() == 0


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BroadcastHashJoin" in plan, "SortMergeJoin" in plan


def test_links_are_shuffled_not_broadcast(spark, tmp_path):
    # an exploded side is many times its estimated size
    spark.range(0, 20_000, 1, 1).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    assert _joins(simhash.links(spark.read.parquet(f"{tmp_path}/fps"))) == (False, True)


def test_long_chains_of_links(spark):
    from logweave.llm.common import Scratch, connected_components

    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(Scratch(spark, "t"), df).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1100)}}


# --- winnowing

def brute_hits(data, items, window):
    import re

    cut = lambda t: [w for w in re.split(r"[\x00-/:-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    grams = {}
    for item, text in items:
        words = cut(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            grams.setdefault(tuple(words[i:i + n]), set()).add(str(item))
    out = {}
    for r in data:
        words, hit, found = cut(r["text"]), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(words) - n + 1):
                own = grams.get(tuple(words[i:i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        out[r["doc_id"]] = (len(words), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("window,k", [(10, 5), (4, 4), (6, 1)])
def test_decontamination(spark, unique, docs, data, empty, window, k):
    own = plain(data)
    words = own[4]["text"].split()
    items = [(1, " ".join(words[10:30])), (2, "Oak, oak; OAK"), (3, None), (4, ""), (5, " ".join(words[40:40 + window])),
             (6, " ".join(words[11:29])), (7, "never seen words at all here"), (8, "É"), (2, "oak oak oak")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, did int")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in winnow.contamination(unique, bench, window, k).collect()}
    want = brute_hits(own, items, window)
    assert got == want and any(v[1] for v in want.values())
    left = {r.doc_id for r in winnow.without_contaminated(unique, bench, window, k).collect()}
    assert left == {i for i, v in want.items() if not v[1]}
    assert winnow.contamination(docs, bench, window, k).count() == len(data)
    assert winnow.contamination(empty, bench, window, k).count() == 0
    none = winnow.contamination(unique, bench.limit(0), window, k)
    assert none.where("n_hit > 0 OR size(items) > 0").count() == 0 and none.count() == len(own)


# --- fingerprints

def test_fingerprints_and_edits(docs, unique, data, empty):
    own = sorted(plain(data), key=lambda r: r["doc_id"])
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(unique, 0.02, 0.6).collect()}
    assert len(got) == len(own)
    by_text = {}
    for k, r in enumerate(own):
        text, after = r["text"] or "", own[(k + 1) % len(own)]["text"] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        out = got[r["doc_id"]]
        assert (out.n_chars, out.edited) == (len(text), edited)
        assert hashlib.sha256(out.edited.encode()).digest() == hashlib.sha256(edited.encode()).digest()
        assert by_text.setdefault(text, out.fingerprint) == out.fingerprint
        assert by_text.setdefault(edited, out.edited_fingerprint) == out.edited_fingerprint
        assert 0 <= out.near_edited <= 1 and 0 <= out.near_next <= 1
        assert (out.near_edited == 1) == (out.fingerprint == out.edited_fingerprint)
    pairs = [(got[r["doc_id"]].near_edited, got[r["doc_id"]].near_next) for k, r in enumerate(own) if k % 10 in (4, 8, 9)]
    assert np.mean([p[0] for p in pairs]) > np.mean([p[1] for p in pairs]) + 0.2
    assert fingerprints.edited_fingerprints(docs, 0.02, 0.6).count() == len(data)
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(unique.where("doc_id = 24"), 0.02, 1.0).first()
    assert one.near_next == 1.0


def test_lexicon_band(spark):
    texts = ["a b c d", "a b e", "a f", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.term for r in fingerprints.lexicon(df, 0.3, 0.6).collect()}
    want = {r[0] for r in spark.sql("SELECT shiftrightunsigned(xxhash64('b'), 1)").collect()}
    assert got == want


def i_match(text, band):
    """A fingerprint by its definition, with the sorted words of `text` in the `band` of terms."""
    words = sorted(t for t in {xxhash.xxh64_intdigest(w, 42) >> 1 for w in text.encode().split()} if t in band)
    chosen, shift = {}, 0
    for family, thin in enumerate(fingerprints.THIN):
        for t in words if len(words) >= 4 else []:
            cell = t >> shift & ((1 << 5 + thin) - 1)
            if cell < fingerprints.SUBSETS:
                chosen.setdefault(family * fingerprints.SUBSETS + cell, []).append(t >> 63 - 48)
        shift += 5 + thin
    out = []
    for subset in sorted(chosen):
        h = 0
        for t in sorted(chosen[subset]):
            member = (subset << 48 | t).to_bytes(8, "little")
            h = xxhash.xxh64_intdigest(member, xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
        out.append((subset, h & 0xFFFF))
    return out


def best_family(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for family in range(len(fingerprints.THIN)):
        u, v = (dict(e for e in x if e[0] // fingerprints.SUBSETS == family) for x in (a, b))
        best = max(best, sum(u[s] == v.get(s) for s in u) / (len(set(u) | set(v)) + 1))
    return best


def test_fingerprints_by_definition(spark, unique):
    band = {r.term for r in fingerprints.lexicon(unique.select("text"), 0.02, 0.6).collect()}
    rows = sorted(fingerprints.edited_fingerprints(unique, 0.02, 0.6).join(unique.select("doc_id", "text"), "doc_id").collect(), key=lambda r: r.doc_id)
    shown = lambda f, text: "".join(f"{s:02x}{h:04x}" for s, h in f) or f"t{xxhash.xxh64_intdigest(text.encode(), 42):x}"
    own = [i_match(r.text or "", band) for r in rows]
    for k, r in enumerate(rows):
        edited = i_match(r.edited, band)
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own[k], r.text or ""), shown(edited, r.edited))
        for got, a, b, same in ((r.near_edited, own[k], edited, r.fingerprint == r.edited_fingerprint),
                                (r.near_next, own[k], own[(k + 1) % len(own)], r.fingerprint == rows[(k + 1) % len(own)].fingerprint)):
            assert got == pytest.approx(1.0 if same else 0.0 if not a and not b else best_family(a, b))


def test_every_word_of_the_lexicon_is_found_and_no_other(spark):
    rng = np.random.default_rng(2)
    words = sorted({int(x) for x in rng.integers(0, 1 << 63, 60_000)} | {0, 1, (1 << 63) - 1} | {k << 40 for k in range(6)})
    table = fingerprints.packed(words)
    entries = [int.from_bytes(table[k:k + 8], "big", signed=True) for k in range(0, len(table), 8)]
    assert sorted(e for e in entries if e >= 0) == words and len(entries) < 6 * len(words)
    others = [w ^ 1 << int(b) for w, b in zip(words, rng.integers(0, 63, len(words)))]
    df = spark.createDataFrame([(words[k::64] + others[k::64],) for k in range(64)], "found array<bigint>")
    got = df.select(F.explode(fingerprints.with_constant(table, lambda t: fingerprints.lexicon_words(F.col("found"), t, len(table)))))
    assert {r[0] for r in got.collect()} == set(words)
    assert len(fingerprints.packed([])) == 8 * 16


def test_hot_ids_are_cut_into_ranges(spark):
    """A third of the rows has no id, another id has many rows, one row is there hundreds of times."""
    data = [(None, f"none {k}") for k in range(700)] + [(50, f"fifty {k}") for k in range(300)] + [(k, f"own {k}") for k in range(600)] + [(70, "the same again")] * 400
    df = spark.createDataFrame(data, "doc_id long, text string")
    ranged = fingerprints.with_ranges(df, rows_each=40).where("guest = 0")
    sizes = [r["count"] for r in ranged.groupBy("part").count().collect()]
    assert sum(sizes) == 1601 and max(sizes) <= 100
    got = fingerprints.edited_fingerprints(df, 0.001, 0.5).collect()
    order = {(r.did, r.th): k for k, r in enumerate(sorted(ranged.select("did", "th").collect()))}
    rows = sorted(df.select("doc_id", "text", *doc_order()).collect(), key=lambda r: order[r.did, r.th])
    want = []
    for k, r in enumerate(rows):
        cut = len(r.text) // 4
        want.append((r.doc_id or -1, r.text[:len(r.text) - cut] + rows[(k + 1) % len(rows)].text[:cut]))
    assert sorted((r.doc_id if r.doc_id else -1, r.edited) for r in got) == sorted(want)


def test_successors_across_ranges(spark):
    df = spark.range(0, 3000, 7).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    ranged = fingerprints.with_ranges(df, rows_each=16)
    assert ranged.select("part").distinct().count() > 10
    from pyspark.sql import Window as W

    w = W.partitionBy("part").orderBy("guest", "did", "th")
    got = {r.doc_id: r.next for r in ranged.withColumn("next", F.lead("text").over(w)).where("guest = 0").collect()}
    ids = list(range(0, 3000, 7))
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_equal_rows_lose_their_lines(spark):
    text = "one two three\n\nfour five six seven\n \t"
    data = [{"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": 0, "did": 1, "th": "x", "words": None}
            for i, t in [(7, text), (7, text), (None, "no id here"), (None, "no id here"), (None, "no id here"), (3, "alone"), (7, "three two one"), (4, None), (4, None)]]
    got = line_dedup.remove_later_lines(frame(spark, data)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in got) == sorted([
        (7, text, 0), (7, "\n \t", 2), (0, "no id here", 0), (0, "", 1), (0, "", 1), (3, "alone", 0), (7, "", 1), (4, "", 0), (4, "", 0)]) or \
        sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in got) == sorted([      # the hash of the text decides which of id 7 is first
        (7, "\nfour five six seven\n \t", 1), (7, "\n \t", 2), (0, "no id here", 0), (0, "", 1), (0, "", 1), (3, "alone", 0), (7, "three two one", 0), (4, "", 0), (4, "", 0)])
    assert sum(r.n_lines for r in got) == 4 + 4 + 3 + 1 + 1


def test_what_may_be_large_is_not_broadcast(spark, unique, monkeypatch):
    scratch = common.Scratch(spark, "sized")
    few = scratch.write(spark.range(100).select(F.col("id").cast("int").alias("t")), "few")
    many = spark.range(1000).select(F.col("id").alias("t"))
    assert _joins(many.join(scratch.small(few, "few"), "t")) == (True, False)
    want = sorted(line_dedup.later_lines(unique).collect())
    seen, pairs = [], line_dedup._candidates
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "_candidates", lambda a, b, t: seen.append(_joins(a)) or pairs(a, b, t))
    assert _joins(many.join(scratch.small(few, "few"), "t")) == (False, True)
    assert sorted(line_dedup.later_lines(unique).collect()) == want
    assert seen[0] == (False, True)     # the words' earliest documents
