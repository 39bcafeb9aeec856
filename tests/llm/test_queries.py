"""Registered queries against their oracles, the pipeline against its stages,
and what the contract fixes for the trained operators."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from oracle import compare, duck_connection

import corpus_pipeline
from helpers import frame, rows
from logweave.llm.queries import ORACLES, QUERIES
from logweave.session import table


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, con, name):
    assert compare(QUERIES[name](spark, SF_SMALL), con, ORACLES[name]) is None


@pytest.mark.parametrize("name,modulus,rest", [("op3_toxicity", 4, 2), ("op6_katz", 5, 1), ("op10_langid", 3, 1)])
def test_held_out_rows(spark, name, modulus, rest):
    out = QUERIES[name](spark, SF_SMALL).collect()
    assert len(out) == table(spark, SF_SMALL, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in out)


def test_language_accuracy(spark):
    out = QUERIES["op10_langid"](spark, SF_SMALL).join(table(spark, SF_SMALL, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_katz_counted_columns(spark):
    """Tokens, known tokens and base score from plain counts of the training words."""
    tokens = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() + [None]
    docs = {r.doc_id: tokens(r.text) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    counts = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total = sum(counts.values())
    below = total + 0.5 * (len(counts) + 1)
    for r in QUERIES["op6_katz"](spark, SF_SMALL).collect():
        own = docs[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / below) for w in own), rel=1e-9)


def test_katz_beats_the_base(spark):
    out = QUERIES["op6_katz"](spark, SF_SMALL).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = table(spark, SF_SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "mixing":
            assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        docs = corpus_pipeline.Scratch(spark, "t").write(out, name)
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.exceptAll(docs).count() == docs.exceptAll(got).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_awkward_rows(spark, name, stage):
    data = frame(spark, rows())
    out = stage(spark, data, SF_SMALL)
    assert out.columns[:1] == ["doc_id"] and 0 < out.count() <= data.count()
    assert set(data.columns) <= set(out.columns)
    assert stage(spark, data.limit(0), SF_SMALL).count() == 0


def test_native_plans(spark):
    for name in ("op1_fingerprints", "op7_winnow", "op8_mixing", "op9_line_dedup"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        for bad in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def test_simhash_stage_keeps_one_of_each_group(spark):
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, table(spark, SF_SMALL, "documents"), SF_SMALL)
    groups = QUERIES["op4_simhash"](spark, SF_SMALL)
    assert kept.join(groups, "doc_id").groupBy("component_id").agg(F.count("*").alias("n")).where("n <> 1").count() == 0
    assert kept.count() == groups.select("component_id").distinct().count()


CLASHING = ["did", "th", "lw_did", "lw_th", "lw_gone", "lw_copy", "lw_first", "lw_row", "lw_p", "lw_source", "n_lines", "n_removed", "lang_pred", "score", "rare",
            "row", "component_id", "fp", "lw_is_first", "_lw_row", "words", "key"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_carry_clashing_columns(spark, name, stage):
    data = frame(spark, rows()).select("doc_id", "text", "lang", "source", "n_chars")
    extra = data.withColumns({c: F.concat_ws("|", F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    out = stage(spark, extra, SF_SMALL)
    assert out.columns[:len(extra.columns)] == extra.columns
    plainly = stage(spark, data, SF_SMALL)
    assert sorted(map(repr, out.select(*data.columns).collect())) == sorted(map(repr, plainly.select(*data.columns).collect()))
    for r in out.select("doc_id", *CLASHING).collect():
        assert all(r[c] == "|".join([c] + ([str(r.doc_id)] if r.doc_id is not None else [])) for c in CLASHING)


def test_near_dedup_stage_works_by_row(spark):
    say = lambda k: " ".join(f"word{(i * k) % 211}" for i in range(80))
    data = [(1, say(3)), (2, say(3)), (2, say(7)), (5, say(11)), (5, say(11)), (None, say(13)), (None, say(13)), (9, say(13)), (10, say(17))]
    docs = frame(spark, [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": 1, "did": 1, "th": "x", "words": None} for i, t in data])
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF_SMALL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, say(3)), (2, say(7)), (5, say(11)), (0, say(13)), (10, say(17))])


def test_line_stage_removes_short_copies(spark):
    texts = ["one two three four\nsame", "same\nown line here", "one two three four five\n\nlast", "\nother"]
    docs = frame(spark, [{"doc_id": i, "text": t, "lang": "en", "source": "src0", "n_chars": len(t), "did": 1, "th": "x", "words": None}
                         for i, t in enumerate(texts)])
    kept = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SF_SMALL)
    assert {r.doc_id: r.text for r in kept.collect()} == {0: texts[0], 1: "own line here", 2: "\nlast", 3: texts[3]}
