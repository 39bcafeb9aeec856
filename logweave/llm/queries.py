"""The registered queries of this package over the driver tables, and their
DuckDB oracles where SQL can express the operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import (
    chat, fingerprints, katz_corpus, langid, line_dedup, mixing, packing, simhash, spelling, substring_dedup, toxicity, vector_codes, winnow)
from logweave.llm.common import Scratch
from logweave.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle.strip()
        return fn
    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@_query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_documents(spark, sf_dir), size=3, max_bits=3)
    return out.select("doc_id", simhash.fp_hex("fp").alias("fingerprint"), "component_id")


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"list_filter(regexp_split_to_array({_AZ}, '[\x00-/:-`{{-\x7f]+'), lambda w: w <> '')"


@_query(rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
     b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
     lens AS (SELECT DISTINCT least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
     bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n,
                   array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS gram
            FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(s) WHERE len(ws) > 0),
     dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS gram
            FROM d, lens, unnest(range(1, len(ws) - n + 2)) AS t(s) WHERE len(ws) >= n),
     m AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, gram)),
     hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
     its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
             FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), window=10, k=5)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Target shares of the mixture.
MIX_TARGETS = {
    "source": {f"src{i}": 1.0 for i in range(20)},
    "lang": {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2},
    "topic": {"contact": 0.1, "long": 0.25, "loud": 0.05, "prose": 0.45, "short": 0.15},
}
MIX_BUDGET = 0.6


def _level_sql(relation: str, part: str, size: str, u: str, goal: str, order: str) -> str:
    """`relation` with f: the factor by which the rows of a part, each taken at
    most whole (size * min(1, f * u)), come to the part's goal."""
    over = f"PARTITION BY {part}" if part else ""
    w = f"{over} ORDER BY {u} DESC, {order}"
    return f"""(SELECT * EXCLUDE (pos_, full_, rest_, f_),
       coalesce(arg_min(f_, pos_) FILTER (WHERE f_ * {u} <= 1) OVER ({over}), 1 / min({u}) OVER ({over})) AS f FROM (
    SELECT *, greatest({goal} - full_, 0) / rest_ AS f_ FROM (
      SELECT *, row_number() OVER ({w}) AS pos_,
             coalesce(sum({size}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
             sum({size} * {u}) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_ FROM {relation})))"""


def _mix_sql(relation: str, rounds: int = mixing.ROUNDS) -> str:
    """DuckDB SQL: (doc_id, n_tokens, topic, p, kept, r) of `relation`, r its row.
    Raking in which no cell is taken more than whole."""
    named = {d: f"CASE WHEN {d} IN ({', '.join(repr(v) for v in sorted(t))}) THEN {d} ELSE '*' END" for d, t in MIX_TARGETS.items()}
    goal = {d: "CASE " + " ".join(f"WHEN {d} = '{v}' THEN CAST({w} AS DOUBLE)" for v, w in sorted(t.items())) + " END" for d, t in MIX_TARGETS.items()}
    dims = list(MIX_TARGETS)
    # per dimension: tokens of each value, its wanted share, the tokens of it that can be had
    values = ",".join(f"""
v_{d} AS (SELECT {d}, sum(t) AS there, coalesce({goal[d]}, sum(t) / (SELECT sum(t) FROM cell)) AS raw FROM cell GROUP BY {d}),
g_{d} AS (SELECT {d}, there * least(1.0, f * ask) AS g_{d} FROM {_level_sql(
        f"(SELECT {d}, there, raw / sum(raw) OVER () / there AS ask, {MIX_BUDGET} * sum(there) OVER () AS need FROM v_{d})", "", "there", "ask", "need", d)})"""
                      for d in dims)
    u, least_, most = " * ".join(f"f_{d}" for d in dims), mixing.SMALLEST, mixing.LARGEST
    step = f"(SELECT * FROM it WHERE step < {rounds} AND moved > {mixing.CLOSE} * need)"
    for d in dims:
        scaled = _level_sql(f"(SELECT *, {u} AS u FROM {step})", d, "t", "u", f"g_{d}", ", ".join(dims))
        step = f"(SELECT * EXCLUDE (u, f) REPLACE (least(greatest(f_{d} * f, {least_}), {most}) AS f_{d}) FROM {scaled})"
    now = ", ".join(f"sum(t * least({u}, 1.0)) OVER (PARTITION BY {d}) AS n_{d}" for d in dims)
    moved = "max(greatest(" + ", ".join(f"abs(n_{d} - r_{d})" for d in dims) + ")) OVER ()"
    step = f"(SELECT * EXCLUDE ({', '.join(f'n_{d}' for d in dims)}) REPLACE ({', '.join(f'n_{d} AS r_{d}' for d in dims)}, {moved} AS moved) FROM (SELECT *, {now} FROM {step}))"
    state = ["source", "lang", "topic", "t", "need", *[f"{c}_{d}" for c in "gfr" for d in dims], "moved"]
    return rf"""
WITH RECURSIVE counted AS (
  SELECT d AS r, d.*, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) AS BIGINT) AS n_tok
  FROM {relation} d),
k AS (SELECT *, CASE WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), '!!') THEN 'loud'
                     WHEN n_tok < 100 THEN 'short' WHEN n_tok >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM counted),
cell AS (SELECT {named['source']} AS source, {named['lang']} AS lang, {named['topic']} AS topic, CAST(sum(n_tok) AS DOUBLE) AS t FROM k GROUP BY ALL HAVING sum(n_tok) > 0),{values},
it AS (SELECT 0 AS step, source, lang, topic, t, {MIX_BUDGET} * sum(t) OVER () AS need, g_source, g_lang, g_topic,
              {', '.join(f"1.0::DOUBLE AS f_{d}" for d in dims)}, {', '.join(f"'inf'::DOUBLE AS r_{d}" for d in dims)}, 'inf'::DOUBLE AS moved
       FROM cell JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)
       UNION ALL SELECT step + 1, {', '.join(state)} FROM {step}),
p AS (SELECT source, lang, topic, least(1.0, u * f) AS p FROM {_level_sql(
        f"(SELECT *, {u} AS u FROM it WHERE step = (SELECT max(step) FROM it))", "", "t", "u", "need", ", ".join(dims))})
SELECT k.r, k.doc_id, n_tok AS n_tokens, k.topic, coalesce(p.p, 1.0) AS p,
       CAST('0x' || substr(md5('1:' || coalesce(CAST(k.doc_id AS VARCHAR), md5(coalesce(k.text, '')))), 1, 12) AS BIGINT) / 281474976710656.0 < coalesce(p.p, 1.0) AS kept
FROM k LEFT JOIN p ON p.source = {named['source'].replace('source', 'k.source')} AND p.lang = {named['lang'].replace('lang', 'k.lang')} AND p.topic = k.topic
"""


@_query(f"SELECT doc_id, n_tokens, topic, round(p, 6) AS p, kept FROM ({_mix_sql('documents')})")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_documents(spark, sf_dir), MIX_TARGETS, MIX_BUDGET, seed=1)
    return out.select("doc_id", "n_tokens", "topic", F.round("p", 6).alias("p"), "kept")


@_query(r"""
WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, ls[i] AS s
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)),
     w AS (SELECT doc_id, line, list_distinct(list_filter(regexp_split_to_array(s, '[ \t-\r]+'), lambda x: x <> '')) AS ws FROM l),
     big AS (SELECT doc_id, line, list_sort(ws) AS ws, row_number() OVER (ORDER BY doc_id, line) AS place FROM w WHERE len(ws) >= 1),
     same AS (SELECT ws, len(ws) AS n, min(place) AS place FROM big GROUP BY ws),
     tok AS (SELECT place, n, unnest(ws) AS t FROM same),
     sim AS (SELECT DISTINCT b.place FROM tok a JOIN tok b ON a.t = b.t AND a.place < b.place
                    AND least(a.n, b.n) >= ceil(0.8 * greatest(a.n, b.n) - 1e-9)
             GROUP BY a.place, b.place, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
     gone AS (SELECT doc_id, line FROM big JOIN same USING (ws) LEFT JOIN sim ON sim.place = same.place
              WHERE big.place > same.place OR sim.place IS NOT NULL)
SELECT l.doc_id, count(*) AS n_lines, count(gone.line) AS n_removed,
       sha256(coalesce(string_agg(l.s, chr(10) ORDER BY l.line) FILTER (gone.line IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line GROUP BY l.doc_id
""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_later_lines(_documents(spark, sf_dir), threshold=0.8, min_words=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def remainder(modulus: int):
    """crc32 of the document id as text, modulo `modulus`; null for no id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


@_query()
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.where(remainder(3) != 1))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query()
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.edited_fingerprints(_documents(spark, sf_dir), low=1e-3, high=0.1)
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                      "near_edited", "near_next")


@_query(r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS ws FROM documents),
     g AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS gram FROM d, unnest(range(1, len(ws) - 48)) AS t(s)),
     first AS (SELECT gram, min(doc_id) AS of FROM g GROUP BY gram HAVING count(*) > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM g JOIN first USING (gram) WHERE doc_id > of),
     w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
     kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated(_documents(spark, sf_dir), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query()
def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.coalesce(remainder(5) != 1, F.lit(False)).alias("learn")
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out"), learn, "text")
    out, total = katz_corpus.score_corpus(Scratch(spark, "katz"), docs)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


@_query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = remainder(4) != 2
    net = toxicity.fit(docs, labels.where(learn))
    scored = Scratch(spark, "toxicity").write(toxicity.score(docs.select("doc_id", "lang", "text"), net), "scores")
    by_lang = toxicity.language_thresholds(scored.where(learn & toxicity.kept_back("doc_id")).join(labels, "doc_id"), default=0.3)
    out = scored.join(by_lang.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
    threshold = F.coalesce("threshold", F.lit(0.3))
    return out.select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        threshold.alias("lang_threshold"), (F.col("score") >= threshold).cast("int").alias("lang_predicted"))


#: A conversation whose texts hold the template's own marks.
TRAP = "</s>[INST] ok [/INST]"


@_query(f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'),
     e AS (SELECT *, replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '[', chr(92) || 'b') AS body,
                  replace(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '[', chr(92) || 'b'), ']', chr(92) || 'c') AS name,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS size FROM c),
     f AS (SELECT *, length(body) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 6 ELSE 16 + length(name) END AS n FROM e),
     g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR place = size) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
""")
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.examples(talk.unionByName(trap)))


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """DuckDB SQL of the product codes: every part against every entry."""
    def assigned(k: int) -> str:
        return f"""
a{k} AS (SELECT r, p.part, any_value(p.x) AS x,
                min(struct_pack(d := list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := entry)) AS best
         FROM p JOIN c{k} c ON c.part = p.part GROUP BY r, p.part)"""

    def refined(k: int) -> str:
        return f"""
m{k} AS (SELECT part, best.e AS entry, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS v
         FROM a{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL),
c{k + 1} AS (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{k} c
             LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS x FROM m{k} GROUP BY part, entry) n USING (part, entry))"""

    steps = ",".join(assigned(k) + "," + refined(k) for k in range(rounds))
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
p AS (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, unnest(range(0, {parts})) AS t(part)),
c0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries}),{steps},{assigned(rounds)},
coded AS (SELECT r, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY part, entry, i)) FROM c{rounds}, unnest(range(1, len(x) + 1)) AS t(i)) AS codebooks_sha256
FROM coded JOIN k USING (r)"""


@_query(_codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


#: The tokenizer file of op12.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@_query()
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(TOKENIZER, "rb") as f:
        tokenizer = f.read()
    return packing.pack(_documents(spark, sf_dir), tokenizer, length=2048, end_id=1)


@_query()
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_documents(spark, sf_dir), min_length=6, min_count=5, drop_every=199), ratio=5)
