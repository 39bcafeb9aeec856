"""Web-log queries: W1-W8 on access lines derived from ``events`` and on
``pages.url``; H4/H5 on ``pages.url``; W2 on whole ``documents`` texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import text, urls
from logweave.operators import weblog
from logweave.plans import duck, inputs
from logweave.plans.registry import register
from logweave.session import table

FIELDS = weblog.REQUEST_FIELDS
PAGE_FIELDS = ("page", "ref", "utm_source")


def request_records(spark, sf):
    lines = inputs.access_lines(table(spark, sf, "events"))
    return weblog.extract_requests(lines, "value", keep=("event_id", "ts"))


def good_records(spark, sf):
    lines = inputs.access_lines(table(spark, sf, "events"))
    return weblog.good_requests(lines, "value", keep=("event_id", "ts"))


@register("w1_request_records", f"""
WITH {duck.REQUEST_RECORDS}
SELECT event_id, {', '.join(FIELDS)}, rejected FROM records""")
def w1_request_records(spark, sf):
    return request_records(spark, sf).drop("ts")


@register("w2_token_pick", f"""
SELECT doc_id, {duck.java_split('text', ' ')}[9] AS token, {duck.java_split('text', ' ')}[9] IS NULL AS rejected
FROM documents""")
def w2_token_pick(spark, sf):
    docs = table(spark, sf, "documents")
    tok = text.token_at("text", weblog.URL_TOKEN)
    return docs.select("doc_id", tok.alias("token"), tok.isNull().alias("rejected"))


@register("w3_url_split", f"""
SELECT page_id,
  CASE WHEN strpos(url, '?') > 0 THEN substr(url, 1, strpos(url, '?') - 1) ELSE url END AS path,
  {duck.query_string('url')} AS query
FROM pages""")
def w3_url_split(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", urls.url_path("url").alias("path"), urls.query_string("url").alias("query"))


@register("w4_param_explode", f"""
WITH q AS (SELECT page_id, {duck.pairs(duck.query_string('url'))} AS kvs FROM pages WHERE strpos(url, '?') > 0)
SELECT page_id, pos, kv[1] AS name, kv[2] AS value
FROM (SELECT page_id, CAST(generate_subscripts(kvs, 1) - 1 AS INTEGER) AS pos, unnest(kvs) AS kv FROM q)""")
def w4_param_explode(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.posexplode(urls.decoded_pairs(urls.query_string("url"))).alias("pos", "kv")) \
        .select("page_id", "pos", F.get("kv", 0).alias("name"), F.get("kv", 1).alias("value"))


# escapes, plus signs and a malformed escape, by row
W5_SUFFIX = {0: "&q=a%20b+c%C3%A9", 1: "&q=x+y%2Bz", 2: "&q=100%zz+"}


@register("w5_url_decode", f"""
WITH u AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '{W5_SUFFIX[0]}' WHEN 1 THEN '{W5_SUFFIX[1]}' ELSE '{W5_SUFFIX[2]}' END AS u FROM pages)
SELECT page_id, {duck.decode('u')} AS decoded FROM u""")
def w5_url_decode(spark, sf):
    p = table(spark, sf, "pages")
    kind = F.col("page_id") % 3
    suffix = F.when(kind == 0, F.lit(W5_SUFFIX[0])).when(kind == 1, F.lit(W5_SUFFIX[1])).otherwise(F.lit(W5_SUFFIX[2]))
    return p.select("page_id", urls.decode_or_raw(F.concat("url", suffix)).alias("decoded"))


@register("w6_named_fields", f"""
WITH q AS (SELECT page_id, {duck.query_string('url')} AS qs FROM pages),
     k AS (SELECT page_id, qs, {duck.pairs('qs')} AS kvs FROM q)
SELECT page_id, {', '.join(duck.pick('kvs', 'qs', f) + ' AS ' + f for f in PAGE_FIELDS)} FROM k""")
def w6_named_fields(spark, sf):
    return weblog.with_request_fields(table(spark, sf, "pages"), "url", PAGE_FIELDS, keep=("page_id",))


@register("w7_record_json", f"""
WITH {duck.REQUEST_RECORDS}
SELECT event_id,
  CASE WHEN city IS NULL THEN '{{}}'
       ELSE json_object({', '.join(f"'{f}', {f}" for f in FIELDS)})::VARCHAR END AS record_json
FROM records""")
def w7_record_json(spark, sf):
    r = request_records(spark, sf)
    return r.select("event_id", weblog.records_as_json(r).alias("record_json"))


@register("w8_partition_layout", f"""
WITH {duck.REQUEST_RECORDS}
SELECT {', '.join(FIELDS)}, strftime(ts, '%Y%m%d') AS ds FROM records WHERE NOT rejected""")
def w8_partition_layout(spark, sf):
    return weblog.partition_layout(good_records(spark, sf), F.date_format("ts", "yyyyMMdd"))


@register("h4_canonical_params", """
WITH q AS (SELECT page_id, CASE WHEN strpos(url, '?') > 0 THEN substr(url, strpos(url, '?') + 1) END AS qs FROM pages),
s AS (SELECT page_id, qs, """ + duck.java_split("qs", "&") + """ AS parts FROM q),
p AS (SELECT page_id, qs, list_transform(parts, lambda kv: {'k': split_part(kv, '=', 1),
        'v': CASE WHEN strpos(kv, '=') > 0 THEN substr(kv, strpos(kv, '=') + 1) ELSE '' END}) AS kvs FROM s),
l AS (SELECT page_id, qs, list_sort(list_filter(kvs, lambda x, i:
        NOT list_contains(list_transform(kvs[i + 1:], lambda y: y.k), x.k))) AS kvs FROM p)
SELECT page_id,
  CASE WHEN len(kvs) = 0 THEN ''
       ELSE '?' || array_to_string(list_transform(kvs, lambda x: replace(x.k, '_', '.') || '=' || x.v), '&') END AS canonical
FROM l""")
def h4_canonical_params(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", urls.canonical_params(urls.query_string("url")).alias("canonical"))


@register("h5_url_encode", """
SELECT page_id, replace(replace(replace(url_encode(url), '%20', '+'), '~', '%7E'), '%2A', '*') AS encoded FROM pages""")
def h5_url_encode(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", urls.url_encode("url").alias("encoded"))


def entry_query(spark, sf):
    """Flagship: W3-W6 on ``pages.url`` -> how often each field value occurs."""
    fields = weblog.with_request_fields(table(spark, sf, "pages"), "url", PAGE_FIELDS, keep=("page_id",))
    long = fields.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in PAGE_FIELDS
    ])).alias("x")).select("x.field", "x.value")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


ENTRY_SQL = f"""
WITH q AS (SELECT page_id, {duck.query_string('url')} AS qs FROM pages),
     k AS (SELECT page_id, qs, {duck.pairs('qs')} AS kvs FROM q),
     f AS (SELECT page_id, {', '.join(duck.pick('kvs', 'qs', f) + ' AS ' + f for f in PAGE_FIELDS)} FROM k),
     long AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, {f} AS value FROM f" for f in PAGE_FIELDS)})
SELECT field, value, count(*) AS n FROM long GROUP BY field, value"""

register("w6_field_value_counts", ENTRY_SQL)(entry_query)
