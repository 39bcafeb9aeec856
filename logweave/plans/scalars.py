"""Scalar queries: value conversion (C1-C11), compact times (D1-D3),
fingerprints and keyed hashes (H1-H3), column profile (M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import convert as C
from logweave.functions import hashing as H
from logweave.operators.profile import column_profile, nested_profile
from logweave.plans import duck
from logweave.plans.registry import register
from logweave.plans.relational import orders_with_lines
from logweave.plans.web import good_records
from logweave.session import table

# C -------------------------------------------------------------------------

# NULL counts: orders without a line
LINES_OF_ORDERS = """
n AS (SELECT o_orderkey, any_value(o_totalprice) AS price, nullif(count(l_orderkey), 0) AS n_lines
      FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""


def _lines_of_orders(spark, sf):
    n = F.count("l_orderkey")
    return orders_with_lines(spark, sf).groupBy("o_orderkey").agg(
        F.first("o_totalprice").alias("price"), F.when(n > 0, n).alias("n_lines"))


@register("c1_to_number", f"""
WITH {LINES_OF_ORDERS}
SELECT o_orderkey,
  CAST(trunc(price) AS BIGINT) AS price_long,
  CAST(CASE WHEN (o_orderkey & 255) >= 128 THEN (o_orderkey & 255) - 256 ELSE (o_orderkey & 255) END AS TINYINT) AS key_byte,
  CAST(CASE WHEN price > 100000 THEN 1 ELSE 0 END AS BIGINT) AS dear,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
FROM n""")
def c1_to_number(spark, sf):
    j = _lines_of_orders(spark, sf).withColumn("dear", F.col("price") > 100000)
    return j.select(
        "o_orderkey",
        C.to_number(j, "price").alias("price_long"),
        C.to_number(j, "o_orderkey", "tinyint", wrap=True).alias("key_byte"),
        C.to_number(j, "dear").alias("dear"),
        C.to_number(j, "n_lines").alias("n_lines"),
    )


@register("c2_to_boolean", f"""
WITH {LINES_OF_ORDERS}
SELECT o_orderkey, coalesce(n_lines > 3, FALSE) AS many_lines FROM n""")
def c2_to_boolean(spark, sf):
    j = _lines_of_orders(spark, sf).withColumn("many", F.col("n_lines") > 3)
    return j.select("o_orderkey", C.to_boolean(j, "many").alias("many_lines"))


@register("c3_to_text", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS custkey_text, CAST(o_orderdate AS VARCHAR) AS date_text FROM orders""")
def c3_to_text(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", C.to_text("o_custkey").alias("custkey_text"), C.to_text("o_orderdate").alias("date_text"))


@register("c4_to_decimal", """
SELECT l_orderkey, l_linenumber,
  CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(12, 1)) AS price_1,
  CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(4, 1)) AS discount_1
FROM lineitem""")
def c4_to_decimal(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", C.to_decimal("l_extendedprice", 12, 1).alias("price_1"),
                    C.to_decimal("l_discount", 4, 1).alias("discount_1"))


@register("c5_to_date", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS order_date FROM orders""")
def c5_to_date(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", C.to_date_strict(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"))


@register("c6_to_time", """
SELECT event_id, (epoch_us(ts) // 1000) % 86400000 - 28800000 AS utc_millis,
       (epoch_us(ts) // 1000) % 86400000 - 28800000 AS passed_millis FROM events""")
def c6_to_time(spark, sf):
    e = table(spark, sf, "events")
    zone = F.when(F.col("event_type") == "view", F.lit(" Asia/Shanghai")).otherwise(F.lit(" +08:00"))
    txt = F.concat(F.date_format("ts", "HH:mm:ss.SSS"), zone)
    plain = F.date_format("ts", "HH:mm:ss.SSS")
    return e.select("event_id", C.time_millis(txt, zoned=True).alias("utc_millis"),
                    C.time_millis(plain, zone="Asia/Shanghai", zoned=False).alias("passed_millis"))


@register("c7_to_timestamp_zoned", """
SELECT event_id, epoch_us(ts) // 1000 - 28800000 AS epoch_millis, epoch_us(ts) // 1000 - 28800000 AS passed_millis FROM events""")
def c7_to_timestamp_zoned(spark, sf):
    e = table(spark, sf, "events")
    zone = F.when(F.col("event_type") == "view", F.lit(" Asia/Shanghai")).otherwise(F.lit(" +08:00"))
    txt = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), zone)
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    return e.select("event_id", F.unix_millis(C.to_timestamp_zoned(txt)).alias("epoch_millis"),
                    F.unix_millis(C.to_timestamp_zoned(plain, zone="+08:00", zoned=False)).alias("passed_millis"))


@register("c8_to_interval", """
SELECT event_id,
  CAST((year(ts) - 2000) * 12 + month(ts) AS INTEGER) AS months,
  day(ts) * 86400000 + (epoch_us(ts) // 1000) % 86400000 AS millis
FROM events""")
def c8_to_interval(spark, sf):
    e = table(spark, sf, "events")
    ym = F.concat((F.year("ts") - 2000).cast("string"), F.lit("-"), F.month("ts").cast("string"))
    dt = F.concat(F.dayofmonth("ts").cast("string"), F.lit(" "), F.date_format("ts", "HH:mm:ss.SSS"))
    return e.select("event_id", C.interval_months(ym).alias("months"), C.interval_millis(dt).alias("millis"))


@register("c8_interval_columns", """
WITH t AS (SELECT event_type, ts, CAST((year(ts) - 2000) * 12 + month(ts) AS INTEGER) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END AS months,
                  (day(ts) * 86400000 + (epoch_us(ts) // 1000) % 86400000) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END AS millis FROM events)
SELECT event_type, CAST(sum(months) AS INTEGER) AS months, CAST(sum(millis) AS BIGINT) AS millis,
       CAST(max(epoch_us(ts + to_milliseconds(millis))) AS BIGINT) AS latest_micros,
       CAST(min(epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_months(months))) AS BIGINT) AS earliest_micros
FROM t GROUP BY event_type""")
def c8_interval_columns(spark, sf):
    """Interval text as interval columns, of either sign, added to times and
    summed by group."""
    e = table(spark, sf, "events")
    sign = F.when(F.col("event_id") % 2 == 0, F.lit("-")).otherwise(F.lit(""))
    ym = C.to_ym_interval(F.concat(sign, (F.year("ts") - 2000).cast("string"), F.lit("-"), F.month("ts").cast("string")))
    dt = C.to_dt_interval(F.concat(sign, F.dayofmonth("ts").cast("string"), F.lit(" "), F.date_format("ts", "HH:mm:ss.SSS")))
    added = e.select("event_type", ym.alias("ym"), dt.alias("dt"), (F.col("ts") + dt).alias("later"), (F.to_date("ts").cast("timestamp_ntz") + ym).alias("day"))
    micros = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    return added.groupBy("event_type").agg(
        C.months_of(F.sum("ym")).alias("months"), C.millis_of(F.sum("dt")).alias("millis"),
        micros(F.max("later")).alias("latest_micros"), micros(F.min("day")).alias("earliest_micros"))


@register("c9_strict_slice", """
SELECT p_partkey, array_to_string(string_split(p_name, ' ')[2:2], ' ') AS second_word FROM part""")
def c9_strict_slice(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(C.slice_strict(F.split("p_name", " "), 2, 1), " ").alias("second_word"))


@register("c10_pick_column", "SELECT c_name AS name FROM customer")
def c10_pick_column(spark, sf):
    c = table(spark, sf, "customer")
    dup = c.select(F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("ID"))
    return C.pick_column(dup, "NAME")


@register("c11_to_bytes", """
SELECT doc_id, octet_length(encode(text)) AS n_bytes, md5(encode(text)) AS bytes_md5 FROM documents""")
def c11_to_bytes(spark, sf):
    d = table(spark, sf, "documents")
    b = C.to_bytes("text")
    return d.select("doc_id", F.octet_length(b).cast("bigint").alias("n_bytes"), F.md5(b).alias("bytes_md5"))


# D -------------------------------------------------------------------------

@register("d1_parse_compact", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS from_compact, strftime(ts, '%Y-%m-%d %H:%M') AS from_arg
FROM events""")
def d1_parse_compact(spark, sf):
    e = table(spark, sf, "events")
    a = C.parse_compact(F.date_format("ts", "yyyyMMddHHmm"), "yyyyMMddHHmm")
    b = C.parse_compact(F.date_format("ts", "yyyy-MM-ddHH:mm"), "yyyy-MM-ddHH:mm")
    return e.select("event_id", F.date_format(a, "yyyy-MM-dd HH:mm").alias("from_compact"),
                    F.date_format(b, "yyyy-MM-dd HH:mm").alias("from_arg"))


@register("d2_day_keys", """
SELECT event_id, strftime(ts, '%Y/%m/%d') AS folder, strftime(ts, '%Y%m%d') AS ds FROM events""")
def d2_day_keys(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", C.day_folder("ts").alias("folder"), C.day_key("ts").alias("ds"))


@register("d3_open_interval", """
SELECT event_id FROM events
WHERE ts > TIMESTAMP '2024-01-01 00:00:07.179575' AND ts < TIMESTAMP '2024-01-03 12:00:00'""")
def d3_open_interval(spark, sf):
    e = table(spark, sf, "events")
    return e.where(C.strictly_between("ts", "2024-01-01 00:00:07.179575", "2024-01-03 12:00:00")).select("event_id")


# H1-H3 ---------------------------------------------------------------------

@register("h1_text_fingerprint", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def h1_text_fingerprint(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", H.md5_hex("text").alias("md5"), H.sha1_hex("text").alias("sha1"))


@register("h2_base64", """
SELECT doc_id, to_base64(encode(text)) AS b64, from_base64(to_base64(encode(text))) = encode(text) AS round_trip
FROM documents""")
def h2_base64(spark, sf):
    d = table(spark, sf, "documents")
    b64 = H.base64_flat("text")
    return d.select("doc_id", b64.alias("b64"), (H.unbase64_lenient(b64) == F.col("text").cast("binary")).alias("round_trip"))


HMAC_KEY = b"logweave-demo-key"


def _hmac_sql(msg: str, algo: str) -> str:
    from logweave.functions.hashing import _pads
    ipad, opad = _pads(HMAC_KEY, algo)
    fn = "sha256" if algo == "sha256" else "sha1"
    return f"{fn}(unhex('{opad.hex()}') || unhex({fn}(unhex('{ipad.hex()}') || encode({msg}))))"


@register("h3_keyed_hash", f"""
SELECT c_custkey, {_hmac_sql('c_name', 'sha256')} AS name_hmac,
       to_base64(unhex({_hmac_sql('c_name', 'sha1')})) AS name_sig
FROM customer""")
def h3_keyed_hash(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", H.hmac_hex("c_name", H.key_pads(spark, HMAC_KEY)).alias("name_hmac"),
                    H.hmac_base64("c_name", HMAC_KEY, "sha1").alias("name_sig"))


@register("h3_pseudonymised_records", f"""
WITH {duck.REQUEST_RECORDS}
SELECT event_id, city,
  CASE WHEN mobile IS NULL THEN NULL ELSE {_hmac_sql('mobile', 'sha256')} END AS mobile_key,
  CASE WHEN imsi IS NULL THEN NULL ELSE {_hmac_sql('imsi', 'sha256')} END AS imsi_key
FROM records WHERE NOT rejected""")
def h3_pseudonymised_records(spark, sf):
    """W1 records with the personal fields replaced by keyed hashes."""
    r = good_records(spark, sf)
    pads = H.key_pads(spark, HMAC_KEY)
    return r.select("event_id", "city", H.hmac_hex("mobile", pads).alias("mobile_key"),
                    H.hmac_hex("imsi", pads).alias("imsi_key"))


# M1 ------------------------------------------------------------------------

# Declared attributes by type: jdbc code, signed, precision, scale, width, class, element code
_DECLARED = {
    "bigint": (-5, True, 19, 0, 20, "java.lang.Long", None),
    "integer": (4, True, 10, 0, 11, "java.lang.Integer", None),
    "smallint": (5, True, 5, 0, 6, "java.lang.Short", None),
    "tinyint": (-6, True, 3, 0, 4, "java.lang.Byte", None),
    "boolean": (16, False, 0, 0, 5, "java.lang.Boolean", None),
    "double": (8, True, 17, 0, 24, "java.lang.Double", None),
    "varchar": (-16, True, 1073741824, 0, 1073741824, "java.lang.String", None),
    "varbinary": (-4, True, 1073741824, 0, 1073741824, "byte[]", None),
    "decimal(14,2)": (3, True, 14, 2, 16, "java.math.BigDecimal", None),
    "date": (91, True, 0, 0, 10, "java.sql.Date", None),
    "timestamp": (93, True, 3, 0, 23, "java.sql.Timestamp", None),
    "array(bigint)": (2003, False, 0, 0, 0, "java.lang.String", -5),
}


def _profile_sql(columns: dict[str, tuple[str, str]], source: str) -> str:
    """columns: name -> (type name, expression over ``source``); array(...) is never NULL."""
    parts = []
    for i, (n, (t, x)) in enumerate(columns.items(), 1):
        code, signed, p, s, w, cls, element = _DECLARED[t]
        widest = f"coalesce(max(length(CAST({x} AS VARCHAR))), 0)"
        parts.append(
            f"SELECT {i} AS ordinal, '{n}' AS column_name, '{t}' AS type_name, {code} AS jdbc_type, "
            f"{str(signed).upper()} AS signed, {p} AS precision, {s} AS scale, {w} AS display_width, "
            f"'{cls}' AS class_name, CAST({'NULL' if element is None else element} AS INTEGER) AS element_jdbc_type, "
            f"{str(not t.startswith('array')).upper()} AS nullable, "
            f"count(*) - count({x}) AS null_count, CAST({widest} AS BIGINT) AS max_width, "
            f"{f'{widest} <= {w}' if w else 'TRUE'} AS width_ok FROM {source}"
        )
    return "\nUNION ALL\n".join(parts)


_CUSTOMER = {"c_custkey": "bigint", "c_name": "varchar", "c_nationkey": "integer", "c_acctbal": "double", "c_mktsegment": "varchar"}
register("m1_column_profile", _profile_sql({n: (t, n) for n, t in _CUSTOMER.items()}, "customer"))(
    lambda spark, sf: column_profile(table(spark, sf, "customer")))

# name -> type name, DuckDB expression, Spark expression; NULLs in every second row of some
_TYPED = {
    "flag": ("boolean", "o_orderkey % 3 = 0", "o_orderkey % 3 = 0"),
    "tiny": ("tinyint", "CAST(o_orderkey % 100 AS TINYINT)", "CAST(o_orderkey % 100 AS TINYINT)"),
    "small": ("smallint", "CAST(-(o_orderkey % 10000) AS SMALLINT)", "CAST(-(o_orderkey % 10000) AS SMALLINT)"),
    "price": ("decimal(14,2)", "CAST(floor(o_totalprice) AS DECIMAL(14, 2))", "CAST(floor(o_totalprice) AS DECIMAL(14, 2))"),
    "day": ("date", "CAST(o_orderdate AS DATE)", "CAST(o_orderdate AS DATE)"),
    "noon": ("timestamp", "CAST(o_orderdate AS DATE) + INTERVAL 12 HOUR", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ) + INTERVAL 12 HOURS"),
    "raw": ("varbinary", "CAST(o_orderstatus AS BLOB)", "CAST(o_orderstatus AS BINARY)"),
    "ids": ("array(bigint)", "[o_orderkey, o_custkey]", "array(o_orderkey, o_custkey)"),
    "odd": ("bigint", "CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END", "CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END"),
}


@register("m1_profile_types", _profile_sql({n: (t, x) for n, (t, x, _) in _TYPED.items()}, "orders"))
def m1_profile_types(spark, sf):
    return column_profile(table(spark, sf, "orders").selectExpr(*[f"{x} AS {n}" for n, (_, _, x) in _TYPED.items()]))


def _leaf_sql(leaves: dict[str, tuple[str, str, str]]) -> str:
    """leaves: path -> (type name, relation that gives x for every value, NULLs included)."""
    parts = []
    for i, (path, (t, relation, x)) in enumerate(leaves.items(), 1):
        code, _, p, s, w, _, _ = _DECLARED[t]
        widest = f"coalesce(max(length(CAST({x} AS VARCHAR))), 0)"
        parts.append(f"SELECT {i} AS ordinal, '{path}' AS path, '{t}' AS type_name, {code} AS jdbc_type, {p} AS precision, {s} AS scale, "
                     f"{w} AS display_width, count(*) AS value_count, count(*) - count({x}) AS null_count, CAST({widest} AS BIGINT) AS max_width, "
                     f"{f'{widest} <= {w}' if w else 'TRUE'} AS width_ok FROM {relation}")
    return "\nUNION ALL\n".join(parts)


_WORDS = "(SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM orders WHERE o_orderkey % 5 <> 0)"


@register("m1_nested_leaves", _leaf_sql({
    "o_orderkey": ("bigint", "orders", "o_orderkey"),
    "who.id": ("bigint", "(SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS x FROM orders)", "x"),
    "who.price.amount": ("double", "(SELECT CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice) + 0.5 END AS x FROM orders)", "x"),
    "words.element": ("varchar", f"(SELECT CASE WHEN w <> '1' THEN w END AS x FROM {_WORDS})", "x"),
    "nested.element.element.n": ("bigint", "(SELECT unnest([o_orderkey, NULL, o_custkey]) AS x FROM orders WHERE o_orderkey % 5 <> 0)", "x"),
    "counts.key": ("varchar", "(SELECT unnest([o_orderstatus, 'other']) AS x FROM orders)", "x"),
    "counts.value.element": ("bigint", "(SELECT unnest([o_custkey, NULL]) AS x FROM orders)", "x"),
}))
def m1_nested_leaves(spark, sf):
    """Structs, arrays of arrays of structs and maps of arrays, with NULLs at
    every level."""
    gone, void = "o_orderkey % 3 = 0", "o_orderkey % 5 = 0"
    return nested_profile(table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        f"CASE WHEN NOT {gone} THEN named_struct('id', o_custkey, 'price', named_struct('amount', floor(o_totalprice) + 0.5D)) END AS who",
        f"CASE WHEN NOT {void} THEN transform(split(o_orderpriority, '-'), x -> nullif(x, '1')) END AS words",
        f"CASE WHEN NOT {void} THEN array(array(named_struct('n', o_orderkey), NULL), NULL, array(named_struct('n', o_custkey))) END AS nested",
        "map(o_orderstatus, array(o_custkey), 'other', array(CAST(NULL AS BIGINT))) AS counts"))
