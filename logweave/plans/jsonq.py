"""JSON queries N1-N11 on ``events.props`` and JSON texts derived from
``events`` rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import jsoncols as J
from logweave.functions.text import java_split
from logweave.plans import duck, inputs
from logweave.plans.registry import register
from logweave.session import table


def _k():
    return F.get_json_object("props", "$.k")


DK = "json_extract_string(props, '$.k')"


def _events(spark, sf):
    return table(spark, sf, "events")


# JSON texts derived from events (same text in both engines)
def _obj_typed():
    """``{"<type>": 1, "k": <k>}`` - two keys, the first named by the row."""
    return F.concat(F.lit('{"'), F.col("event_type"), F.lit('": 1, "k": '), _k(), F.lit("}"))


D_OBJ_TYPED = f"""'{{"' || event_type || '": 1, "k": ' || {DK} || '}}'"""


def _obj_nullable():
    """``{"k": <k>, "v": null}`` for errors, ``{"k": <k>, "v": 1}`` otherwise."""
    v = F.when(F.col("event_type") == "error", F.lit("null")).otherwise(F.lit("1"))
    return F.concat(F.lit('{"k": '), _k(), F.lit(', "v": '), v, F.lit("}"))


D_OBJ_NULLABLE = (f"""'{{"k": ' || {DK} || ', "v": ' || """
                  f"""CASE WHEN event_type = 'error' THEN 'null' ELSE '1' END || '}}'""")


def _obj_mixed():
    """``{"v": <value>, "k": "<k>", "t": "<type>", "b": true | "False"}``."""
    b = F.when(F.col("event_type") == "view", F.lit("true")).otherwise(F.lit('"False"'))
    return F.concat(F.lit('{"v": '), F.col("value").cast("string"), F.lit(', "k": "'), _k(),
                    F.lit('", "t": "'), F.col("event_type"), F.lit('", "b": '), b, F.lit("}"))


# a key with a quote, held by the rows of one type only
def _obj_quoted():
    key = F.when(F.col("event_type") == "view", F.lit("it's")).otherwise(F.lit("its"))
    return F.concat(F.lit('{"'), key, F.lit('": '), _k(), F.lit("}"))


D_KIND = "event_type = 'view'"


@register("n1_strict_get", f"""
SELECT event_id, value AS v_double, CAST(trunc(value) AS INTEGER) AS v_int, CAST({DK} AS BIGINT) AS k_long,
       event_type = 'view' AS b_flag, event_type AS t_text
FROM events""")
def n1_strict_get(spark, sf):
    e = _events(spark, sf).select("event_id", _obj_mixed().alias("j"))
    return J.get_many(e, "j", {
        "v_double": ("v", "double"),     # number
        "v_int": ("v", "int"),           # number truncated
        "k_long": ("k", "bigint"),       # numeric string
        "b_flag": ("b", "boolean"),      # true or "False"
        "t_text": ("t", "string"),
    }, keep=("event_id",))


@register("n1_strict_get_single", f"""
SELECT event_id, CAST({DK} AS BIGINT) AS k FROM events""")
def n1_strict_get_single(spark, sf):
    return _events(spark, sf).select("event_id", J.get_strict("props", "k", "bigint").alias("k"))


@register("n2_lenient_get", f"""
SELECT event_id, CAST(value AS VARCHAR) AS v_text, CAST({DK} AS BIGINT) AS k_long, CAST(0 AS BIGINT) AS t_long,
       event_type = 'view' AS b_flag, event_type AS t_text, '-' AS absent_text
FROM events""")
def n2_lenient_get(spark, sf):
    e = _events(spark, sf).select("event_id", _obj_mixed().alias("j"))
    return J.get_many(e, "j", {
        "v_text": ("v", "string", None),     # a number as Java prints it
        "k_long": ("k", "bigint", None),
        "t_long": ("t", "bigint", None),     # not a number -> 0
        "b_flag": ("b", "boolean", None),
        "t_text": ("t", "string", None),
        "absent_text": ("absent", "string", "-"),
    }, keep=("event_id",))


@register("n2_lenient_defaults", f"""
SELECT event_id, CASE WHEN {D_KIND} THEN CAST({DK} AS BIGINT) ELSE -1 END AS quoted,
       CASE WHEN {D_KIND} THEN '' ELSE {DK} END AS plain
FROM events""")
def n2_lenient_defaults(spark, sf):
    """Keys that only some rows have, one of them with a quote."""
    e = _events(spark, sf).select("event_id", _obj_quoted().alias("j"))
    return e.select("event_id", J.get_lenient("j", "it's", "bigint", -1).alias("quoted"), J.get_lenient("j", "its", "string").alias("plain"))


@register("n3_key_listing", f"""
SELECT key, count(*) AS n FROM (SELECT unnest(json_keys({D_OBJ_TYPED})) AS key FROM events) GROUP BY key""")
def n3_key_listing(spark, sf):
    keys = _events(spark, sf).select(F.explode(J.keys(_obj_typed())).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@register("n4_has_and_is_null", f"""
SELECT event_id, {D_KIND} AS has_quoted, NOT ({D_KIND}) AS quoted_is_null, event_type = 'error' AS v_is_null,
       event_type = 'view' AS has_view
FROM events""")
def n4_has_and_is_null(spark, sf):
    e = _events(spark, sf).select("event_id", _obj_quoted().alias("q"), _obj_nullable().alias("j"), _obj_typed().alias("t"))
    return e.select("event_id", J.has_key("q", "it's").alias("has_quoted"), J.is_null_key("q", "it's").alias("quoted_is_null"),
                    J.is_null_key("j", "v").alias("v_is_null"), J.has_key("t", "view").alias("has_view"))


def _arr():
    extra = F.when(F.col("event_type") == "error", F.lit(', "e"')).otherwise(F.lit(""))
    return F.concat(F.lit("\n\t[ "), _k(), F.lit(", null"), extra, F.lit("]"))


@register("n5_length", f"""
SELECT event_id, json_array_length(json_keys({D_OBJ_NULLABLE})::JSON)::INTEGER AS n_keys,
  json_array_length('[' || {DK} || ', null' || CASE WHEN event_type = 'error' THEN ', "e"' ELSE '' END || ']')::INTEGER AS n_items
FROM events""")
def n5_length(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", J.length(_obj_nullable()).alias("n_keys"), J.length(_arr()).alias("n_items"))


@register("n6_canonical_dedupe", f"""
SELECT '{{"a":' || {DK} || ',"b":"' || event_type || '"}}' AS canonical, event_type IN ('view', 'error') AS fraction, count(*) AS n
FROM events WHERE event_type <> 'signup' GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, count(*) FROM events WHERE event_type = 'signup'""")
def n6_canonical_dedupe(spark, sf):
    """Objects with their keys in either order, integers and fractions of the
    same size kept apart, and rows that are not JSON under a NULL key."""
    e = _events(spark, sf)
    t = F.col("event_type")
    a = F.concat(_k(), F.when(t.isin("view", "error"), F.lit(".0")).otherwise(F.lit("")))
    ab = F.concat(F.lit('{"a": '), a, F.lit(', "b": "'), t, F.lit('"}'))
    ba = F.concat(F.lit('{"b": "'), t, F.lit('", "a": '), a, F.lit("}"))
    j = F.when(t == "signup", F.lit("{not JSON")).when(t.isin("view", "click"), ab).otherwise(ba)
    keyed = e.select(J.similar_key(j).alias("key"), J.canonical(j).alias("canonical"))
    grouped = keyed.groupBy("key").agg(F.min("canonical").alias("canonical"), F.count(F.lit(1)).alias("n"))
    return grouped.select("canonical", F.col("key").contains(J.DOUBLE_MARK).alias("fraction"), "n")


@register("n6_mixed_arrays", f"""
SELECT kind, count(*) AS n_rows, CAST(count(DISTINCT {DK}) AS BIGINT) AS n_keys
FROM (SELECT props, CASE WHEN event_type IN ('view', 'click') THEN 'first' ELSE 'second' END AS kind FROM events) GROUP BY kind""")
def n6_mixed_arrays(spark, sf):
    """``[k.0, 2]`` and ``[k, 2.0]`` are unequal arrays: no key in common."""
    first = F.col("event_type").isin("view", "click")
    j = F.when(first, F.concat(F.lit("["), _k(), F.lit(".0, 2]"))).otherwise(F.concat(F.lit("["), _k(), F.lit(", 2.0]")))
    keyed = _events(spark, sf).select(F.when(first, "first").otherwise("second").alias("kind"), J.similar_key(j).alias("key"))
    per_key = keyed.groupBy("key").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"), F.count(F.lit(1)).alias("n"))
    return per_key.where("kind = other").groupBy("kind").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


@register("n6_equal_numbers", f"""
SELECT 'double' AS kind, count(*) AS n_rows, CAST(count(DISTINCT {DK}) AS BIGINT) AS n_keys FROM events WHERE event_type IN ('click', 'view')
UNION ALL
SELECT CASE WHEN event_type = 'error' THEN 'long' ELSE 'text' END, count(*), CAST(count(DISTINCT {DK}) AS BIGINT) FROM events
WHERE event_type NOT IN ('click', 'view') GROUP BY 1""")
def n6_equal_numbers(spark, sf):
    """A double in three spellings is one value, deep in arrays of objects with
    their keys in any order; an int of that size and text are others."""
    t, i = F.col("event_type"), F.col("event_id") % 3
    double = F.concat(_k(), F.when(i == 0, F.lit(".0")).when(i == 1, F.lit("e0")).otherwise(F.lit(".00E+00")))
    number = F.when(t.isin("click", "view"), double).when(t == "error", _k()).otherwise(F.concat(F.lit('"'), _k(), F.lit('.0"')))
    ab = F.concat(F.lit('[[{"a": {"x": '), number, F.lit('}, "b": [1, -0.0]}], 2]'))
    ba = F.concat(F.lit('[[{"b": [1,-0.0e1], "a": {"x":'), number, F.lit("}}],2]"))
    kind = F.when(t.isin("click", "view"), "double").when(t == "error", "long").otherwise("text")
    keyed = _events(spark, sf).select(kind.alias("kind"), J.similar_key(F.when(i == 1, ab).otherwise(ba)).alias("key"))
    per_key = keyed.groupBy("key").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"), F.count(F.lit(1)).alias("n"))
    return per_key.where("kind = other").groupBy("kind").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


def _loose_sql(x: str) -> str:
    frac = f"(strpos({x}, '.') > 0 OR strpos({x}, 'e') > 0 OR strpos({x}, 'E') > 0)"
    num = f"regexp_matches({x}, '^[0-9-]')"
    dbl = f"TRY_CAST({x} AS DOUBLE)"
    lng = f"TRY_CAST({x} AS BIGINT)"
    kind = (f"CASE WHEN {x} = '' THEN 'string' WHEN lower({x}) IN ('true', 'false') THEN 'boolean' "
            f"WHEN lower({x}) = 'null' THEN 'null' "
            f"WHEN {num} AND {frac} AND {dbl} IS NOT NULL AND isfinite({dbl}) THEN 'double' "
            f"WHEN {num} AND NOT {frac} AND {lng} IS NOT NULL AND CAST({lng} AS VARCHAR) = {x} "
            f"THEN CASE WHEN {lng} BETWEEN -2147483648 AND 2147483647 THEN 'int' ELSE 'long' END "
            f"ELSE 'string' END")
    return kind


@register("n7_loose_typing", f"""
WITH {duck.RECON_LINES},
t AS (SELECT DISTINCT unnest({duck.java_split('value', ',')}) AS token FROM rl),
k AS (SELECT token, {_loose_sql('token')} AS kind FROM t)
SELECT token, kind,
  CASE WHEN kind IN ('int', 'long') THEN TRY_CAST(token AS BIGINT) END AS i,
  CASE WHEN kind = 'double' THEN TRY_CAST(token AS DOUBLE) END AS d,
  CASE WHEN kind = 'boolean' THEN lower(token) = 'true' END AS b,
  CASE WHEN kind = 'string' THEN token END AS s
FROM k""")
def n7_loose_typing(spark, sf):
    lines = inputs.recon_lines(_events(spark, sf))
    toks = lines.select(F.explode(java_split("value", ",")).alias("token")).distinct()
    return toks.select("token", J.loose_value("token").alias("v")).select("token", "v.kind", "v.i", "v.d", "v.b", "v.s")


@register("n8_relaxed_input", f"""
SELECT event_id, CAST({DK} AS BIGINT) AS k_single, CAST({DK} AS BIGINT) AS k_bare, CAST({DK} AS BIGINT) AS k_semicolon,
       event_type || ';x' AS t_semicolon, event_type = 'error' AS rejected
FROM events""")
def n8_relaxed_input(spark, sf):
    e = _events(spark, sf)
    single = F.translate("props", '"', "'")          # {'k': 69}
    bare = F.translate("props", '"', "")             # {k: 69}
    semicolon = F.concat(F.lit("{t: '"), "event_type", F.lit(";x'; k: "), _k(), F.lit(", }"))
    twice = F.when(F.col("event_type") == "error", F.lit("{k: 1, k: 2}")).otherwise(bare)
    staged = e.select("event_id", J.from_relaxed(single, "k BIGINT").alias("s"), J.from_relaxed(bare, "k BIGINT").alias("b"),
                      J.from_relaxed(semicolon, "t STRING, k BIGINT").alias("c"), J.relaxed_rejected(twice).alias("rejected"))
    return staged.select("event_id", F.col("s.k").alias("k_single"), F.col("b.k").alias("k_bare"), F.col("c.k").alias("k_semicolon"),
                         F.col("c.t").alias("t_semicolon"), "rejected")


@register("n8_relaxed_values", f"""
SELECT event_id, event_type AS bare, event_type || ' of ' || {DK} AS spaced, '00' || {DK} AS padded, event_type = 'error' AS flag,
       CAST({DK} AS BIGINT) AS key, [NULL, CAST({DK} AS BIGINT), NULL] AS places, event_type = 'click' AS rejected
FROM events""")
def n8_relaxed_values(spark, sf):
    """Bare words and numbers as values, keys that start with a digit, empty
    places of arrays; a key twice in a nested object is refused."""
    e = _events(spark, sf)
    flag = F.when(F.col("event_type") == "error", F.lit("TRUE")).otherwise(F.lit("False"))
    text = F.concat(F.lit("{a:"), "event_type", F.lit("; b: "), "event_type", F.lit(" of "), _k(), F.lit(" ,7c:00"), _k(), F.lit(",d:"), flag,
                    F.lit(",'e':"), _k(), F.lit(",f:[,"), _k(), F.lit(",,],} and more"))
    nested = F.concat(F.lit("{a:{x:"), "event_type", F.when(F.col("event_type") == "click", F.lit(",x:1")).otherwise(F.lit(",y:1")), F.lit("}}"))
    v = J.from_relaxed(text, "a string, b string, `7c` string, d boolean, e bigint, f array<bigint>")
    staged = e.select("event_id", v.alias("v"), J.relaxed_rejected(nested).alias("rejected"))
    return staged.select("event_id", F.col("v.a").alias("bare"), F.col("v.b").alias("spaced"), F.col("v.7c").alias("padded"), F.col("v.d").alias("flag"),
                         F.col("v.e").alias("key"), F.col("v.f").alias("places"), "rejected")


@register("n9_serialise", f"""
SELECT event_id, json_object('event_id', event_id, 'event_type', event_type, 'title', 'x:NaN Infinity ' || event_type,
    'value', json(CASE WHEN strpos(CAST(value AS VARCHAR), '.') > 0
                       THEN regexp_replace(CAST(value AS VARCHAR), '\\.?0+$', '') ELSE CAST(value AS VARCHAR) END),
    'k', CAST({DK} AS BIGINT), 'note', NULL)::VARCHAR AS json
FROM events""")
def n9_serialise(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", J.to_json_strict("event_id", "event_type", F.concat(F.lit("x:NaN Infinity "), "event_type").alias("title"),
                                                  J.java_number("value").alias("value"),
                                                  _k().cast("bigint").alias("k"),
                                                  F.lit(None).cast("string").alias("note")).alias("json"))


@register("n10_array_join", f"""
SELECT event_id, array_to_string(list_transform([event_type, CAST(user_id AS VARCHAR), {DK}],
                                                lambda x: to_json(x)::VARCHAR), ';') AS joined
FROM events""")
def n10_array_join(spark, sf):
    e = _events(spark, sf)
    arr = F.array("event_type", F.col("user_id").cast("string"), _k())
    return e.select("event_id", J.join_json(arr, ";").alias("joined"))


@register("n11_names_values", f"""
SELECT event_id, '{{"user":"' || CAST(user_id AS VARCHAR) || '","type":"dup"}}' AS obj,
       {DK} || ',' || CASE WHEN event_type = 'error' THEN 'null' ELSE '1' END || ',NULL' AS picked,
       '"' || {DK} || '","' || event_type || '",' || CASE WHEN {D_KIND} THEN {DK} ELSE 'NULL' END AS quoted
FROM events""")
def n11_names_values(spark, sf):
    e = _events(spark, sf)
    names = F.array(F.lit("type"), F.lit("user"), F.lit("type"))
    values = F.array("event_type", F.col("user_id").cast("string"), F.lit("dup"))
    picked = J.values_of(_obj_nullable(), F.array(F.lit("k"), F.lit("v"), F.lit("absent")))
    of_mixed = J.values_of(_obj_mixed(), F.array(F.lit("k"), F.lit("t")))        # strings keep their quotes
    of_quoted = J.values_of(_obj_quoted(), F.array(F.lit("it's")))
    return e.select("event_id", J.zip_object(names, values).alias("obj"), F.array_join(picked, ",", "NULL").alias("picked"),
                    F.array_join(F.concat(of_mixed, of_quoted), ",", "NULL").alias("quoted"))
