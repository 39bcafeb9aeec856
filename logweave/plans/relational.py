"""Relational queries: predicates (F4-F8), joins (J1-J3, J5), grouping
(A2-A5), ordering and caps (O1-O4), set operations (U1-U3), schema-only
read (S11).

Joins carry no broadcast hints: Catalyst broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold`` (a checked size estimate) and AQE
re-plans with the real sizes, splitting skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import predicates as P
from logweave.operators import aggregates, relational
from logweave.plans.registry import register
from logweave.session import once, shared_dir, table

# F4 ------------------------------------------------------------------------

@register("f4_optional_filters", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1-%' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def f4_optional_filters(spark, sf):
    o = table(spark, sf, "orders")
    cond = P.all_of(
        P.opt_equals("o_orderstatus", "F"),
        P.opt_equals("o_custkey", None),          # no filter
        P.opt_like("o_orderpriority", "1-%"),
        P.opt_like_keep_empty("o_orderstatus", None),  # no filter
        P.opt_in("o_orderpriority", ["1-URGENT", "2-HIGH"]),
    )
    return o.where(cond).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def orders_with_lines(spark, sf):
    """All orders with all their lines; orders without a line have NULLs there."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return relational.outer_join(o, l, "o_orderkey", "l_orderkey", "left")


@register("f4_optional_filters_empty", """
SELECT o_orderkey, o_orderstatus FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_orderkey IS NULL OR FALSE""")
def f4_optional_filters_empty(spark, sf):
    """An empty value means IS NULL, an empty list matches nothing."""
    cond = P.opt_equals("l_orderkey", "") | P.opt_in("o_custkey", [])
    return orders_with_lines(spark, sf).where(cond).select("o_orderkey", "o_orderstatus")


@register("f5_safe_literals", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_mktsegment = 'BUILDING' OR c_name = 'Customer#000000001'' OR ''1''=''1'""")
def f5_safe_literals(spark, sf):
    c = table(spark, sf, "customer")
    return spark.sql(
        "SELECT c_custkey, c_name, c_mktsegment FROM {c} WHERE c_mktsegment = :seg OR c_name = :name",
        args={"seg": "BUILDING", "name": "Customer#000000001' OR '1'='1"},
        c=c,
    )


@register("f6_like_escape", r"""
WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 = 0 THEN p_type || '_x' ELSE p_type || ' x' END AS tag,
                  CASE WHEN p_size % 5 = 0 THEN 'PROMO%' || p_brand ELSE 'PROMO' || p_brand END AS promo FROM part)
SELECT p_partkey, p_brand LIKE 'Brand#1_' ESCAPE '\' AS one_digit, tag LIKE '%\_%' ESCAPE '\' AS underscore,
       promo LIKE 'PROMO\%%' ESCAPE '\' AS percent
FROM p""")
def f6_like_escape(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    tag = F.concat("p_type", F.when(size % 3 == 0, F.lit("_x")).otherwise(F.lit(" x")))
    promo = F.concat(F.when(size % 5 == 0, F.lit("PROMO%")).otherwise(F.lit("PROMO")), "p_brand")
    return p.select("p_partkey", F.col("p_brand").like("Brand#1_").alias("one_digit"),
                    tag.like(r"%\_%").alias("underscore"), promo.like(r"PROMO\%%").alias("percent"))


@register("f7_in_subquery", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def f7_in_subquery(spark, sf):
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {o} "
        "WHERE o_orderkey IN (SELECT l_orderkey FROM {l} WHERE l_quantity >= 49)",
        o=table(spark, sf, "orders"), l=table(spark, sf, "lineitem"),
    )


@register("f8_alias_order_expr", """
SELECT l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_quantity * 2 AS q2
FROM lineitem AS l ORDER BY l.l_extendedprice * (1 - l.l_discount) DESC NULLS LAST, l.l_orderkey, l.l_linenumber""")
def f8_alias_order_expr(spark, sf):
    # the unique tie-breakers let the range partitioner split a run of equal
    # sort values over several tasks instead of one
    return spark.sql(
        "SELECT l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_quantity * 2 AS q2 "
        "FROM {li} AS l ORDER BY l.l_extendedprice * (1 - l.l_discount) DESC NULLS LAST, l.l_orderkey, l.l_linenumber",
        li=table(spark, sf, "lineitem"),
    )


# J -------------------------------------------------------------------------

@register("j1_inner_join", """
SELECT o_orderkey, o_custkey, l_linenumber, l_quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def j1_inner_join(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey, "inner").select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


@register("j2_left_outer", """
SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def j2_left_outer(spark, sf):
    return orders_with_lines(spark, sf).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


@register("j2_right_outer", """
SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey""")
def j2_right_outer(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    o = table(spark, sf, "orders").select("o_orderkey")
    return relational.outer_join(l, o, "l_orderkey", "o_orderkey", "right").select("l_orderkey", "l_linenumber", "o_orderkey")


@register("j3_full_outer", """
SELECT o_orderkey, l_orderkey, l_linenumber FROM orders FULL OUTER JOIN lineitem ON o_orderkey = l_orderkey""")
def j3_full_outer(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return relational.outer_join(o, l, "o_orderkey", "l_orderkey", "full").select("o_orderkey", "l_orderkey", "l_linenumber")


@register("j3_full_outer_ids", """
SELECT o_orderkey, event_id, user_id FROM orders FULL OUTER JOIN events ON o_orderkey = event_id""")
def j3_full_outer_ids(spark, sf):
    """Two id ranges that overlap in part: rows without a partner on either side."""
    o = table(spark, sf, "orders").select("o_orderkey")
    e = table(spark, sf, "events").select("event_id", "user_id")
    return relational.outer_join(o, e, "o_orderkey", "event_id", "full").select("o_orderkey", "event_id", "user_id")


@register("j5_semi_join", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def j5_semi_join(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return relational.semi_join(o, l, "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


# A2-A5 ---------------------------------------------------------------------

@register("a2_group_keys_not_selected", """
SELECT sum(l_quantity) AS sum_qty, count(*) AS n_lines, avg(l_quantity) AS avg_qty
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def a2_group_keys_not_selected(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n_lines"), F.avg("l_quantity").alias("avg_qty")
    ).drop("l_returnflag", "l_linestatus")


@register("a2_group_by_expression", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_returnflag, sum(l_quantity) AS sum_qty, count(*) AS n_lines
FROM lineitem GROUP BY year(l_shipdate), l_returnflag""")
def a2_group_by_expression(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.groupBy(F.year("l_shipdate").alias("ship_year"), "l_returnflag").agg(
        F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n_lines")
    )


@register("a3_json_key_counter", """
SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 1""")
def a3_json_key_counter(spark, sf):
    return aggregates.json_key_counter(table(spark, sf, "events"), "props", "k")


@register("a3_quoted_key", """
SELECT CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') END AS value, count(*) AS n FROM events GROUP BY 1""")
def a3_quoted_key(spark, sf):
    """A key with a quote, which only some rows have."""
    key = F.when(F.col("event_type") == "view", F.lit("it's")).otherwise(F.lit("its"))
    text = F.concat(F.lit('{"'), key, F.lit('": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return aggregates.json_key_counter(table(spark, sf, "events").select(text.alias("j")), "j", "it's")


# the value is NULL for errors, so a NULL's count shows
A4_EVENTS = "(SELECT user_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events)"


def _user_kinds(spark, sf):
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, sf, "events").select("user_id", kind.alias("kind"))


@register("a4_grouped_values", f"""
SELECT user_id, kind, count(*) AS n FROM {A4_EVENTS} GROUP BY user_id, kind""")
def a4_grouped_values(spark, sf):
    return aggregates.grouped_values(_user_kinds(spark, sf), "user_id", "kind")


@register("a4_values_json", f"""
SELECT user_id, count(*) AS n,
  CASE WHEN count(*) = 1 THEN coalesce(to_json(min(kind))::VARCHAR, 'null')
       ELSE to_json(list(kind ORDER BY kind NULLS FIRST))::VARCHAR END AS values_json
FROM {A4_EVENTS} GROUP BY user_id""")
def a4_values_json(spark, sf):
    return aggregates.values_json(_user_kinds(spark, sf), "user_id", "kind")


@register("a4_value_pieces", f"""
WITH v AS (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY kind NULLS FIRST) - 1 AS i
           FROM (SELECT CASE WHEN event_id % 3 = 0 THEN -1 WHEN event_id % 100 = 1 THEN NULL ELSE user_id END AS user_id,
                        CASE WHEN event_type <> 'error' THEN event_type || event_id % 500 END AS kind FROM events))
SELECT user_id, i // 7 AS piece, count(*) AS n, to_json(list(kind ORDER BY i))::VARCHAR AS values_json
FROM v GROUP BY user_id, i // 7""")
def a4_value_pieces(spark, sf):
    """One user holds a third of all rows; seven values to a piece."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") != "error", F.concat("event_type", (F.col("event_id") % 500).cast("string")))
    user = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).when(F.col("event_id") % 100 != 1, F.col("user_id"))
    return aggregates.value_pieces(e.select(user.alias("user_id"), kind.alias("kind")), "user_id", "kind", 7, shared_dir(spark, "a4"))


@register("a5_duplicate_groups", """
SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM documents GROUP BY md5(text) HAVING count(*) > 1""")
def a5_duplicate_groups(spark, sf):
    return aggregates.duplicate_groups(table(spark, sf, "documents"), "text", "doc_id")


# O -------------------------------------------------------------------------

@register("o1_top_k", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax FROM lineitem
ORDER BY l_extendedprice DESC NULLS LAST, l_tax ASC NULLS LAST, l_orderkey, l_linenumber LIMIT 10""")
def o1_top_k(spark, sf):
    l = table(spark, sf, "lineitem")
    return relational.top_k(l, ["-l_extendedprice", "l_tax", "l_orderkey", "l_linenumber"], 10) \
        .select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")


@register("o2_order_by_unselected", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20""")
def o2_order_by_unselected(spark, sf):
    o = table(spark, sf, "orders")
    return relational.top_k(o, ["-o_totalprice", "o_orderkey"], 20).select("o_orderkey", "o_custkey")


@register("o1_no_cap", """
SELECT o_orderkey, o_totalprice FROM orders""")
def o1_no_cap(spark, sf):
    """A cap of 0 keeps every row."""
    return relational.top_k(table(spark, sf, "orders"), ["-o_totalprice", "o_orderkey"], 0).select("o_orderkey", "o_totalprice")


@register("o3_nulls_last", """
WITH n AS (SELECT o_orderkey, sum(l_quantity) AS qty FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
a AS (SELECT 'up' AS direction, o_orderkey, qty FROM n ORDER BY qty ASC NULLS LAST, o_orderkey LIMIT 25),
d AS (SELECT 'down' AS direction, o_orderkey, qty FROM n ORDER BY qty DESC NULLS LAST, o_orderkey LIMIT 25)
SELECT * FROM a UNION ALL SELECT * FROM d""")
def o3_nulls_last(spark, sf):
    """Both directions: the NULLs of orders without a line lead in neither."""
    n = orders_with_lines(spark, sf).groupBy("o_orderkey").agg(F.sum("l_quantity").alias("qty"))
    up = relational.top_k(n, ["qty", "o_orderkey"], 25).select(F.lit("up").alias("direction"), "o_orderkey", "qty")
    down = relational.top_k(n, ["-qty", "o_orderkey"], 25).select(F.lit("down").alias("direction"), "o_orderkey", "qty")
    return relational.union_all([up, down])


@register("o4_row_cap", """
SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100""")
def o4_row_cap(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return relational.row_cap(relational.order_nulls_last(l, ["l_orderkey", "l_linenumber"]), 100)


#: A switch so low that the tables take the path of large caps.
_LOW = 1000


@register("o1_top_k_by_rank", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem
ORDER BY l_shipdate DESC NULLS LAST, l_extendedprice ASC NULLS LAST, l_orderkey, l_linenumber
LIMIT (SELECT count(*) * 2 // 5 FROM lineitem)""")
def o1_top_k_by_rank(spark, sf):
    """Two fifths of the lines, found by rank selection on four keys."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return relational.top_k(l, ["-l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber"], l.count() * 2 // 5, limit_rows=_LOW)


@register("o4_row_cap_by_rank", """
WITH j AS (SELECT o_orderkey, l_linenumber, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
cap AS (SELECT count(*) // 3 AS n FROM j)
SELECT o_orderpriority, count(*) AS n FROM (SELECT * FROM j ORDER BY o_orderpriority, o_orderkey, l_linenumber LIMIT (SELECT n FROM cap))
GROUP BY o_orderpriority
UNION ALL SELECT 'any', n FROM cap UNION ALL SELECT 'any, in the join', n FROM cap""")
def o4_row_cap_by_rank(spark, sf):
    """A third of a join's rows: of a sorted one the first, of another any,
    all of which are rows of the join.

    Rank selection evaluates its frame some times, so the join is written once
    and read from there: both tables are shuffled once, not in every round."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    j = once(spark, o.join(l, o.o_orderkey == l.l_orderkey).select("o_orderkey", "l_linenumber", "o_orderpriority"), "o4")
    n = j.count() // 3
    first = relational.row_cap(relational.order_nulls_last(j, ["o_orderpriority", "o_orderkey", "l_linenumber"]), n, limit_rows=_LOW)
    some = relational.row_cap(j, n, limit_rows=_LOW)
    counted = first.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return relational.union_all([
        counted, some.agg(F.count("*").alias("n")).select(F.lit("any").alias("o_orderpriority"), "n"),
        some.join(j.distinct(), j.columns, "left_semi")
        .agg(F.count("*").alias("n")).select(F.lit("any, in the join").alias("o_orderpriority"), "n")])


# U, S11 --------------------------------------------------------------------

U1_SLICES = 4


@register("u1_path_list_read", """
SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS sum_user FROM events GROUP BY event_type""")
def u1_path_list_read(spark, sf):
    """Events written as four slice folders, then all four read in one scan
    over the path list (not four reads and three unions)."""
    root = shared_dir(spark, "u1")
    e = table(spark, sf, "events")
    e.withColumn("slice", F.pmod(F.xxhash64("event_id"), F.lit(U1_SLICES))).write.partitionBy("slice").parquet(root)
    paths = [f"{root}/slice={i}" for i in range(U1_SLICES)]
    df = spark.read.option("basePath", root).parquet(*paths)
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("sum_user"))


@register("u2_union_all", """
SELECT o_custkey AS id, 'orders' AS src FROM orders UNION ALL SELECT user_id AS id, 'events' AS src FROM events""")
def u2_union_all(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit("orders").alias("src"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.lit("events").alias("src"))
    return relational.union_all([o, e])


@register("u3_union_distinct", """
SELECT o_custkey AS id FROM orders UNION SELECT user_id AS id FROM events""")
def u3_union_distinct(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return relational.union_distinct([o, e])


@register("s11_schema_only", "SELECT * FROM lineitem LIMIT 0")
def s11_schema_only(spark, sf):
    return relational.schema_only(table(spark, sf, "lineitem"))
