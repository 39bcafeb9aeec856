"""M1 declared attributes, O4 caps, U and S11."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from logweave.operators import profile, ranks, relational


def test_profile_attributes(spark):
    df = spark.createDataFrame(
        [(1, "ab", 2.5, True, decimal.Decimal("1.25"), dt.date(2024, 1, 1), None)],
        "a bigint, B string, c double, d boolean, e decimal(12,2), f date, g int")
    rows = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert (rows["a"].type_name, rows["a"].jdbc_type, rows["a"].display_width) == ("bigint", -5, 20)
    assert (rows["b"].type_name, rows["b"].jdbc_type, rows["b"].max_width) == ("varchar", -16, 2)
    assert (rows["e"].precision, rows["e"].scale, rows["e"].display_width) == (12, 2, 14)
    assert rows["f"].class_name == "java.sql.Date" and rows["g"].null_count == 1
    assert all(r.width_ok for r in rows.values())


def test_nested_profile(spark):
    df = spark.createDataFrame(
        [(1, {"a": [{"x": "ab", "y": None}, None]}, [[1.5], None, [None, 22.25]], (None, [b"abc"])), (None, {}, None, None), (3, None, [], (dt.date(2024, 1, 1), []))],
        "i int, m map<string,array<struct<x:string,y:bigint>>>, n array<array<double>>, s struct<d:date,b:array<binary>>")
    got = {r.path: (r.type_name, r.value_count, r.null_count, r.max_width) for r in profile.nested_profile(df).collect()}
    assert got == {"i": ("integer", 3, 1, 1), "m.key": ("varchar", 1, 0, 1), "m.value.element.x": ("varchar", 2, 1, 2), "m.value.element.y": ("bigint", 2, 2, 0),
                   "n.element.element": ("double", 3, 1, 5), "s.d": ("date", 3, 2, 10), "s.b.element": ("varbinary", 1, 0, 3)}
    assert all(r.value_count == 0 and r.width_ok for r in profile.nested_profile(df.limit(0)).collect())


def test_row_cap(spark):
    df = spark.range(10)
    assert relational.row_cap(df, 0).count() == 10
    assert relational.row_cap(df, 3).count() == 3
    with pytest.raises(ValueError):
        relational.row_cap(df, -1)
    with pytest.raises(ValueError):
        relational.row_cap(df, 2**63)
    assert relational.row_cap(df, 2**40).count() == 10
    assert relational.top_k(df, [df.columns[0]], 0).count() == 10
    assert relational.top_k(df, [df.columns[0]], 4).count() == 4


def test_large_cap_of_a_sorted_frame(spark):
    df = spark.range(0, 1000, 1, 7)
    for n in (11, 999, 1000, 5000):
        got = relational.row_cap(df.orderBy("id"), n, limit_rows=10)
        assert [r.id for r in got.collect()] == list(range(min(n, 1000)))
    top = relational.top_k(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), ["-x"], 50, limit_rows=10)
    assert [r.x for r in top.collect()] == list(range(999, 949, -1))


@pytest.mark.parametrize("partitions,coalesce", [(8, "true"), (200, "true"), (200, "false")])
def test_large_caps_are_exact(spark, monkeypatch, partitions, coalesce):
    monkeypatch.setattr(ranks, "SMALL", 20)
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", partitions)
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    left = own.range(6000).select((F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    joined = left.join(own.range(50).select(F.col("id").alias("k"), (F.col("id") * 3).alias("b")), "k")
    for n in (2500,):
        sorted_ = relational.row_cap(joined.orderBy(F.desc("b"), "a"), n, limit_rows=100)
        assert [tuple(r) for r in sorted_.collect()] == [tuple(r) for r in joined.orderBy(F.desc("b"), "a").collect()][:n]
        some = relational.row_cap(joined, n, limit_rows=100)
        rows = [tuple(r) for r in some.collect()]
        assert len(rows) == len(set(rows)) == n and some.exceptAll(joined).count() == 0


def test_large_caps_with_ties_nulls_and_types(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 5)
    ts = dt.datetime(2024, 3, 31, 2, 30)
    data = [(i % 3 or None, float("nan") if i % 7 == 0 else i % 5 - 0.5, "x" * (i % 4), bytearray([i % 6, 255]), ts + dt.timedelta(microseconds=i % 9),
             dt.date(1900 + i % 11, 1, 1), decimal.Decimal(i % 13) / 100, {"m": i % 2}) for i in range(600)]
    df = spark.createDataFrame(data, "a int, b double, c string, d binary, e timestamp_ntz, f date, g decimal(5,2), h map<string,int>")
    df = df.withColumn("t", F.col("e").cast("timestamp"))
    for keys, n in ((["a", "-b"], 300), (["d", "-e"], 31), (["-t", "f", "g"], 599), (["-d", "-f", "-b"], 301)):
        got = relational.top_k(df, keys, n, limit_rows=10).cache()
        of = [k.lstrip("-") for k in keys]
        want = relational.order_nulls_last(df, keys).select(*of).limit(n).collect()
        assert repr(got.select(*of).collect()) == repr(want) and got.select("a", "c", "f").exceptAll(df.select("a", "c", "f")).count() == 0
    same = spark.range(500).select(F.lit(1).alias("x"), F.lit(None).cast("string").alias("y"))
    monkeypatch.setattr(ranks, "_COPIES", 64)
    assert [tuple(r) for r in relational.row_cap(same, 433, limit_rows=10).collect()] == [(1, None)] * 433
    assert relational.top_k(same, ["y"], 433, limit_rows=10).count() == 433
    assert relational.row_cap(df.limit(0), 50, limit_rows=10).count() == 0


def test_cap_of_a_frame_sorted_by_a_dropped_column(spark):
    df = spark.range(100).select(F.col("id"), (-F.col("id")).alias("k"))
    with pytest.raises(ValueError):
        relational.row_cap(df.orderBy(F.col("k") % 10).select("id"), 50, limit_rows=10)
    assert [r.id for r in relational.row_cap(df.orderBy("k").select("id", F.col("k").alias("z")), 50, limit_rows=10).collect()] == list(range(99, 49, -1))


def test_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r.x for r in relational.order_nulls_last(df, ["x"]).collect()] == [1, 3, None]
    assert [r.x for r in relational.order_nulls_last(df, ["-x"]).collect()] == [3, 1, None]


def test_unions_and_schema_only(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert relational.union_all([a, b]).count() == 3
    assert relational.union_distinct([a, b]).count() == 2
    z = relational.schema_only(a)
    assert z.count() == 0 and z.columns == ["x"]


def _skewed(spark):
    # one key holds a third of the rows, one left key has no match, one is NULL
    left = spark.createDataFrame([(k,) for k in [1, 2, 3, 4, None]], "lk int")
    right = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 100 + i) for i in range(60)] + [(3, 999)],
                                  "rk int, v int")
    return left, right


def test_outer_join_equals_plain_outer_join(spark):
    left, right = _skewed(spark)
    got = sorted(map(tuple, relational.outer_join(left, right, "lk", "rk", "left").collect()), key=repr)
    want = sorted(map(tuple, left.join(right, left.lk == right.rk, "left").collect()), key=repr)
    assert got == want and len(got) == 93
    got = sorted(map(tuple, relational.outer_join(right, left, "rk", "lk", "right").collect()), key=repr)
    want = sorted(map(tuple, right.join(left, right.rk == left.lk, "right").collect()), key=repr)
    assert got == want
    more = right.unionByName(spark.createDataFrame([(None, 7), (55, 8)], "rk int, v int"))
    got = sorted(map(tuple, relational.outer_join(left, more, "lk", "rk", "full").collect()), key=repr)
    want = sorted(map(tuple, left.join(more, left.lk == more.rk, "full").collect()), key=repr)
    assert got == want and len(got) == 95


def test_semi_join_uses_distinct_keys(spark):
    left, right = _skewed(spark)
    out = relational.semi_join(left, right, "lk", "rk")
    assert sorted(r.lk for r in out.collect()) == [1, 2, 3]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan


def test_declared_time_and_arrays():
    from pyspark.sql import types as T

    if hasattr(T, "TimeType"):
        assert profile.declared(T.TimeType())[:2] == ("time", 92)
    assert profile.declared(T.TimestampNTZType())[1] == profile.declared(T.TimestampType())[1] == 93
    assert profile.element_code(T.ArrayType(T.DateType())) == 91 and profile.element_code(T.DateType()) is None
