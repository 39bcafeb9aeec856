"""F4-F5, C, D, N, H edge tables of FIXTURES.md 2.5-2.8."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from logweave.functions import convert as C
from logweave.functions import hashing as H
from logweave.functions import jsoncols as J
from logweave.functions import predicates as P


def test_optional_filters(spark):
    df = spark.createDataFrame([("x",), (None,), ("o'k",)], "c string")
    n = lambda p: df.where(P.all_of(p)).count()
    assert n(P.opt_equals("c", None)) == 3
    assert n(P.opt_equals("c", "")) == 1
    assert n(P.opt_equals("c", "o'k")) == 1
    assert n(P.opt_like("c", "")) == 1
    assert n(P.opt_like_keep_empty("c", "")) == 0
    assert n(P.opt_in("c", None)) == 3
    assert n(P.opt_in("c", [])) == 0
    assert n(P.opt_in("c", ["x"])) == 1
    assert P.quote_literal("o'k") == "'o''k'"
    for v in ["o'k", "a\\b", "\\'; DROP", "tab\\t", "''"]:
        assert spark.sql(f"SELECT {P.quote_literal(v)} AS v").collect()[0].v == v


def test_number_and_boolean(spark):
    df = spark.createDataFrame([(None, True, 300, None, 2.9, -2.9)], "n bigint, b boolean, i int, nb boolean, d double, e double")
    r = df.select(C.to_number(df, "n"), C.to_number(df, "b"), C.to_number(df, "i", "tinyint", wrap=True),
                  C.to_boolean(df, "nb"), C.to_number(df, "d"), C.to_number(df, "e")).collect()[0]
    assert tuple(r) == (0, 1, 44, False, 2, -2)
    s = spark.createDataFrame([("5",)], "s string")
    with pytest.raises(TypeError):
        C.to_number(s, "s")


def test_decimal_half_up(spark):
    df = spark.createDataFrame([(2.345, -2.345, 2.25)], "a double, b double, c double")
    r = df.select(C.to_decimal("a", 5, 2), C.to_decimal("b", 5, 2), C.to_decimal("c", 5, 1)).collect()[0]
    assert [str(x) for x in r] == ["2.35", "-2.35", "2.3"]
    bad = spark.createDataFrame([("abc",)], "s string")
    with pytest.raises(Exception, match="bad decimal"):
        bad.select(C.to_decimal("s", 5, 2)).collect()


def test_date_time_timestamp(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00.123 +08:00", "10:00:00.123 +08:00", "1-2", "-1 02:03:04.005")],
                               "ts string, t string, ym string, dt string")
    r = df.select(F.unix_millis(C.to_timestamp_zoned("ts")), C.time_millis("t"), C.interval_months("ym"),
                  C.interval_millis("dt")).collect()[0]
    assert r[0] == 1704074400123  # 02:00:00.123 UTC
    assert r[1] == 2 * 3600000 + 123   # 10:00:00.123 at +08:00 on 1970-01-01
    t = spark.createDataFrame([("22:00:00.000 -05:00",), ("01:00:00.000 +08:00",), ("08:00:00.000 Asia/Shanghai",),
                               ("10:00:00.000",), ("10:00",)][:4], "t string")
    assert [x[0] for x in t.select(C.time_millis("t")).collect()] == [97200000, -25200000, 0, 36000000]
    with pytest.raises(Exception):
        spark.createDataFrame([("10:00",)], "t string").select(C.time_millis("t")).collect()
    assert r[2] == 14
    assert r[3] == -(86400000 + 2 * 3600000 + 3 * 60000 + 4000 + 5)
    bad = spark.createDataFrame([("2024-13-01",)], "d string")
    with pytest.raises(Exception):
        bad.select(C.to_date_strict("d")).collect()


def test_strict_slice(spark):
    df = spark.createDataFrame([([10, 20, 30],)], "a array<int>")
    assert df.select(C.slice_strict("a", 2, 2)).collect()[0][0] == [20, 30]
    for i, n in [(3, 2), (0, 1), (1, -1)]:
        with pytest.raises(Exception):
            df.select(C.slice_strict("a", i, n)).collect()


def test_pick_column_first_wins(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, b int, c int").toDF("A", "a", "b")
    assert C.pick_column(df, "a").collect()[0][0] == 1
    with pytest.raises(KeyError):
        C.pick_column(df, "zz")


def test_compact_times(spark):
    df = spark.createDataFrame([("201711212010", "2017-11-2120:10")], "a string, b string")
    r = df.select(F.date_format(C.parse_compact("a"), "yyyy/MM/dd HH:mm"),
                  F.date_format(C.parse_compact("b", "yyyy-MM-ddHH:mm"), "yyyyMMdd")).collect()[0]
    assert tuple(r) == ("2017/11/21 20:10", "20171121")


LOOSE = [("", "string"), ("TRUE", "boolean"), ("null", "null"), ("12", "int"), ("9999999999", "long"),
         ("1e5", "double"), ("1.50", "double"), ("007", "string"), ("-0", "string"), (".5", "string"),
         ("+5", "string"), ("1x", "string")]


def test_loose_values(spark):
    df = spark.createDataFrame([(s,) for s, _ in LOOSE], "s string")
    got = [r.k for r in df.select(J.loose_value("s")["kind"].alias("k")).collect()]
    assert got == [k for _, k in LOOSE]


def test_json_gets(spark):
    df = spark.createDataFrame([('{"k": 69, "s": "5", "d": 1.9, "n": null}',)], "p string")
    r = df.select(J.get_strict("p", "k"), J.get_strict("p", "s"), J.get_strict("p", "d", "int"),
                  J.get_lenient("p", "zz"), J.get_lenient("p", "zz", "string"), J.get_lenient("p", "zz", "boolean"),
                  J.get_lenient("p", "zz", "double"), J.is_null_key("p", "n"), J.is_null_key("p", "zz"),
                  J.is_null_key("p", "k"), J.has_key("p", "n"), J.length("p")).collect()[0]
    assert tuple(r[:6]) == (69, 5, 1, 0, "", False)
    assert math.isnan(r[6])
    assert tuple(r[7:]) == (True, True, False, True, 4)
    with pytest.raises(Exception):
        df.select(J.get_strict("p", "zz")).collect()


def test_json_equality_and_output(spark):
    df = spark.createDataFrame([('{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1}', "[1,2]", "[2,1]")], "a string, b string, c string, d string")
    r = df.select(J.canonical("a") == J.canonical("b"), J.canonical("c") == J.canonical("d")).collect()[0]
    assert tuple(r) == (True, False)
    n = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"])], "n array<string>, v array<string>")
    r = n.select(J.zip_object("n", "v"), J.join_json("n", ",")).collect()[0]
    assert r[0] == '{"b":"2","a":"3"}' and r[1] == '"a","b","a"'
    bad = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception):
        bad.select(J.to_json_strict("x")).collect()
    rel = spark.createDataFrame([("{'k': 1}",), ("{k: 2}",)], "s string")
    assert [r[0] for r in rel.select(J.from_relaxed("s", "k int")["k"]).collect()] == [1, 2]


def test_hashes(spark):
    df = spark.createDataFrame([("abc",), ("a" * 200,)], "s string")
    rows = df.select(H.md5_hex("s"), H.sha1_hex("s"), H.base64_flat("s"), H.hmac_hex("s", b"key"),
                     H.hmac_hex("s", b"k" * 100, "sha1")).collect()
    assert rows[0][0] == "900150983cd24fb0d6963f7d28e17f72"
    assert rows[0][1] == "a9993e364706816aba3e25717850c26c9cd0d89d"
    assert rows[0][2] == "YWJj"
    assert len(rows[1][2]) == 268 and "\n" not in rows[1][2]
    assert rows[0][3] == hmac.new(b"key", b"abc", hashlib.sha256).hexdigest()
    assert rows[0][4] == hmac.new(b"k" * 100, b"abc", hashlib.sha1).hexdigest()
    junk = spark.createDataFrame([("YW\nJj!",)], "s string")
    assert junk.select(H.unbase64_lenient("s").cast("string")).collect()[0][0] == "abc"


def test_java_number_text(spark):
    df = spark.createDataFrame([(12.0,), (1.5,), (1e10,), (0.0,), (None,)], "x double")
    out = [r[0] for r in df.select(J.to_json_strict(J.java_number("x").alias("x"))).collect()]
    assert out == ['{"x":12}', '{"x":1.5}', '{"x":1.0E10}', '{"x":0}', '{"x":null}']


def test_json_getter_kinds(spark):
    rows = ['{"a": 1.9}', '{"a": "5"}', '{"a": "5.5"}', '{"a": "TRUE"}', '{"a": "yes"}', '{"a": true}',
            '{"a": 4294967297}', '{"a": null}', '{"a": [1, "x"]}', '{"b": 1}']
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    got = df.select(J.get_lenient("j", "a", "int").alias("i"), J.get_lenient("j", "a", "boolean").alias("b"),
                    J.get_lenient("j", "a", "double").alias("d"), J.get_lenient("j", "a", "string").alias("s")).collect()
    assert [r.i for r in got] == [1, 5, 0, 0, 0, 0, 1, 0, 0, 0]
    assert [r.b for r in got] == [False, False, False, True, False, True, False, False, False, False]
    assert [r.d for r in got][:3] == [1.9, 5.0, 5.5] and math.isnan(got[4].d) and math.isnan(got[5].d)
    assert [r.s for r in got] == ["1.9", "5", "5.5", "TRUE", "yes", "true", "4294967297", "", '[1,"x"]', ""]
    with pytest.raises(Exception):
        df.where("j = '{\"a\": \"yes\"}'").select(J.get_strict("j", "a", "boolean")).collect()
    with pytest.raises(Exception):
        df.where("j = '{\"a\": \"5.5\"}'").select(J.get_strict("j", "a", "bigint")).collect()


def test_strict_parsers_raise_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        bad = spark.createDataFrame([("2024-13-01", "2017-11-21x")], "d string, t string")
        with pytest.raises(Exception, match="bad date"):
            bad.select(C.to_date_strict("d")).collect()
        with pytest.raises(Exception, match="bad time"):
            bad.select(C.parse_compact("t")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_number_narrowing_like_java(spark):
    import decimal as dec
    df = spark.createDataFrame([(300.7, 1e10, float("nan"), dec.Decimal("4294967297.9"), 5000000000, -129)],
                               "d double, big double, n double, m decimal(20,1), l bigint, i int")
    r = df.select(C.to_number(df, "d", "tinyint"), C.to_number(df, "big", "tinyint"), C.to_number(df, "big", "int"),
                  C.to_number(df, "n", "int"), C.to_number(df, "m", "int"), C.to_number(df, "l", "int"),
                  C.to_number(df, "i", "tinyint"), C.to_number(df, "d", "double")).collect()[0]
    # (byte)(int)300.7, (byte)(int)1e10, (int)1e10, NaN, BigDecimal.intValue, (int)5e9L, (byte)-129
    assert tuple(r) == (44, -1, 2147483647, 0, 1, 705032704, 127, 300.7)
    with pytest.raises(Exception):
        df.select(C.to_number(df, "l", "int", wrap=False)).collect()


def test_similar_key_keeps_integers_apart(spark):
    rows = ['{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1}', '{"a":1.0,"b":[1,2]}', '{"a":1.5}', '{"a":1.50}', '[1,2]', '[2,1]']
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    k = [r[0] for r in df.select(J.similar_key("j")).collect()]
    assert k[0] == k[1] and k[0] != k[2] and k[3] == k[4] and k[5] != k[6]


def test_zip_object_put_semantics(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["1"]), (["a", "a"], ["1", None]), (["a"], ["1", "2", "3"])],
                               "n array<string>, v array<string>")
    got = [r[0] for r in df.select(J.zip_object("n", "v")).collect()]
    assert got == ['{"a":"1"}', "{}", '{"a":"1"}']


def test_json_keys_with_quotes(spark):
    df = spark.createDataFrame([("""{"it's": 5, "a": "x"}""",), ('{"a": 1}',), ("no JSON",)], "j string")
    got = df.select(J.get_lenient("j", "it's").alias("q"), J.is_null_key("j", "it's").alias("n"),
                    J.has_key("j", "it's").alias("h"), J.json_field("j", "it's").alias("f")).collect()
    assert [tuple(r) for r in got] == [(5, False, True, "5"), (0, True, False, None), (0, True, False, None)]


def test_get_many_parses_once(spark):
    df = spark.createDataFrame([(1, """{"a": 1.9, "b": "7", "c": null, "it's": "TRUE"}""")], "id int, j string")
    out = J.get_many(df, "j", {"a": ("a", "int"), "b": ("b", "bigint"), "c": ("c", "string", "-"), "q": ("it's", "boolean"), "d": ("d", "double", 1.5)}, keep=["id"])
    assert tuple(out.collect()[0]) == (1, 1, 7, "-", True, 1.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 2 and plan.count("from_json") <= 2


def test_relaxed_json(spark):
    texts = ["{a:1;b:2}", "{a:1,}", "{'a':'x\\'y;z','b':[,]}", "{a:1,a:2}", '{"a":"q;,}"}', "oops", None, '{"a":[1,,2,]}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = df.select(J.from_relaxed("j", "a STRING, b STRING").alias("v"), J.relaxed_rejected("j").alias("r")).collect()
    assert [r.r for r in got] == [False, False, False, True, False, True, False, False]
    assert [(r.v.a, r.v.b) for r in got[:3]] == [("1", "2"), ("1", None), ("x'y;z", "[null]")]
    assert got[4].v.a == "q;,}" and got[7].v.a == "[1,null,2]"


RELAXED = {
    "{a:hello}": '{"a":"hello"}', "{1a:2}": '{"1a":2}', "{a:TRUE}": '{"a":true}', "{a:007}": '{"a":"007"}',
    "{a: hello world , b:'x'}": '{"a":"hello world","b":"x"}', "{a:it's}": '{"a":"it\'s"}', "{a:1;b:2,}": '{"a":1,"b":2}',
    "[,]": "[null]", "[1,,2,]": "[1,null,2]", "[,,]": "[null,null]", "[[],{},]": "[[],{}]", "{a:nUll,b:'null'}": '{"a":null,"b":"null"}',
    "{TRUE:1,1.50:2}": '{"true":1,"1.5":2}', "{a:'say \"hi\"',b:\"it\\'s \\\\\"}": '{"a":"say \\"hi\\"","b":"it\'s \\\\"}',
    "{a:-0,b:.5,c:1.50,d:12345678901234567890,e:1e400,f:-7}": '{"a":"-0","b":".5","c":1.50,"d":"12345678901234567890","e":"1e400","f":-7}',
    "{a:'x\ty'}": '{"a":"x\\u0009y"}', "{a:\n 1 \n}": '{"a":1}', "{a:1} what follows": '{"a":1}', "{a:[{b:c}]}": '{"a":[{"b":"c"}]}',
}
REFUSED = ["[1;2]", "{a:[1;2]}", "{a:{b:1,b:2}}", "{a:1,,b:2}", "{a:1;;b:2}", "{,}", "{;}", "{a:[1}", "{a:1", "{a}", "{a:1:2}", "{a:}", "{a=1}", "{a:b/c}",
           "{a:#1}", '{a:"\\x"}', "{a:'open}", "{a:'line\nbreak'}", "{a:hello\nworld}", '{a:\\"x}', "", "  ", "5", "x{a:1}"]


def test_relaxed_grammar(spark):
    rows = [(t, w) for t, w in RELAXED.items()] + [(t, None) for t in REFUSED]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, w string")
    for r in df.select("t", "w", J.strict_text("t").alias("got"), J.relaxed_rejected("t").alias("refused")).collect():
        assert r.refused == (r.w is None), r
        assert r.w is None or r.got == r.w, r


def test_relaxed_text_of_any_length(spark):
    long = "{a:'" + "\\n\\\"x" * 30000 + "', b:[" + "1," * 20000 + "]}"
    got = spark.createDataFrame([(long,)], "t string").select(J.from_relaxed("t", "a string, b array<int>").alias("v"), J.relaxed_rejected("t").alias("r")).first()
    assert (got.r, len(got.v.a), got.v.b) == (False, 90000, [1] * 20000)


def test_similar_key_tells_numbers_apart(spark):
    texts = ['[{"a":1},{"a":2.5}]', '[{"a":1.0},{"a":2.5}]', "[1.0,2]", "[1,2.0]", "1.0", "1", "[[1]]", '{"a":"x: 1.5, y"}', "bad"]
    keys = [r.k for r in spark.createDataFrame([(t,) for t in texts], "j string").select(J.similar_key("j").alias("k")).collect()]
    assert len(set(keys)) == len(texts) and keys[-1] is None
    same = spark.createDataFrame([('{"b":1.50,"a":[1]}',), ('{ "a":[1], "b":1.5}',)], "j string")
    assert same.select(J.similar_key("j").alias("k")).distinct().count() == 1


def test_equal_numbers_have_one_similar_key(spark):
    groups = [["1.0", "1e0", "10E-1", "1.00", " 1.0 "], ["1"], ["-0", '"-0"'], ["-0.0", "-0e5"], ["0.0", "0e1"], ["0"], ["1e400", '"1e400"'],
              ["12345678901234567890", '"12345678901234567890"'], ['"1.0"'], ['{"a":[1e0,{"b":2.50,"c":1}]}', '{ "a" : [1.0, {"c":1, "b":25e-1}] }'],
              ['{"a":[1,{"b":2.5,"c":1}]}'], ['{"a":"1.0"}'], ['{"a":1.0}'], ['{"\\ufdd0":"1.0"}'], ['{"a":"x\\\\","b":"\\"1.5"}', '{"b":"\\"1.5","a":"x\\\\"}'], ["[]"], ["{}"]]
    rows = [(g, t) for g, ts in enumerate(groups) for t in ts]
    got = spark.createDataFrame(rows, "g int, t string").select("g", "t", J.similar_key("t").alias("k")).collect()
    assert all(r.k is not None for r in got), [r.t for r in got if r.k is None]
    assert len({r.k for r in got}) == len(groups) and all(len({r.k for r in got if r.g == g}) == 1 for g in range(len(groups)))
    bad = spark.createDataFrame([(t,) for t in ("01", "1.", ".5", "1e", "--1", "+1", "[1 2]", "{a:1}", "1.0.0")], "t string")
    assert [r.k for r in bad.select(J.similar_key("t").alias("k")).collect()] == [None] * 9
    loose = spark.createDataFrame([("{a:1.0;b:x}",), ('{"b":"x","a":1e0}',)], "t string").select(J.similar_key("t", relaxed=True).alias("k"))
    assert loose.distinct().count() == 1 and loose.where("k IS NULL").count() == 0


def test_interval_columns(spark):
    df = spark.createDataFrame([("1-2", "1 02:03:04.5"), ("-0-11", "-0 00:00:00.001"), (None, None), ("178956970-7", "-106751990 23:59:59.999")], "y string, d string")
    got = df.select(C.to_ym_interval("y").alias("y"), C.to_dt_interval("d").alias("d"), "y", "d")
    assert [t for _, t in got.dtypes[:2]] == ["interval year to month", "interval day to second"]
    got = df.select(C.months_of(C.to_ym_interval("y")).alias("m"), C.interval_months("y").alias("wm"), C.millis_of(C.to_dt_interval("d")).alias("s"), C.interval_millis("d").alias("ws"))
    assert all(r.m == r.wm and r.s == r.ws for r in got.collect())


def test_json_length_and_writer(spark):
    df = spark.createDataFrame([("\n[1,2]",), ("\t {\"a\":1}",)], "j string")
    assert [r.n for r in df.select(J.length("j").alias("n")).collect()] == [2, 1]
    good = spark.createDataFrame([(1.5, "Infinity War x:NaN", [1.0])], "x double, t string, a array<double>")
    kinds = [f.dataType for f in good.schema]
    assert good.select(J.to_json_strict("x", "t", "a", types=kinds)).collect()[0][0] == '{"x":1.5,"t":"Infinity War x:NaN","a":[1.0]}'
    for bad in ((float("nan"), "a", [1.0]), (1.0, "a", [float("inf")])):
        with pytest.raises(Exception, match="non-finite"):
            spark.createDataFrame([bad], good.schema).select(J.to_json_strict("x", "t", "a", types=kinds)).collect()


def test_zip_object_and_values(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["1", None, "3"]), (["x", "y"], ["1"]), ([], ["1"]), (["a"], [])], "n array<string>, v array<string>")
    assert [r.o for r in df.select(J.zip_object("n", "v").alias("o")).collect()] == ['{"a":"3"}', '{"x":"1"}', None, None]
    with pytest.raises(Exception, match="NULL name"):
        spark.createDataFrame([(["a", None], ["1", "2"])], df.schema).select(J.zip_object("n", "v")).collect()
    obj = spark.createDataFrame([("""{"a":"1","b":1,"c":null,"it's":[1, 2]}""",)], "j string")
    names = F.array(*[F.lit(k) for k in ("a", "b", "c", "it's", "zz")])
    assert obj.select(J.values_of("j", names).alias("v")).collect()[0].v == ['"1"', "1", "null", "[1,2]", None]


def test_declared_kind_and_passed_zone(spark):
    df = spark.createDataFrame([("2024-01-01 12:00:00.000",), ("2024-01-01 12:00:00.000 +08:00",), ("2024-01-01 12:00:00.000 +0800",),
                                ("2024-01-01 12:00:00.000 Asia/Shanghai",)], "t string")
    millis = lambda d, **kw: [r[0] for r in d.select(F.unix_millis(C.to_timestamp_zoned("t", **kw))).collect()]
    noon = 1704110400000
    assert millis(df) == [noon, noon - 28800000, noon - 28800000, noon - 28800000]
    assert millis(df.limit(1), zone="+02:00", zoned=False) == [noon - 7200000]
    assert millis(df.limit(1), zone="America/New_York") == [noon + 18000000]
    with pytest.raises(Exception, match="bad timestamp"):
        millis(df, zoned=True)
    with pytest.raises(Exception, match="bad timestamp"):
        millis(df, zoned=False)


def test_key_pads_stay_out_of_plans(spark):
    key = b"secret-key"
    df = spark.createDataFrame([("a",), (None,)], "t string")
    out = df.select(H.hmac_hex("t", H.key_pads(spark, key)).alias("h"))
    assert [r.h for r in out.collect()] == [hmac.new(key, b"a", hashlib.sha256).hexdigest(), None]
    text = out._jdf.queryExecution().toString().lower()
    assert not any(pad.hex() in text for pad in H._pads(key, "sha256"))
