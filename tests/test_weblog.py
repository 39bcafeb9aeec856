"""W1-W8 on the edge table of FIXTURES.md 2.1."""

import pytest
from pyspark.sql import functions as F

from logweave.operators import weblog

# token 8 -> expected city (None = NULL)
CASES = [
    ("/pv", None), ("/pv?", ""), ("/pv?x=1", ""), ("/pv?city", " "), ("/pv?city=", ""),
    ("/pv?city=a&city=b", "b"), ("/pv?city=a=b", "a=b"), ("/pv?city=a+b%20c", "a b c"),
    ("/pv?city=a%zz", "a%zz"), ("/pv?c%69ty=q", "q"), ("/pv?&&", ""), ("/pv?city=a?b", "a?b"),
]


def _line(url):
    return f"t0 t1 t2 t3 t4 t5 t6 t7 {url} t9"


def test_city_edge_cases(spark):
    df = spark.createDataFrame([(i, _line(u)) for i, (u, _) in enumerate(CASES)], "i int, value string")
    out = {r.i: r for r in weblog.extract_requests(df, keep=("i",)).collect()}
    for i, (url, want) in enumerate(CASES):
        assert out[i].city == want, url
        assert out[i].rejected is False


def test_all_fields_and_json(spark):
    url = "/pv?city=sz&country=cn&ip=1.2.3.4&appid=7&mobile=138&imsi=460&pvuid=u1"
    df = spark.createDataFrame([(_line(url),), (_line("/pv"),)], "value string")
    recs = weblog.extract_requests(df)
    rows = recs.select(*weblog.REQUEST_FIELDS, weblog.records_as_json(recs).alias("j")).collect()
    assert tuple(rows[0][:7]) == ("sz", "cn", "1.2.3.4", "7", "138", "460", "u1")
    assert rows[0].j == '{"city":"sz","country":"cn","ip":"1.2.3.4","appid":"7","mobile":"138","imsi":"460","pvuid":"u1"}'
    assert rows[1].j == "{}"


def test_short_line_is_rejected_not_fatal(spark):
    df = spark.createDataFrame([("a b c d e f g h",), ("a b c d e f g h ",), (_line("/pv?city=x"),)], "value string")
    rows = weblog.extract_requests(df).collect()
    assert [r.rejected for r in rows] == [True, True, False]
    assert rows[0].city is None and rows[2].city == "x"


def test_strict_mode_raises(spark):
    df = spark.createDataFrame([("a b c",)], "value string")
    with pytest.raises(Exception, match="short log line"):
        weblog.extract_requests(df, strict=True).collect()


def test_partition_layout(spark):
    df = spark.createDataFrame([(_line("/pv?city=x"),)], "value string")
    out = weblog.partition_layout(weblog.extract_requests(df), "20240101")
    assert out.columns == [*weblog.REQUEST_FIELDS, "ds"]
    assert out.collect()[0].ds == "20240101"


def test_extraction_is_one_narrow_stage(spark):
    df = spark.createDataFrame([(_line("/pv?city=x"),)], "value string")
    plan = weblog.extract_requests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_token_pick_equals_full_split(spark):
    from logweave.functions.text import java_split, token_at
    from pyspark.sql import functions as F
    lines = ["", " ", "a", "a b", "   a", "a  b ", "a b c d e f g h", "a b c d e f g h ", "a b c d e f g h  x",
             "0 1 2 3 4 5 6 7 8 9", " 1 2 3 4 5 6 7 8", None]
    df = spark.createDataFrame([(l,) for l in lines], "s string")
    for i in (0, 1, 8):
        got = df.select(token_at("s", i).alias("a"), F.get(java_split("s", " "), i).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got], i
