"""Property tests: Spark expressions against small Python models of the Java rules.

Each example is a batch of generated strings checked in one Spark job.
"""

import os
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logweave.functions import text, urls
from logweave.operators import weblog

# Deterministic by default (a green suite stays green); PROPERTY_RANDOM=1 and
# PROPERTY_EXAMPLES=<n> explore new examples.
SETTINGS = settings(max_examples=int(os.environ.get("PROPERTY_EXAMPLES", "15")), deadline=None,
                    derandomize=os.environ.get("PROPERTY_RANDOM") is None, database=None,
                    suppress_health_check=list(HealthCheck))


def java_split(s: str, sep: str) -> list[str]:
    """``String.split`` of a one-character literal: trailing empty tokens removed."""
    if s == "":
        return [""]
    parts = s.split(sep)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def java_parse_long(s: str) -> int:
    if not re.fullmatch(r"[+-]?[0-9]+", s):
        return 0
    v = int(s)
    return v if -(2**63) <= v < 2**63 else 0


def _java_parse_hex(two: str) -> int:
    """``Integer.parseInt(two, 16)``: an optional sign, then hex digits."""
    body = two[1:] if two[:1] in "+-" else two
    if not body or any(ch not in "0123456789abcdefABCDEF" for ch in body):
        raise ValueError(two)
    v = int(body, 16)
    return -v if two[:1] == "-" else v


def java_url_decode(s: str) -> str:
    """``URLDecoder.decode(s, UTF-8)``; the raw text is kept when it throws.

    Runs of ``%xx`` become bytes decoded as UTF-8; each ``xx`` is read with
    ``Integer.parseInt(xx, 16)``, so ``%+a`` is a newline and ``%-a`` throws.
    """
    out, i, n = [], 0, len(s)
    try:
        while i < n:
            c = s[i]
            if c == "+":
                out.append(" ")
                i += 1
            elif c == "%":
                buf = bytearray()
                while i + 2 < n and s[i] == "%":
                    v = _java_parse_hex(s[i + 1:i + 3])
                    if v < 0:
                        raise ValueError("negative escape")
                    buf.append(v)
                    i += 3
                if i < n and s[i] == "%":
                    raise ValueError("incomplete escape")
                out.append(buf.decode("utf-8", errors="replace"))
            else:
                out.append(c)
                i += 1
    except ValueError:
        return s
    return "".join(out)


def reference_fields(url: str, names: list[str]) -> list:
    """The log job's parse: split at the first '?', '&' entries, '=' once, decode, last wins."""
    i = url.find("?")
    if i < 0:
        return [None] * len(names)
    params = {}
    for kv in java_split(url[i + 1:], "&"):
        if "=" not in kv:
            kv = kv + "= "
        k, v = kv.split("=", 1)
        params[java_url_decode(k)] = java_url_decode(v)
    return [params.get(n, "") for n in names]


lines = st.lists(st.text(alphabet="ab ,", max_size=12), min_size=1, max_size=40)
numbers = st.lists(st.one_of(st.text(alphabet="+-0123456789 .x", max_size=21),
                             st.integers(-(2**64), 2**64).map(str)), min_size=1, max_size=40)
url_chars = st.sampled_from(["a", "b", "c", "=", "&", "?", "+", "%", "%2", "%41", "%zz", "%26", "%3D", "%20", "c%69ty", "city",
                             "%+a", "%-a", "%+", "-"])
url_list = st.lists(st.lists(url_chars, max_size=12).map("".join), min_size=1, max_size=40)


@SETTINGS
@given(lines)
def test_java_split_and_token_pick(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select(text.java_split("s", ",").alias("c"), text.java_split("s", " ").alias("b"),
                     *[text.token_at("s", i).alias(f"t{i}") for i in (0, 2, 8)]).collect()
    for v, r in zip(values, rows):
        assert r.c == java_split(v, ","), v
        assert r.b == java_split(v, " "), v
        toks = java_split(v, " ")
        for i in (0, 2, 8):
            want = toks[i] if i < len(toks) and not (v != "" and toks == []) else None
            assert r[f"t{i}"] == want, (v, i)


@SETTINGS
@given(numbers)
def test_parse_long(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(text.parse_long_or_zero("s")).collect()]
    assert got == [java_parse_long(v) for v in values]


@SETTINGS
@given(url_list)
def test_decode_and_field_pick(spark, values):
    names = ["city", "a", "b", ""]
    df = spark.createDataFrame([(v,) for v in values], "u string")
    picked = weblog.with_request_fields(df.withColumn("d", urls.decode_or_raw("u")), "u", names, keep=("u", "d"))
    rows = picked.toDF("u", "d", *[f"f{i}" for i in range(len(names))]).collect()
    for v, r in zip(values, rows):
        assert r.d == java_url_decode(v), v
        assert [r[f"f{i}"] for i in range(len(names))] == reference_fields(v, names), v


def java_length(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def reference_classify(line: str):
    w = java_split(line, ",")
    if len(w) < 3:
        return None
    if java_length(w[2]) > 18:
        return (w[-2], 0, 1)
    return (w[0], java_parse_long(w[2]), 0)


def reference_loose(s: str) -> str:
    if s == "":
        return "string"
    if s.lower() in ("true", "false"):
        return "boolean"
    if s.lower() == "null":
        return "null"
    if s[0] in "0123456789-":
        if any(ch in s for ch in ".eE"):
            try:
                d = float(s)
                if d == d and abs(d) != float("inf"):
                    return "double"
            except ValueError:
                pass
        elif re.fullmatch(r"-?[0-9]+", s) and -(2**63) <= int(s) < 2**63 and str(int(s)) == s:
            return "int" if -(2**31) <= int(s) < 2**31 else "long"
    return "string"


token = st.one_of(st.text(alphabet="ab1-", max_size=4), st.integers(-99, 10**20).map(str),
                  st.just("12345678901234567890"), st.just("2024-01-01T00:00:00.123456"), st.just("x\U0001F600" * 9))
recon_lines = st.lists(st.lists(token, max_size=6).map(",".join), min_size=1, max_size=40)
loose_tokens = st.lists(st.one_of(st.text(alphabet="0123456789-.eE", max_size=8),
                                  st.sampled_from(["TRUE", "False", "null", "NULL", "", "007", "-0", "1e400", "9223372036854775808"]),
                                  st.integers(-(2**64), 2**64).map(str)), min_size=1, max_size=40)


@SETTINGS
@given(recon_lines)
def test_classify_matches_reference(spark, values):
    from logweave.operators import reconcile
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    got = {r.i: (r.key, r.reported, r.actual) for r in reconcile.classify(df, keep=("i",)).collect()}
    for i, v in enumerate(values):
        assert got.get(i) == reference_classify(v), v


@SETTINGS
@given(loose_tokens)
def test_loose_typing_matches_reference(spark, values):
    from logweave.functions import jsoncols as J
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(J.loose_value("s")["kind"]).collect()]
    assert got == [reference_loose(v) for v in values], values


def reference_canonical(qs: str) -> str:
    params = {}
    for kv in java_split(qs, "&"):
        k, _, v = kv.partition("=")
        params[k] = v
    if not params:
        return ""
    return "?" + "&".join(f"{k.replace('_', '.')}={params[k]}" for k in sorted(params))


query_strings = st.lists(st.lists(st.sampled_from(["a=1", "b_c=2", "a=3", "d", "=x", "e=", "&", "z_z=q=r"]), max_size=8)
                         .map("".join), min_size=1, max_size=40)


@SETTINGS
@given(query_strings)
def test_canonical_params_matches_reference(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "q string")
    got = [r[0] for r in df.select(urls.canonical_params("q")).collect()]
    assert got == [reference_canonical(v) for v in values], values


ZONES = ["+08:00", "-05:00", "+00:00", "Z", "+0530", "Asia/Shanghai", "America/New_York", "Europe/Berlin", "UTC"]


def _zone(z: str):
    import datetime as dt
    from zoneinfo import ZoneInfo
    if z == "Z":
        return dt.timezone.utc
    if z[0] in "+-":
        h, m = int(z[1:3]), int(z[-2:])
        sign = 1 if z[0] == "+" else -1
        return dt.timezone(sign * dt.timedelta(hours=h, minutes=m))
    return ZoneInfo(z)


stamps = st.lists(st.tuples(st.datetimes(min_value=__import__("datetime").datetime(1971, 1, 1),
                                         max_value=__import__("datetime").datetime(2037, 12, 31)),
                            st.sampled_from(ZONES)), min_size=1, max_size=30)


@SETTINGS
@given(stamps)
def test_zoned_times_match_python(spark, values):
    """The same text gives the same instant as Python's zone rules
    (time values are taken on 1970-01-01)."""
    import datetime as dt
    from pyspark.sql import functions as Fn
    from logweave.functions import convert as C
    texts = [(f"{d:%Y-%m-%d %H:%M:%S}.{d.microsecond // 1000:03d} {z}", f"{d:%H:%M:%S}.{d.microsecond // 1000:03d} {z}")
             for d, z in values]
    df = spark.createDataFrame(texts, "ts string, t string")
    got = df.select(Fn.unix_millis(C.to_timestamp_zoned("ts")).alias("a"), C.time_millis("t").alias("b")).collect()
    for (d, z), r in zip(values, got):
        local = d.replace(microsecond=d.microsecond // 1000 * 1000)
        want_ts = int(round(local.replace(tzinfo=_zone(z)).timestamp() * 1000))
        day = dt.datetime(1970, 1, 1, local.hour, local.minute, local.second, local.microsecond, tzinfo=_zone(z))
        assert (r.a, r.b) == (want_ts, int(round(day.timestamp() * 1000))), (d, z)
