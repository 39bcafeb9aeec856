"""Strict value conversion (C1-C11) and compact time handling.

The rules follow the result-set getters of the SQL client: NULL becomes 0 for
numbers and FALSE for booleans, other NULLs stay NULL, wrong kinds raise.
Type checks happen when the plan is built (the schema is known), so the
per-row work is a plain cast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _field(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _wrap_bits(v: Column, bits: int) -> Column:
    """Two's-complement truncation of a BIGINT to ``bits`` bits."""
    return v if bits == 64 else F.shiftright(F.shiftleft(v, 64 - bits), 64 - bits)


def to_number(df: DataFrame, name: str, target: str = "bigint", wrap: bool = True) -> Column:
    """NULL -> 0, boolean -> 1/0, number -> ``target``; other kinds raise.

    Narrowing follows ``Number.byteValue()/shortValue()/intValue()/longValue()``:
    integral values keep their low bits (300 -> 44 as tinyint); floating
    values truncate toward zero and saturate at the int range (long range
    for ``bigint``) before the low bits are kept, NaN gives 0; decimals keep
    the low bits of their integer part. ``wrap=False`` keeps Spark's
    overflow error instead.
    """
    dt = _field(df, name)
    c = F.col(name)
    if isinstance(dt, T.BooleanType):
        v = F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    elif isinstance(dt, _NUMERIC):
        v = c
    else:
        raise TypeError(f"column {name} of type {dt.simpleString()} is not a number")
    if target not in _INTEGRAL_BITS:
        return F.coalesce(v.cast(target), F.lit(0).cast(target))
    bits = _INTEGRAL_BITS[target]
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        d = v.cast("double")
        lo, hi = (-(2**63), 2**63 - 1) if bits == 64 else (-(2**31), 2**31 - 1)
        whole = (F.when(F.isnan(d), F.lit(0)).when(d >= float(hi), F.lit(hi)).when(d <= float(lo), F.lit(lo))
                 .otherwise(F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)))).cast("bigint")
    elif isinstance(dt, T.DecimalType):
        intpart = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast(T.DecimalType(38, 0))
        if wrap:  # low 64 bits of the integer part
            two64, two63 = F.lit(Decimal(2**64)), F.lit(Decimal(2**63))
            low = F.pmod(intpart, two64)
            whole = F.when(low >= two63, low - two64).otherwise(low).cast("bigint")
        else:
            whole = intpart
    else:
        whole = v.cast("bigint")
    if wrap:
        whole = _wrap_bits(whole, bits)
    return F.coalesce(whole.cast(target), F.lit(0).cast(target))


def to_boolean(df: DataFrame, name: str) -> Column:
    """NULL -> FALSE; anything but a boolean column raises."""
    dt = _field(df, name)
    if not isinstance(dt, T.BooleanType):
        raise TypeError(f"column {name} of type {dt.simpleString()} is not a boolean")
    return F.coalesce(F.col(name), F.lit(False))


def to_text(c: Column | str) -> Column:
    """NULL stays NULL."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def to_decimal(c: Column | str, precision: int, scale: int) -> Column:
    """C4: through the text form, rescaled HALF_UP (2.345 -> 2.35, -2.345 -> -2.35).

    Text that is not a number, or a value too wide for ``precision``, raises.
    """
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    return _or_raise(text, text.try_cast(T.DecimalType(precision, scale)), "decimal")


def _or_raise(c: Column, parsed: Column, what: str) -> Column:
    """``parsed``, raising for text that does not parse (in any ANSI mode)."""
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit(f"bad {what}: "), c))).otherwise(parsed)


def to_date_strict(c: Column | str) -> Column:
    """ISO ``yyyy-MM-dd``; bad text raises."""
    c = F.col(c) if isinstance(c, str) else c
    return _or_raise(c, F.try_to_date(c, "yyyy-MM-dd"), "date")


def time_millis(c: Column | str, zone: str | None = None, zoned: bool | None = None) -> Column:
    """``HH:mm:ss.SSS`` with an optional offset or zone id -> epoch millis
    of that time on 1970-01-01.

    Without a zone in the text ``zone`` applies, or the session time zone (as
    the client used its session zone); with one, that zone's offset on
    1970-01-01. The value is not folded into one day: 22:00 at -05:00 gives
    97,200,000. ``zoned`` is the declared kind, see :func:`to_timestamp_zoned`.
    Bad text raises.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_millis(to_timestamp_zoned(F.concat(F.lit("1970-01-01 "), c), zone, zoned))


_LOCAL = "yyyy-MM-dd HH:mm:ss.SSS"
#: What the end of a text with a zone looks like, and the pattern that reads it.
_ZONES = ((r" [+-][0-9]{2}:[0-9]{2}$", "XXX"), (r" [+-][0-9]{4}$", "xx"), (r" [A-Za-z][A-Za-z0-9_/+-]*$", "VV"))


def to_timestamp_zoned(c: Column | str, zone: str | None = None, zoned: bool | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` with an optional offset or zone id.

    Text without a zone is read in ``zone``, or in the session time zone.
    ``zoned`` is the declared kind of the column: True for a type with a time
    zone (text without one is an error), False for one without (text with one
    is an error), None for either. The end of the text says which pattern it
    has, so it is parsed once. Result is an instant (``TIMESTAMP``); other
    text raises.
    """
    c = F.col(c) if isinstance(c, str) else c

    def local(x: Column) -> Column:
        if zone is None:
            return F.try_to_timestamp(x, F.lit(_LOCAL))
        return F.try_to_timestamp(F.concat(x, F.lit(" " + zone)), F.lit(f"{_LOCAL} {'XXX' if zone[:1] in '+-' else 'VV'}"))

    def parsed(x: Column) -> Column:
        out = F.lit(None).cast("timestamp") if zoned else local(x)
        for tail, pattern in reversed(_ZONES):
            found = F.lit(None).cast("timestamp") if zoned is False else F.try_to_timestamp(x, F.lit(f"{_LOCAL} {pattern}"))
            out = F.when(x.rlike(tail), found).otherwise(out)
        return out

    return F.coalesce(parsed(c), F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("bad timestamp: "), c)).cast("timestamp")))


def interval_months(c: Column | str) -> Column:
    """Year-month interval text ``[-]Y-M`` -> total months (INT)."""
    c = F.col(c) if isinstance(c, str) else c
    rx = r"^(-?)([0-9]+)-([0-9]+)$"
    sign = F.when(F.regexp_extract(c, rx, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    v = sign * (F.regexp_extract(c, rx, 2).cast("int") * 12 + F.regexp_extract(c, rx, 3).cast("int"))
    return F.when(c.isNull(), F.lit(None).cast("int")).when(
        ~c.rlike(rx), F.raise_error(F.concat(F.lit("bad interval: "), c)).cast("int")
    ).otherwise(v)


def interval_millis(c: Column | str) -> Column:
    """Day-time interval text ``[-]D HH:MM:SS[.mmm]`` -> total millis (BIGINT)."""
    c = F.col(c) if isinstance(c, str) else c
    rx = r"^(-?)([0-9]+) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,3}))?$"
    g = lambda i: F.regexp_extract(c, rx, i)
    sign = F.when(g(1) == "-", F.lit(-1)).otherwise(F.lit(1))
    ms = F.rpad(F.when(g(6) == "", F.lit("0")).otherwise(g(6)), 3, "0").cast("bigint")
    v = sign * (g(2).cast("bigint") * 86400000 + g(3).cast("bigint") * 3600000
                + g(4).cast("bigint") * 60000 + g(5).cast("bigint") * 1000 + ms)
    return F.when(c.isNull(), F.lit(None).cast("bigint")).when(
        ~c.rlike(rx), F.raise_error(F.concat(F.lit("bad interval: "), c)).cast("bigint")
    ).otherwise(v)


def to_ym_interval(c: Column | str) -> Column:
    """Year-month interval text as an ``INTERVAL YEAR TO MONTH``."""
    return F.make_ym_interval(F.lit(0), interval_months(c))


def to_dt_interval(c: Column | str) -> Column:
    """Day-time interval text as an ``INTERVAL DAY TO SECOND``."""
    ms = interval_millis(c)
    days, rest = F.floor(ms / 86400000), F.pmod(ms, F.lit(86400000))
    return F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), (rest / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,6)"))


def months_of(c: Column | str) -> Column:
    """Total months of an ``INTERVAL YEAR TO MONTH`` (INT)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("interval month").cast("int")


def millis_of(c: Column | str) -> Column:
    """Total milliseconds of an ``INTERVAL DAY TO SECOND`` (BIGINT)."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("interval second").cast("decimal(24,6)") * 1000).cast("bigint")


def slice_strict(arr: Column | str, index: int | Column, count: int | Column) -> Column:
    """1-based slice; ``index < 1``, ``count < 0`` or running past the
    end raises instead of truncating."""
    a = F.col(arr) if isinstance(arr, str) else arr
    i = index if isinstance(index, Column) else F.lit(index)
    n = count if isinstance(count, Column) else F.lit(count)
    bad = (i < 1) | (n < 0) | (i - 1 + n > F.size(a))
    return (
        F.when(a.isNull(), a)
        .when(bad, F.raise_error(F.lit("array slice out of bounds")))
        .otherwise(F.slice(a, i, F.greatest(n, F.lit(0))))
    )


def pick_column(df: DataFrame, label: str) -> DataFrame:
    """One column by case-insensitive label; the first duplicate wins.

    Spark refuses ambiguous names, so the column is found by position and
    the frame renamed positionally before the select.
    """
    cols = df.columns
    hits = [i for i, c in enumerate(cols) if c.lower() == label.lower()]
    if not hits:
        raise KeyError(f"no column labelled {label!r}")
    tmp = [f"_c{i}" for i in range(len(cols))]
    return df.toDF(*tmp).select(F.col(tmp[hits[0]]).alias(label.lower()))


def to_bytes(c: Column | str) -> Column:
    """C11: raw bytes (UTF-8 for strings)."""
    return (F.col(c) if isinstance(c, str) else c).cast("binary")


# D1-D3 ---------------------------------------------------------------------

def parse_compact(c: Column | str, pattern: str = "yyyyMMddHHmm") -> Column:
    """Compact time text (``yyyyMMddHHmm`` or ``yyyy-MM-ddHH:mm``); bad text raises."""
    c = F.col(c) if isinstance(c, str) else c
    return _or_raise(c, F.try_to_timestamp(c, F.lit(pattern)), "time")


def day_folder(ts: Column | str) -> Column:
    """``yyyy/MM/dd`` folder of a time."""
    return F.date_format(ts, "yyyy/MM/dd")


def day_key(ts: Column | str) -> Column:
    """``yyyyMMdd`` partition value of a time."""
    return F.date_format(ts, "yyyyMMdd")


def strictly_between(ts: Column | str, start: str, end: str, ntz: bool = True) -> Column:
    """D3: ``start < ts < end``, both ends open; bounds given as text.

    Bounds are cast to the column's kind (``timestamp_ntz`` by default), so
    no time-zone shift enters the comparison.
    """
    t = F.col(ts) if isinstance(ts, str) else ts
    kind = "timestamp_ntz" if ntz else "timestamp"
    return (t > F.lit(start).cast(kind)) & (t < F.lit(end).cast(kind))


def epoch_millis(ts: Column | str) -> Column:
    """Epoch milliseconds of a ``TIMESTAMP_NTZ`` wall-clock time read as UTC."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
