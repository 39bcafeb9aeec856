"""JSON columns (N1-N11): typed gets, keys, equality, loose typing, output.

Text JSON is parsed with the built-in JSON expressions (``get_json_object``,
``json_object_keys``, ``from_json``) or into ``VARIANT`` (``parse_json``);
no Python per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

# Fixed values that must match the reference's lenient getters (N2):
# boolean false, int/long 0, double NaN, string "".
LENIENT_DEFAULTS = {"boolean": False, "int": 0, "bigint": 0, "double": float("nan"), "string": ""}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _path(key: str) -> str:
    """A VARIANT path to a key; the quote that the key does not hold encloses it."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' in key:
        raise ValueError(f"JSON key {key!r} holds both kinds of quotes")
    return f'$["{key}"]'


def json_field(c: Column | str, key: str) -> Column:
    """The value at ``key`` as text (strings without quotes), whatever
    characters the key has; NULL for a missing key or a JSON null."""
    if "'" not in key:
        return F.get_json_object(_col(c), f"$['{key}']")
    return F.get(F.transform(F.array(F.from_json(_col(c), "map<string,string>")), lambda m: F.element_at(m, F.lit(key))), 0)


def _typed(v: Column, t: Column, raw: Column, kind: str) -> tuple[Column, Column]:
    """``(ok, value)``: what the strict getter returns, and whether it would succeed.

    ``v`` is the value as VARIANT, ``t`` its type, ``raw`` its text. The
    reference parser makes a Double of number text with ``.``/``e``/``E`` and
    an Integer/Long otherwise; the VARIANT type alone cannot tell ``28.0`` from
    ``28``, the raw text can. Numbers convert like ``Number.xxxValue()``
    (integral values wrap to int, fractions truncate and saturate); strings
    parse like ``Long.parseLong`` / ``Integer.parseInt`` /
    ``Double.parseDouble``; booleans accept JSON booleans and the strings
    ``true``/``false`` in any case; ``string`` accepts only strings. A missing
    key or JSON null fails every kind.
    """
    is_num = (t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL")
    is_frac = is_num & (raw.contains(".") | raw.contains("e") | raw.contains("E"))
    is_int = is_num & ~is_frac
    is_str = t == "STRING"
    s = F.try_variant_get(v, "$", "string")
    d = F.try_variant_get(v, "$", "double")
    if kind == "boolean":
        low = F.lower(s)
        ok = (t == "BOOLEAN") | (is_str & low.isin("true", "false"))
        return ok, F.when(ok, low == "true")
    if kind == "string":
        return is_str, F.when(is_str, s)
    if kind == "double":
        parsed = F.trim(s).try_cast("double")
        ok = is_num | (is_str & parsed.isNotNull())
        return ok, F.when(is_str, parsed).when(ok, d)
    if kind in ("bigint", "int"):
        lo, hi = (-(2**63), 2**63 - 1) if kind == "bigint" else (-(2**31), 2**31 - 1)
        whole = F.try_variant_get(v, "$", "bigint")
        if kind == "int":  # Long.intValue() keeps the low 32 bits
            whole = F.shiftright(F.shiftleft(whole, 32), 32)
        frac = F.when(d >= float(hi), F.lit(hi)).when(d <= float(lo), F.lit(lo)).otherwise(
            F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)))
        text = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast(kind))
        ok = (is_int & whole.isNotNull()) | is_frac | (is_str & text.isNotNull())
        val = F.when(is_int, whole).when(is_frac, frac).when(is_str, text)
        return ok, F.when(ok, val.cast(kind))
    raise ValueError(f"unsupported kind {kind}")


def _strict(v: Column, t: Column, raw: Column, key: str, kind: str) -> Column:
    ok, val = _typed(v, t, raw, kind)
    return F.when(ok, val).otherwise(F.raise_error(F.lit(f"JSON key {key!r} missing or not a {kind}")).cast(kind))


def _lenient(v: Column, t: Column, raw: Column, kind: str, default) -> Column:
    if default is None:
        default = LENIENT_DEFAULTS[kind]
    if kind == "string":
        frac = ((t == "DOUBLE") | t.startswith("DECIMAL") | (t == "BIGINT")) & (raw.contains(".") | raw.contains("e") | raw.contains("E"))
        text = (F.when(frac, F.try_variant_get(v, "$", "double").cast("string"))
                .when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.to_json(v))
                .otherwise(F.try_variant_get(v, "$", "string")))
        return F.coalesce(F.when(t != "VOID", text), F.lit(default))
    ok, val = _typed(v, t, raw, kind)
    return F.when(ok, val).otherwise(F.lit(default).cast(kind))


def _bound(c: Column | str, key: str, use) -> Column:
    """``use(v, t, raw)`` with the value at ``key``, each computed once: the
    parsed parts are bound as lambda variables."""
    text = _col(c)
    v = F.try_variant_get(F.try_parse_json(text), _path(key), "variant")
    parts = F.transform(F.array(F.struct(v.alias("v"), json_field(text, key).alias("r"))), lambda p: F.struct(
        p["v"].alias("v"), F.schema_of_variant(p["v"]).alias("t"), p["r"].alias("r")))
    return F.get(F.transform(parts, lambda p: use(p["v"], p["t"], p["r"])), 0)


def get_strict(c: Column | str, key: str, kind: str = "bigint") -> Column:
    """Typed value of ``key``; a missing key or a value of the wrong kind raises.

    Numeric strings convert (``"5"`` -> 5), doubles truncate to integers
    (1.9 -> 1), ``"true"``/``"false"`` in any case are booleans. For several
    keys of one text use :func:`get_many`, which parses it once.
    """
    return _bound(c, key, lambda v, t, r: _strict(v, t, r, key, kind))


def get_lenient(c: Column | str, key: str, kind: str = "bigint", default=None) -> Column:
    """The strict getter's value, or the default where it would fail.

    ``string`` is the exception (as ``optString``): any present, non-null
    value is returned as text (numbers as Java prints them, objects and
    arrays as JSON); only a missing key or JSON null gives the default.
    """
    return _bound(c, key, lambda v, t, r: _lenient(v, t, r, kind, default))


def get_many(df: DataFrame, c: str, spec: dict[str, tuple], keep: Sequence[str] = ()) -> DataFrame:
    """N1, N2 for several keys of one JSON column: ``keep`` columns and one
    column for each entry ``name: (key, kind)`` (strict) or ``name: (key, kind,
    default)`` (lenient; None for the kind's own default).

    The text is parsed twice, however many getters there are: once to a
    VARIANT, once for the raw text of all keys. Each step is a projection of
    its own, which Catalyst does not fold back (its columns are used often).
    """
    wanted = list(dict.fromkeys(entry[0] for entry in spec.values()))
    raw = ", ".join("`" + k.replace("`", "``") + "` STRING" for k in wanted)
    parsed = df.select(*keep, F.try_parse_json(_col(c)).alias("_v"), F.from_json(_col(c), raw).alias("_r"))
    nodes = parsed.select(*keep, *[F.try_variant_get("_v", _path(k), "variant").alias(f"_v{i}") for i, k in enumerate(wanted)],
                          *[F.col("_r").getField(k).alias(f"_r{i}") for i, k in enumerate(wanted)])
    typed = nodes.select("*", *[F.schema_of_variant(f"_v{i}").alias(f"_t{i}") for i in range(len(wanted))])
    out = []
    for name, (key, kind, *default) in spec.items():
        v, t, r = (F.col(f"_{x}{wanted.index(key)}") for x in "vtr")
        out.append((_lenient(v, t, r, kind, default[0]) if default else _strict(v, t, r, key, kind)).alias(name))
    return typed.select(*keep, *out)


def keys(c: Column | str) -> Column:
    """The object's keys in document order (``explode`` for one row per key)."""
    return F.json_object_keys(_col(c))


def has_key(c: Column | str, key: str) -> Column:
    """``has``."""
    return F.coalesce(F.array_contains(F.json_object_keys(_col(c)), F.lit(key)), F.lit(False))


def is_null_key(c: Column | str, key: str) -> Column:
    """``isNull`` - true for a missing key and for a JSON null."""
    v = F.try_variant_get(F.try_parse_json(_col(c)), _path(key), "variant")
    return v.isNull() | F.is_variant_null(v)


def length(c: Column | str) -> Column:
    """Number of keys of an object, or of elements (nulls counted) of an array."""
    c = _col(c)
    return F.when(c.rlike(r"^[ \t\r\n]*\["), F.json_array_length(c)).otherwise(F.size(F.json_object_keys(c)))


def canonical(c: Column | str, strict: bool = False) -> Column:
    """Key-order-free text of a JSON value, for ``similar`` matching and dedupe.

    Object keys come out sorted, arrays keep their order. Text that is not
    JSON gives NULL (filter on it for the rejects), or raises with ``strict``.
    """
    return F.to_json((F.parse_json if strict else F.try_parse_json)(_col(c)))


#: Stands before a number that is a double, or text that the reader takes for a
#: string, in a similarity key (never an assigned character).
DOUBLE_MARK = "\ufdd0"


def similar_key(c: Column | str, strict: bool = False, relaxed: bool = False) -> Column:
    """Equality key for ``similar``: key order ignored, arrays ordered,
    numbers equal as the reference's values are.

    A number without a fraction or exponent is an int or long, any other is a
    double and equal to every way to write that double (``1e0`` and ``1.0``;
    ``0.0`` and ``-0.0`` differ, as do ``1`` and ``1.0``); what does not print
    back as a long (``-0``, twenty digits) or is no finite double is a string.
    So the tokens of the text are rewritten, a double to an object that no
    other value can be, then the value is parsed and printed with its keys
    sorted, at any depth. NULL for text that is not JSON, or an error with
    ``strict``. ``relaxed`` takes relaxed JSON (N8).
    """
    marked = _without_stand_ins(strict_text(c) if relaxed else _col(c))
    for text, mark in _ESCAPED_STRICT.items():
        marked = F.replace(marked, F.lit(text), F.lit(mark))
    marked = F.regexp_replace(marked, r"\\u[fF][dD][dD]0", DOUBLE_MARK * 2)      # a text's own

    def number(t: Column) -> Column:
        value, fraction = t.try_cast("double"), t.rlike("[.eE]")
        finite = F.abs(value) != float("inf")
        double = F.concat(F.lit(f'{{"{DOUBLE_MARK}":"'), value.cast("string"), F.lit('"}'))
        whole = (t != "-0") & t.try_cast("bigint").isNotNull()
        return F.when(fraction & finite, double).when(~fraction & whole, t).otherwise(F.concat(F.lit('"'), t, F.lit('"')))

    def token(t: Column) -> Column:
        return F.when(t.rlike(_NUMBER), number(t)).otherwise(t)

    text = F.array_join(F.transform(F.regexp_extract_all(marked, F.lit(_STRICT_TOKENS), F.lit(0)), token), "")
    for raw, mark in _ESCAPED_STRICT.items():
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return canonical(text, strict)


#: Tokens of strict JSON that matter to numbers: strings, numbers, anything else.
_ESCAPED_STRICT = {"\\\\": "\ufdd3", '\\"': "\ufdd4"}
_STRICT_TOKENS = r"""(?s)"[^"]*+"|[-+.0-9eE]++|[^"0-9eE.+-]++|."""


def loose_value(c: Column | str) -> Column:
    """Text -> typed value, as a struct ``(kind, i, d, b, s)``.

    ``''`` stays a string; ``true``/``false``/``null`` in any case; text
    starting with a digit or ``-`` becomes a double when it has ``.``/``e``/``E``
    (and is finite), else an int or long when it prints back unchanged
    (so ``007``, ``-0`` stay strings); everything else is a string.
    """
    s = _col(c)
    low = F.lower(s)
    numeric_start = s.rlike(r"^[0-9-]")
    has_frac = s.contains(".") | s.contains("e") | s.contains("E")
    d = s.try_cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    as_long = s.try_cast("bigint")
    exact_long = as_long.isNotNull() & (as_long.cast("string") == s)
    kind = (
        F.when(s.isNull(), F.lit(None))
        .when(s == "", F.lit("string"))
        .when(low.isin("true", "false"), F.lit("boolean"))
        .when(low == "null", F.lit("null"))
        .when(numeric_start & has_frac & finite, F.lit("double"))
        .when(numeric_start & ~has_frac & exact_long,
              F.when(as_long.between(-2147483648, 2147483647), F.lit("int")).otherwise(F.lit("long")))
        .otherwise(F.lit("string"))
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind.isin("int", "long"), as_long).alias("i"),
        F.when(kind == "double", d).alias("d"),
        F.when(kind == "boolean", low == "true").alias("b"),
        F.when(kind == "string", s).alias("s"),
    )


#: Stand-ins, while a text is cut into tokens, for an escaped backslash, double
#: quote and single quote (code points that are never assigned characters).
_ESCAPED = {"\\\\": "\ufdd0", '\\"': "\ufdd1", "\\'": "\ufdd2"}

#: Tokens of relaxed JSON: strings, brackets and separators, bare text (which
#: starts with no quote and ends before any of ,:]}/\"[{;=#), any other character.
_TOKENS = (r"""(?s)"[^"\n\r\x00]*+"|'[^'\n\r\x00]*+'|[\[\]{},;:]"""
           "|[^\\x00-\\x20,:\\]}/\\\\\"\\[{;=#'\ufdd0-\ufdd2][^\\x00-\\x1f,:\\]}/\\\\\"\\[{;=#\ufdd0-\ufdd2]*+|[^\\x01-\\x20]")

_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def _without_stand_ins(text: Column) -> Column:
    """The text with the code points that stand in for others written as escapes."""
    for code in range(0xFDD0, 0xFDD5):
        text = F.replace(text, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return text


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


def _unquoted(t: Column, as_key: Column) -> Column:
    """Bare text as JSON text: true, false and null in any case, an int or long
    in its own digits, a finite double; all else, and every key, a string."""
    low, number = F.lower(t), t.try_cast("double")
    starts = t.rlike("^[0-9-]")
    whole = starts & ~t.rlike("[.eE]") & t.rlike(_NUMBER) & (t != "-0") & t.try_cast("bigint").isNotNull()
    broken = starts & t.rlike("[.eE]") & number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    word = F.when(low.isin("true", "false", "null"), low)
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    return (F.when(as_key, quoted(F.coalesce(word, F.when(broken, number.cast("string")), t)))
            .when(word.isNotNull(), word).when(whole, t)
            .when(broken, F.when(t.rlike(_NUMBER), t).otherwise(number.cast("string"))).otherwise(quoted(t)))


def _string(t: Column) -> Column:
    """A quoted token as a JSON string."""
    body = t.substr(F.lit(2), F.length(t) - 2)
    body = F.when(t.startswith("'"), F.replace(body, F.lit('"'), F.lit('\\"'))).otherwise(body)
    plain = body
    for code in (c for c in range(1, 32) if c not in (10, 13)):     # allowed in strings here, not in strict JSON
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(body.rlike(r"[\x01-\x1f]"), plain).otherwise(body), F.lit('"'))


def _end_of_value(tokens: Column) -> Column:
    """How many tokens the first value takes, by a fold over the brackets (and
    ``;``) with the open ones as state; below 1 if it is no object or array, is
    not closed, brackets do not match or ``;`` stands in an array."""
    marks = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
                     lambda x: (F.length(x["t"]) == 1) & (F.instr(F.lit("{}[];"), x["t"]) > 0))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        t, top = x["t"], F.right(s["open"], F.lit(1))
        rest = s["open"].substr(F.lit(1), F.length(s["open"]) - 1)
        fits = F.when(t == "}", top == "{").when(t == "]", top == "[").otherwise((t != ";") | (top == "{"))
        left = F.when(t.isin("}", "]"), rest).when(t == ";", s["open"]).otherwise(F.concat(s["open"], t))
        end = F.when(~fits, F.lit(-1)).when(left == "", x["i"] + 1).otherwise(F.lit(0))
        return F.when(s["end"] != 0, s).otherwise(F.struct(left.alias("open"), end.alias("end")))

    return F.when(F.get(tokens, F.lit(0)).isin("{", "["), F.aggregate(marks, start, step, lambda s: s["end"])).otherwise(F.lit(-1))


def strict_text(c: Column | str) -> Column:
    """JSON text as the relaxed reader takes it, rewritten to strict JSON;
    NULL where the brackets already show that it is none.

    Strings may stand in single quotes; names and values need no quotes (a
    value is then typed like :func:`loose_value`, ``007`` is a string); ``;``
    separates the pairs of an object like ``,``; a separator before the closing
    bracket goes, an empty place in an array is ``null``; what follows the
    first value is not read. The text is cut into tokens once; a fold over them
    finds where the value ends, and every token up to there is written with
    regard to its neighbours only.
    """
    marked = _without_stand_ins(_col(c))
    for text, mark in _ESCAPED.items():
        marked = F.replace(marked, F.lit(text), F.lit(mark))

    def written(ts: Column) -> Callable[[Column, Column], Column]:
        def token(t: Column, i: Column) -> Column:
            before, after = F.when(i > 0, F.get(ts, i - 1)), F.coalesce(F.get(ts, i + 1), F.lit(""))
            first = F.left(t, F.lit(1))
            comma = F.when((after == "]") | ((after == "}") & (F.coalesce(before, F.lit("")) != "{")), F.lit("")).when(
                (after == ",") & (t == ","), F.lit(",null")).otherwise(F.lit(","))
            return (F.when(t.isin(",", ";"), comma)
                    .when((t == "[") & (after == ","), F.lit("[null"))
                    .when(t.isin("{", "}", "[", "]", ":"), t)
                    .when(first.isin('"', "'") & (F.length(t) > 1), _string(t))
                    .when((F.length(t) == 1) & first.isin('"', "'", "/", "\\", "=", "#", *_ESCAPED.values()), t)
                    .otherwise(_unquoted(F.rtrim(t), after == ":")))
        return token

    def whole(ts: Column) -> Column:
        def text(end: Column) -> Column:
            out = F.array_join(F.transform(F.slice(ts, 1, F.greatest(end, F.lit(0))), written(ts)), "")
            for raw, mark in _ESCAPED.items():
                out = F.replace(out, F.lit(mark), F.lit("'" if raw == "\\'" else raw))
            return F.when(end > 0, out)
        return _let(_end_of_value(ts), text)

    return _let(F.regexp_extract_all(marked, F.lit(_TOKENS), F.lit(0)), whole)


def from_relaxed(c: Column | str, schema: str) -> Column:
    """Parse relaxed JSON into ``schema``; see :func:`relaxed_rejected` for
    the rows that are not even relaxed JSON."""
    return F.from_json(strict_text(c), schema)


def relaxed_rejected(c: Column | str) -> Column:
    """True for text that the relaxed reader refuses: no JSON value after
    rewriting, or an object with a key twice. False for a NULL text."""
    text = _col(c)
    return text.isNotNull() & F.try_parse_json(strict_text(text)).isNull()


def java_number(c: Column | str) -> Column:
    """A number as the JSON writer prints it, as a ``VARIANT`` for ``to_json``.

    ``Double.toString`` text with trailing zeros (and a bare ``.``) removed
    in plain notation: ``12.0`` -> ``12``, ``1.50`` -> ``1.5``, ``1.0E10``
    stays. Non-finite values raise, as the writer rejects them.
    """
    x = _col(c)
    t = x.cast("string")
    trimmed = F.when(t.contains(".") & ~t.contains("E"), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    finite = ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return F.when(x.isNull(), F.lit(None)).when(finite, F.parse_json(trimmed)).otherwise(
        F.raise_error(F.lit("non-finite number in JSON output"))
    )


def _not_finite(x: Column, kind: DataType | None) -> Column | None:
    """Whether a value of type ``kind`` holds a NaN or an infinity anywhere;
    None if it cannot. Without a type only a plain float or double is looked at."""
    if kind is None:
        return F.typeof(x).isin("float", "double") & x.cast("string").isin("NaN", "Infinity", "-Infinity")
    if isinstance(kind, (FloatType, DoubleType)):
        return F.isnan(x) | (F.abs(x) == float("inf"))
    if isinstance(kind, ArrayType):
        return F.exists(x, lambda e: F.coalesce(_not_finite(e, kind.elementType), F.lit(False))) if _not_finite(F.lit(0.0), kind.elementType) is not None else None
    if isinstance(kind, MapType):
        return _not_finite(F.map_values(x), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        found = [y for f in kind.fields if (y := _not_finite(x.getField(f.name), f.dataType)) is not None]
        return reduce(lambda p, q: p | q, [F.coalesce(y, F.lit(False)) for y in found]) if found else None
    return None


def to_json_strict(*cols: Column | str, keep_nulls: bool = True, types: Sequence[DataType | None] | None = None) -> Column:
    """Compact JSON object of the columns; a non-finite double raises.

    The values are tested, not the text, so a string may say ``Infinity``.
    ``types`` (the columns' data types, in order) extends the test to doubles
    inside arrays, maps and structs. NULL fields are written as ``null``
    (``ignoreNullFields=false``). Pass floating-point columns through
    :func:`java_number` for the writer's number text (``12`` rather than ``12.0``).
    """
    cs = [_col(c) for c in cols]
    tests = [y for x, t in zip(cs, types or [None] * len(cs)) if (y := _not_finite(x, t)) is not None]
    obj = F.to_json(F.struct(*cs), {"ignoreNullFields": "false" if keep_nulls else "true"})
    bad = reduce(lambda p, q: p | q, [F.coalesce(y, F.lit(False)) for y in tests], F.lit(False))
    return F.when(bad, F.raise_error(F.lit("non-finite number in JSON output"))).otherwise(obj)


def json_text(x: Column) -> Column:
    """JSON text of one scalar (strings quoted and escaped)."""
    j = F.to_json(F.array(x))
    return j.substr(F.lit(2), F.length(j) - 2)


def join_json(arr: Column | str, sep: str) -> Column:
    """Array elements in JSON text form joined by ``sep``."""
    return F.array_join(F.transform(_col(arr), json_text), sep, "null")


def zip_object(names: Column | str, values: Column | str) -> Column:
    """Names + values -> JSON object text; a later duplicate name wins.

    As putting names one by one: a name without a value (values shorter than
    names, or NULL) removes the key, values beyond the names are ignored. A
    NULL name raises; no names, or no values, give NULL. The pairs are sorted
    by name and place, so the last of each name is found without comparing
    every name with every other.
    """
    n, v = _col(names), _col(values)
    numbered = F.transform(n, lambda k, i: F.struct(
        F.when(k.isNull(), F.raise_error(F.lit("NULL name in zip_object")).cast("string")).otherwise(k).alias("k"),
        i.alias("i"), F.get(v, i).alias("v")))
    last = F.get(F.transform(F.array(F.array_sort(numbered)), lambda ps: F.filter(
        ps, lambda p, i: (F.get(ps, i + 1)["k"] != p["k"]) | F.get(ps, i + 1).isNull())), 0)
    in_order = F.array_sort(F.transform(last, lambda p: F.struct(p["i"].alias("i"), p["k"].alias("k"), p["v"].alias("v"))))
    entries = F.transform(F.filter(in_order, lambda p: p["v"].isNotNull()), lambda p: F.struct(p["k"], p["v"]))
    return F.when((F.size(n) > 0) & (F.size(v) > 0), F.to_json(F.map_from_entries(entries)))


def values_of(obj: Column | str, names: Column | str) -> Column:
    """N11 reverse: the object's values in the order of ``names``, as JSON text
    (a string keeps its quotes, a JSON null is ``null``); NULL for a name that
    the object does not have. The object is parsed once, to a map of VARIANTs."""
    parsed = F.from_json(_col(obj), "map<string,variant>")
    return F.get(F.transform(F.array(parsed), lambda m: F.transform(
        _col(names), lambda k: F.to_json(F.element_at(m, k)))), 0)
