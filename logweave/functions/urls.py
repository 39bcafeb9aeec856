"""URL and request-parameter expressions.

The parameter string is decoded once per row into two arrays, the entry
names and the entry values; every named field is then a native
``array_position`` lookup of its last occurrence. All of it is JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.text import java_split


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def query_string(url: Column | str) -> Column:
    """Text after the first ``?``; NULL when there is none."""
    u = _col(url)
    p = F.instr(u, "?")
    return F.when(p > 0, u.substr(p + 1, F.length(u))).otherwise(F.lit(None).cast("string"))


def url_path(url: Column | str) -> Column:
    """Text before the first ``?``; the whole text when there is none."""
    u = _col(url)
    p = F.instr(u, "?")
    return F.when(p > 0, u.substr(F.lit(1), p - 1)).otherwise(u)


def decode_or_raw(c: Column | str) -> Column:
    """Form-decode (``+`` is a blank, ``%xx`` UTF-8); malformed text stays raw."""
    c = _col(c)
    # only text with an escape or a '+' can change; the rest skips the decoder
    needs = (F.instr(c, "%") > 0) | (F.instr(c, "+") > 0)
    return F.when(needs, F.coalesce(F.try_url_decode(c), c)).otherwise(c)


def _name_part(kv: Column) -> Column:
    return F.when(F.instr(kv, "=") == 0, kv).otherwise(F.substring_index(kv, "=", 1))


def _value_part(kv: Column) -> Column:
    # an entry without '=' has the value of one blank, as the log job does
    return F.when(F.instr(kv, "=") == 0, F.lit(" ")).otherwise(kv.substr(F.instr(kv, "=") + 1, F.length(kv)))


def param_names(qs: Column | str) -> Column:
    """Decoded names of the ``&`` entries of a parameter string."""
    return F.transform(java_split(_col(qs), "&"), lambda kv: decode_or_raw(_name_part(kv)))


def param_values(qs: Column | str) -> Column:
    """Decoded values of the ``&`` entries, split at the first ``=``."""
    return F.transform(java_split(_col(qs), "&"), lambda kv: decode_or_raw(_value_part(kv)))


def decoded_pairs(qs: Column | str) -> Column:
    """Decoded ``[name, value]`` pairs of a parameter string, in order."""
    return F.transform(java_split(_col(qs), "&"),
                       lambda kv: F.array(decode_or_raw(_name_part(kv)), decode_or_raw(_value_part(kv))))


def pick_last(rev_names: Column | str, rev_values: Column | str, name: str) -> Column:
    """Value of the last entry called ``name``; ``''`` when missing.

    Takes the *reversed* outputs of :func:`param_names` / :func:`param_values`
    (computed once per row for all fields): ``array_position`` then finds the
    last match natively, no lambda per field. NULL arrays (no ``?`` in the
    URL) give NULL, like the reference's empty record.
    """
    rn, rv = _col(rev_names), _col(rev_values)
    hit = F.get(rv, F.array_position(rn, F.lit(name)) - 1)
    return F.when(rn.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(hit, F.lit("")))


def canonical_params(qs: Column | str) -> Column:
    """Sorted parameter string ``?a=1&b.c=2`` (H4).

    Keys are unique (a later entry replaces an earlier one), sorted, ``_`` in
    a key becomes ``.``; values are kept as written. ``''`` for no entries.
    Entries are sorted by (key, position) and the last of each key's run is
    kept; the sorted array is bound once as a lambda variable, so nothing is
    recomputed per element.
    """
    pairs = F.transform(
        java_split(_col(qs), "&"),
        lambda kv, i: F.struct(
            F.substring_index(kv, "=", 1).alias("k"),
            i.alias("i"),
            F.when(F.instr(kv, "=") > 0, kv.substr(F.instr(kv, "=") + 1, F.length(kv))).otherwise(F.lit("")).alias("v"),
        ),
    )
    last = F.get(F.transform(F.array(F.array_sort(pairs)), lambda s: F.filter(
        s, lambda p, j: (j == F.size(s) - 1) | (F.get(s, j + 1)["k"] != p["k"]))), 0)
    body = F.array_join(
        F.transform(last, lambda p: F.concat(F.replace(p["k"], F.lit("_"), F.lit(".")), F.lit("="), p["v"])), "&")
    return F.when(F.size(last) == 0, F.lit("")).otherwise(F.concat(F.lit("?"), body))


def url_encode(c: Column | str) -> Column:
    """UTF-8 form encoding (blank is ``+``), as ``java.net.URLEncoder`` (H5)."""
    return F.url_encode(_col(c))
