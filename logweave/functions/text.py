"""Splitting and number parsing with the exact Java semantics the log jobs rely on.

All functions return native Columns; nothing runs in Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING_ARRAY = "array<string>"


def _quoted(sep: str) -> str:
    """Java-regex literal for a separator (split() takes a regex)."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", sep)


def java_split(c: Column | str, sep: str) -> Column:
    """``String.split(sep)`` of Java: trailing empty tokens are removed.

    ``""`` gives ``[""]``, a string made only of separators gives ``[]``,
    inner and leading empties stay (F1).
    """
    c = F.col(c) if isinstance(c, str) else c
    q = _quoted(sep)
    if len(sep) == 1:
        # rtrim of the one separator character is a plain scan, no regex
        trimmed = F.rtrim(c, F.lit(sep))
        only_seps = (trimmed == "") & (c != "")
    else:
        trimmed = F.regexp_replace(c, f"({q})+$", "")
        only_seps = c.rlike(f"^({q})+$")
    return F.when(only_seps, F.array().cast(_STRING_ARRAY)).otherwise(F.split(trimmed, q))


def token_at(c: Column | str, index: int, sep: str = " ") -> Column:
    """Token ``index`` (0-based) of a Java split, NULL when the line is too short.

    A NULL marks a reject row instead of failing the whole job. For a
    one-character separator no token array is built: ``substring_index``
    stops at the ``index + 1``-th separator, and counting separators in that
    head tells whether the token exists, so a long text is not split into all
    of its tokens to read one. The result equals ``get(java_split(c), index)``.
    """
    if len(sep) != 1:
        return F.get(java_split(c, sep), F.lit(index))
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.rtrim(c, F.lit(sep))            # Java drops trailing empty tokens
    head = F.substring_index(trimmed, sep, index + 1)
    n_sep = F.length(head) - F.length(F.replace(head, F.lit(sep), F.lit("")))
    only_seps = (trimmed == "") & (c != "")      # Java gives no token at all
    return F.when(only_seps | (n_sep < index), F.lit(None).cast("string")).otherwise(
        F.substring_index(head, sep, -1)
    )


def java_length(c: Column | str) -> Column:
    """``String.length()`` of Java: UTF-16 code units.

    A character outside the Basic Multilingual Plane counts twice. ASCII
    text (as many UTF-8 bytes as characters) takes the fast path, no regex.
    """
    c = F.col(c) if isinstance(c, str) else c
    n = F.length(c)
    supplementary = F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.when(F.octet_length(c) == n, n).otherwise(n + supplementary)


def parse_long_or_zero(c: Column | str) -> Column:
    """Java ``Long.parseLong`` with 0 on failure.

    Optional sign, ASCII digits only, no blanks or decimals; overflow gives 0.
    A bare ``try_cast`` would trim blanks, so the shape is checked first.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(
        c.rlike(r"^[+-]?[0-9]+$"), F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    ).otherwise(F.lit(0).cast("bigint"))
