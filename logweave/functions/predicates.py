"""Optional-filter predicates (F4) and safe literals.

An argument of ``None`` means "no filter"; an empty string means
"IS NULL" for equality/LIKE filters; an empty IN list matches nothing.
The result is a Column, so Catalyst can push it into the scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def opt_equals(c: Column | str, value) -> Column | None:
    if value is None:
        return None
    if value == "":
        return _col(c).isNull()
    return _col(c) == F.lit(value)


def opt_like(c: Column | str, pattern: str | None) -> Column | None:
    if pattern is None:
        return None
    if pattern == "":
        return _col(c).isNull()
    return _col(c).like(pattern)


def opt_like_keep_empty(c: Column | str, pattern: str | None) -> Column | None:
    """Like :func:`opt_like`, but ``''`` stays a LIKE (the "optional like")."""
    if pattern is None:
        return None
    return _col(c).like(pattern)


def opt_in(c: Column | str, values: Iterable | None) -> Column | None:
    if values is None:
        return None
    values = list(values)
    if not values:
        return F.lit(False)
    return _col(c).isin(values)


def all_of(*preds: Column | None) -> Column:
    """AND of the given predicates; ``None`` entries are skipped, none left is TRUE."""
    kept = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, kept) if kept else F.lit(True)


def quote_literal(value: str) -> str:
    """Spark SQL string literal for text that cannot take parameters (DDL).

    Quotes are doubled as in standard SQL; backslashes are escaped too, since
    Spark SQL reads ``\\`` escapes in literals. Query text should use
    ``spark.sql(text, args=...)`` instead.
    """
    return "'" + value.replace("\\", "\\\\").replace("'", "''") + "'"
