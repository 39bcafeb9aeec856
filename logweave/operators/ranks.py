"""Exact first-n rows of a frame of any size, by rank selection on a key.

``limit`` brings its rows to one task. Here the n-th key is found instead:
a few keys are drawn at random as pivots, one aggregation counts the rows
between and at them, and the search goes on in the interval that holds rank n
until it is a pivot itself or the interval is small. The result is then a
filter, every row before the n-th key, and as many of its ties as are wanted.
No row or partition number takes part, so the rows that are counted and the
rows that are kept are the same whatever the partitioning of either job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, MapType, TimestampNTZType, TimestampType, VariantType

#: Pivots of a round, and the size of an interval whose keys are simply sorted.
PIVOTS = 15
SMALL = 10_000

#: Copies of one row that a task makes, where more equal rows are wanted.
_COPIES = 1 << 20


@dataclass(frozen=True)
class Key:
    """A sort key: a column, its direction and where its NULLs go."""

    name: str
    descending: bool = False
    nulls_first: bool = False

    @property
    def order(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sort_keys(df: DataFrame) -> list[Key]:
    """The keys by which ``df`` is sorted (empty if it is not)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    names = {}
    for i in range(plan.output().size()):
        a = plan.output().apply(i)
        names[a.exprId().id()] = a.name()
    keys = []
    for i in range(plan.outputOrdering().size()):
        o = plan.outputOrdering().apply(i)
        of = o.child()
        if of.getClass().getSimpleName() != "AttributeReference" or of.exprId().id() not in names:
            raise ValueError("the frame is sorted by an expression that it does not hold; sort it by columns that it keeps")
        keys.append(Key(_quoted(names[of.exprId().id()]), o.direction().sql() == "DESC", o.nullOrdering().sql() == "NULLS FIRST"))
    while not keys and plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.child()
        if plan.getClass().getSimpleName() == "Sort":
            raise ValueError("the frame is sorted by a column that it does not hold; sort it by columns that it keeps")
    return keys


def _comparable(df: DataFrame, keys: Sequence[Key]) -> list[Column]:
    """The keys as columns that compare alike and pass through the driver
    unchanged (a time as microseconds, bytes as hexadecimal digits)."""
    out = []
    for k, field in zip(keys, df.select(*[F.col(k.name) for k in keys]).schema.fields):
        c = F.col(k.name)
        if isinstance(field.dataType, TimestampType):
            c = F.unix_micros(c)
        elif isinstance(field.dataType, TimestampNTZType):
            c = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
        elif isinstance(field.dataType, BinaryType):
            c = F.hex(c)
        out.append(c)
    return out


def _before(keys: Sequence[Key], cols: Sequence[Column], at: Sequence[Any]) -> Column:
    """Whether a row sorts strictly before the key values ``at``."""
    out = F.lit(False)
    for k, c, v in reversed(list(zip(keys, cols, at))):
        if v is None:
            less, same = (F.lit(False) if k.nulls_first else c.isNotNull()), c.isNull()
        else:
            past = c > F.lit(v) if k.descending else c < F.lit(v)
            less = c.isNull() | past if k.nulls_first else c.isNotNull() & past
            same = c.isNotNull() & (c == F.lit(v))
        out = less | (same & out)
    return out


def _same(cols: Sequence[Column], at: Sequence[Any]) -> Column:
    out = F.lit(True)
    for c, v in zip(cols, at):
        out = out & c.eqNullSafe(F.lit(v))
    return out


def _kth(df: DataFrame, keys: Sequence[Key], n: int) -> tuple[tuple, int, int] | None:
    """(values, rows before, rows at) of the n-th key; None if there are fewer rows."""
    cols = _comparable(df, keys)
    names = [f"_{i}" for i in range(len(cols))]
    rows = df.select(*[c.alias(x) for c, x in zip(cols, names)])
    at = [F.col(x) for x in names]
    by = [Key(x, k.descending, k.nulls_first) for x, k in zip(names, keys)]
    left, before, inside, round_ = n, 0, F.lit(True), 0
    while True:
        part = rows.where(inside)
        drawn = part.orderBy(F.rand(round_)).limit(PIVOTS).orderBy(*[k.order for k in by]).collect()
        if not drawn:
            return None
        pivots = [tuple(r) for i, r in enumerate(drawn) if i == 0 or repr(r) != repr(drawn[i - 1])]

        def place(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(2 * lo)
            mid = (lo + hi) // 2
            return F.when(_before(by, at, pivots[mid]), place(lo, mid)).when(_same(at, pivots[mid]), F.lit(2 * mid + 1)).otherwise(place(mid + 1, hi))

        counts = dict(part.groupBy(place(0, len(pivots)).alias("b")).count().collect())
        for b in range(2 * len(pivots) + 1):
            size = counts.get(b, 0)
            if size < left:
                left, before = left - size, before + size
                continue
            if b % 2:
                return pivots[b // 2], before, size
            low, high = b // 2 - 1, b // 2
            inside = (inside if low < 0 else inside & ~_before(by, at, pivots[low]) & ~_same(at, pivots[low]))
            inside = inside if high == len(pivots) else inside & _before(by, at, pivots[high])
            break
        else:
            return None
        if size <= SMALL:
            first = rows.where(inside).orderBy(*[k.order for k in by]).limit(left).collect()
            found = tuple(first[-1])
            ties = rows.where(inside).where(_same(at, found)).count()
            return found, before + sum(1 for r in first if repr(r) != repr(first[-1])), ties
        round_ += 1


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns, for any column types."""
    plain = [F.to_json(F.struct(F.col(_quoted(f.name)))) if _has_map(f.dataType) else F.col(_quoted(f.name)) for f in df.schema.fields]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def _has_map(kind) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return True
    inner = [getattr(kind, "elementType", None), *[f.dataType for f in getattr(kind, "fields", [])]]
    return any(_has_map(t) for t in inner if t is not None)


def _copies(row: DataFrame, n: int) -> DataFrame:
    """A one-row frame ``n`` times, made in blocks by many tasks."""
    cols = row.columns
    blocks = -(-n // _COPIES)
    spread = row.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).repartition(min(blocks, 10_000), "_block")
    size = F.when(F.col("_block") == blocks - 1, F.lit(n - (blocks - 1) * _COPIES)).otherwise(F.lit(_COPIES))
    return spread.select("*", F.explode(F.sequence(F.lit(1), size)).alias("_copy")).select(*[F.col(_quoted(c)) for c in cols])


def first_rows(df: DataFrame, keys: Sequence[Key], n: int, limit_rows: int) -> DataFrame:
    """Exactly the first ``n`` rows of ``df`` by ``keys`` (all, if there are
    fewer), unsorted; any ``n`` rows without keys.

    Of rows that tie at the n-th key any may be taken, as with ``limit``, which
    is also used up to ``limit_rows`` ties. ``df`` is evaluated some times (two
    passes over its keys for each factor of about eight by which the rows
    exceed ``SMALL``), so it should be cheap to read and always the same rows.
    """
    if not keys:
        return _any_rows(df, n, limit_rows)
    found = _kth(df, keys, n)
    if found is None:
        return df
    values, before, ties = found
    cols = _comparable(df, keys)
    head, tied = df.where(_before(keys, cols, values)), df.where(_same(cols, values))
    if before + ties == n:
        return df.where(_before(keys, cols, values) | _same(cols, values))
    return head.unionAll(tied.limit(n - before) if n - before <= limit_rows else _any_rows(tied, n - before, limit_rows))


def _any_rows(df: DataFrame, n: int, limit_rows: int) -> DataFrame:
    """Any ``n`` rows: the first by a hash of the whole row, so that only equal
    rows tie, and of those it does not matter which are taken."""
    hashed = df.withColumn("_row_hash", _row_hash(df))
    found = _kth(hashed, [Key("_row_hash")], n)
    if found is None:
        return df
    (h,), before, ties = found
    drop = hashed.columns[:-1]
    head = hashed.where(F.col("_row_hash") < h).select(*[F.col(_quoted(c)) for c in drop])
    tied = hashed.where(F.col("_row_hash") == h).select(*[F.col(_quoted(c)) for c in drop])
    wanted = n - before
    if wanted == ties:
        return head.unionAll(tied)
    return head.unionAll(tied.limit(wanted) if wanted <= limit_rows else _copies(tied.limit(1), wanted))
