"""Sort, limit, set and join helpers.

Catalyst broadcasts a side only when its estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides;
AQE splits skewed partitions. That estimate is of encoded files, whose rows
can be dozens of times larger in memory, so the joins here leave a side to it
only where it is small by a wide margin. No helper here forces a
broadcast of unchecked size.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators import ranks

#: Caps up to this many rows use Spark's own limit, which brings them to one task.
LIMIT_ROWS = 1_000_000
_INT64_MAX = 2**63 - 1

#: How many times larger than Catalyst's estimate, which is of encoded files, a
#: side may be in memory (keys of copied orders: over 32 times).
ENCODED = 64


def _sort_key(spec: str | Column) -> Column:
    """``"-col"`` sorts descending; every key sorts NULLs last (O3)."""
    if isinstance(spec, Column):
        return spec
    if spec.startswith("-"):
        return F.col(spec[1:]).desc_nulls_last()
    return F.col(spec).asc_nulls_last()


def order_nulls_last(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """O2/O3: ORDER BY with NULLs at the end in both directions."""
    return df.orderBy(*[_sort_key(k) for k in keys])


def _rank_keys(keys: Sequence[str]) -> list[ranks.Key]:
    if not all(isinstance(k, str) for k in keys):
        raise ValueError("keys are column names, with '-' in front for descending order")
    return [ranks.Key(k[1:], True) if k.startswith("-") else ranks.Key(k) for k in keys]


def top_k(df: DataFrame, keys: Sequence[str], k: int, limit_rows: int = LIMIT_ROWS) -> DataFrame:
    """O1: the first ``k`` rows by ``keys`` (``"-col"`` descending, NULLs last), sorted.

    Up to ``limit_rows`` this is a ``TakeOrderedAndProject`` (each task keeps
    its own top ``k``), beyond it rank selection by key and a distributed sort
    of the rows found. ``k = 0`` means no cap, as in :func:`row_cap`."""
    if 0 < row_cap_value(k) <= limit_rows:
        return order_nulls_last(df, keys).limit(k)
    return order_nulls_last(df if k == 0 else ranks.first_rows(df, _rank_keys(keys), k, limit_rows), keys)


def row_cap_value(n: int) -> int:
    """Validate a 64-bit row cap; 0 means no cap, negative is an error."""
    if not 0 <= n <= _INT64_MAX:
        raise ValueError("max rows must be from 0 to 2^63-1")
    return n


def row_cap(df: DataFrame, n: int, limit_rows: int = LIMIT_ROWS) -> DataFrame:
    """At most ``n`` rows (0 = all rows): the first ones of a sorted
    frame, any of another.

    Up to ``limit_rows`` this is Spark's ``limit``, which brings the rows to
    one task. A larger cap is found by rank selection on the frame's own sort
    keys (see :mod:`logweave.operators.ranks`), or on a hash of the rows if it
    is not sorted: exactly ``n`` rows, whatever the partitioning.
    """
    n = row_cap_value(n)
    if n == 0:
        return df
    if n <= limit_rows:
        return df.limit(n)
    keys = ranks.sort_keys(df)
    capped = ranks.first_rows(df, keys, n, limit_rows)
    return capped.orderBy(*[k.order for k in keys]) if keys else capped


def union_all(frames: Sequence[DataFrame], by_name: bool = True) -> DataFrame:
    """Concatenate frames, duplicates kept (no shuffle)."""
    if by_name:
        return reduce(lambda a, b: a.unionByName(b), frames)
    return reduce(lambda a, b: a.union(b), frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION (one shuffle on all columns, partial dedupe in each task first)."""
    return union_all(frames).distinct()


def _null_extend(df: DataFrame, like: DataFrame, cols: Sequence[str]) -> DataFrame:
    types = {f.name: f.dataType for f in like.schema.fields}
    return df.select(*df.columns, *[F.lit(None).cast(types[c]).alias(c) for c in cols])


def _surely_small(df: DataFrame) -> bool:
    """Whether ``df``, decoded, is within Spark's broadcast threshold."""
    if not hasattr(df, "_jdf"):     # Spark Connect shows no estimate; Catalyst decides alone
        return True
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * ENCODED <= limit


def _shuffled(df: DataFrame, *sides: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle unless one of ``sides`` is surely small."""
    return df if any(map(_surely_small, sides)) else df.hint("merge")


def outer_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Left, right or full outer equi-join that stays balanced under key skew.

    AQE splits a skewed partition only on the preserved side of a left or
    right outer join and on neither side of a full one, so a hot key could
    land in one task. Written as ``inner join`` (AQE may split either side)
    plus the preserved rows whose key is absent (an anti join against the
    *distinct* keys of the other side, which partial aggregation reduces
    before the shuffle), it has no such task. Rows with a NULL key match
    nothing: they are set aside first, so that the inner and the anti join
    read one and the same exchange of the preserved side. A side that may be
    large when decoded is shuffled, so that a task holds one partition of it
    and no task builds or receives a broadcast that grows with the table.
    Column names of the two inputs must not overlap.
    """
    if how not in ("left", "right", "full"):
        raise ValueError("how must be 'left', 'right' or 'full'")
    if set(left.columns) & set(right.columns):
        raise ValueError("outer_join needs distinct column names on both sides")
    cols = [*left.columns, *right.columns]
    lk, rk = left.where(F.col(left_key).isNotNull()), right.where(F.col(right_key).isNotNull())
    out = lk.join(_shuffled(rk, lk, rk), lk[left_key] == rk[right_key], "inner").select(*cols)
    sides = {"left": (left, lk, left_key, rk, right_key), "right": (right, rk, right_key, lk, left_key)}
    for keep, keyed, kk, other, ok in sides.values() if how == "full" else [sides[how]]:
        keys = other.select(F.col(ok).alias("_k")).distinct()
        missing = keyed.join(_shuffled(keys, keys), keyed[kk] == keys["_k"], "left_anti")
        for rows in (missing, keep.where(F.col(kk).isNull())):
            out = out.unionByName(_null_extend(rows, other, other.columns).select(*cols))
    return out


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` with a match in ``right`` (``IN (subquery)``).

    Only the distinct keys of ``right`` take part, so a hot key on the right
    crosses the shuffle once per task after partial aggregation. They are
    broadcast only where they are surely small, as in :func:`outer_join`.
    """
    keys = right.select(F.col(right_key).alias("_k")).distinct()
    return left.join(_shuffled(keys, keys), left[left_key] == keys["_k"], "left_semi")


def schema_only(df: DataFrame) -> DataFrame:
    """Zero rows, full schema."""
    return df.limit(0)
