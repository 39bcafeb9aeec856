"""Log reconciliation.

Comma lines of two layouts are classified row by row, then summed per key:
``reported`` = sum of the counts the summary lines state, ``actual`` =
number of detail lines. The only shuffle is the ``groupBy``; partial
aggregation before it is the map-side combine, so a hot key costs one row
per task in the shuffle, not one per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import java_length, java_split, parse_long_or_zero

# Fixed value: a third token longer than this many characters marks a detail line.
DETAIL_MIN_LEN = 18
MIN_TOKENS = 3


def classify(lines: DataFrame, line_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, reported, actual)`` per kept line.

    Lines with fewer than 3 tokens (Java split, trailing empties removed)
    are dropped. Detail line: key = second-to-last token, (0, 1). Summary:
    key = first token, (parsed third token or 0, 0).
    """
    staged = lines.select(*keep, java_split(line_col, ",").alias("w")).where(F.size("w") >= MIN_TOKENS)
    w = F.col("w")
    third = F.get(w, 2)
    detail = java_length(third) > DETAIL_MIN_LEN
    return staged.select(
        *keep,
        F.when(detail, F.get(w, F.size(w) - 2)).otherwise(F.get(w, 0)).alias("key"),
        F.when(detail, F.lit(0).cast("bigint")).otherwise(parse_long_or_zero(third)).alias("reported"),
        F.when(detail, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("actual"),
    )


def reconcile(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Per key, ``reported`` and ``actual`` sums (BIGINT; overflow raises)."""
    return classify(lines, line_col).groupBy("key").agg(
        F.sum("reported").alias("reported"), F.sum("actual").alias("actual")
    )


def mismatches(totals: DataFrame) -> DataFrame:
    """R2: keys whose reported count differs from the actual one."""
    return totals.where(F.col("reported") != F.col("actual")).withColumn(
        "diff", F.col("reported") - F.col("actual")
    )


def as_pair_text(totals: DataFrame) -> Column:
    """``(key,(reported,actual))`` text form of a totals row."""
    return F.format_string("(%s,(%d,%d))", "key", "reported", "actual")


def write_pair_text(totals: DataFrame, path: str) -> None:
    """Overwrite ``path`` with one text line per key."""
    totals.select(as_pair_text(totals).alias("value")).write.mode("overwrite").text(path)
