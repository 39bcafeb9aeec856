"""Grouped counts and collections (A1, A3, A4, A5).

Each is a ``groupBy`` with partial aggregation before the shuffle, so a key
that holds a third of all rows is pre-reduced in every task and crosses the
shuffle as one row per task. Nothing collects an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.hashing import md5_hex
from logweave.functions.jsoncols import json_field, json_text
from logweave.functions.text import java_split


def tokens(df: DataFrame, value_col: str = "value", sep: str = ",", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per token of a Java split (trailing empties dropped, NULL values dropped)."""
    return df.where(F.col(value_col).isNotNull()).select(
        *keep, F.explode(java_split(value_col, sep)).alias("token")
    )


def token_count(df: DataFrame, value_col: str = "value", sep: str = ",") -> DataFrame:
    """A1: ``(token, n)`` over all rows of ``df``."""
    return tokens(df, value_col, sep).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def json_key_counter(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """A3: ``(value, n)``: how often each value of a JSON key occurs."""
    v = json_field(json_col, key)
    return df.select(v.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def grouped_values(df: DataFrame, key_col: str, value_col: str) -> DataFrame:
    """A4: every value of every key with its number of occurrences, NULL
    included: ``(key, value, n)``. One partially aggregated shuffle and rows
    of fixed size, however many values a hot key has."""
    return df.groupBy(key_col, value_col).agg(F.count(F.lit(1)).alias("n"))


def values_json(df: DataFrame, key_col: str, value_col: str, always_array: bool = False) -> DataFrame:
    """A4 as JSON: ``(key, n, values_json)`` with every value of a key, repeats
    and NULLs included, sorted (NULLs first).

    The accumulate rule: a key seen once holds a scalar, otherwise an array;
    ``always_array=True`` follows the append rule (an array even for one
    value). The text of a key is as long as its values, so one row grows with
    the rows of its key; use :func:`value_pieces` where keys may be hot.
    """
    counted = grouped_values(df, key_col, value_col)
    per_key = counted.groupBy(key_col).agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(value_col).alias("v"), F.col("n").alias("c")))).alias("_vc"))
    values = F.flatten(F.transform("_vc", lambda x: F.array_repeat(x["v"], x["c"].cast("int"))))
    listed = per_key.select(key_col, "n", values.alias("_v"))
    text = F.to_json("_v")
    return listed.select(
        key_col, "n", (text if always_array else F.when(F.col("n") == 1, json_text(F.get("_v", 0))).otherwise(text)).alias("values_json"))


def value_pieces(df: DataFrame, key_col: str, value_col: str, piece_rows: int, folder: str) -> DataFrame:
    """A4 as JSON in pieces: ``(key, piece, n, values_json)``, the values of a
    key in order (NULLs first), repeats included, ``piece_rows`` to a row; the
    last piece of a key may be shorter. The arrays of a key's pieces one after
    the other are those of :func:`values_json`.

    The values are numbered within their key although a key may be spread over
    many tasks: the distinct values with their counts are sorted by range and
    written to ``folder`` (a new folder of a shared file system) with the
    number of their partition; counts by key and partition, summed up over the
    earlier partitions, say where a key's numbers begin in each, and only the
    numbers inside a partition are counted row by row. No group is larger than
    a partition or a piece.
    """
    if piece_rows < 1:
        raise ValueError("piece_rows must be positive")
    spark = df.sparkSession
    counted = df.groupBy(F.col(key_col).alias("_k"), F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counted.orderBy("_k", F.col("_v").asc_nulls_first()).withColumn("_p", F.spark_partition_id()).write.parquet(folder)
    placed = spark.read.parquet(folder)
    sums = placed.groupBy("_k", "_p").agg(F.sum("_c").alias("_n"))
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(F.col("_k").alias("_key"), F.col("_p").alias("_part"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy("_p", "_k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_at", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    numbered = local.join(begins, (F.col("_p") == F.col("_part")) & F.col("_k").eqNullSafe(F.col("_key"))).select(
        "_k", "_v", "_c", (F.col("_begin") + F.col("_at")).alias("_at"))
    size = F.lit(piece_rows).cast("long")
    cut = numbered.select("_k", "_v", "_c", "_at", F.explode(F.sequence(
        F.expr(f"_at div {piece_rows}"), F.expr(f"(_at + _c - 1) div {piece_rows}"))).alias("piece"))
    first, last = F.greatest(F.col("_at"), F.col("piece") * size), F.least(F.col("_at") + F.col("_c"), (F.col("piece") + 1) * size)
    here = cut.select("_k", "piece", "_v", (last - first).alias("_c"))
    held = here.groupBy("_k", "piece").agg(F.sum("_c").alias("n"), F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_vc"))
    values = F.flatten(F.transform("_vc", lambda x: F.array_repeat(x["_v"], x["_c"].cast("int"))))
    return held.select(F.col("_k").alias(key_col), "piece", "n", F.to_json(values).alias("values_json"))


def duplicate_groups(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A5: groups of rows with the same text fingerprint, two or more members.

    Output ``(fingerprint, n, first_id, last_id)``; members are not listed,
    so a huge group is still one small row.
    """
    return (
        df.select(md5_hex(text_col).alias("fingerprint"), F.col(id_col).alias("_id"))
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))
        .where(F.col("n") > 1)
    )
