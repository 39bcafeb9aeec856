"""Kafka source and sink shaping.

The Kafka connector jar is a deployment dependency; these functions build
the reader/writer and shape records, and every downstream operator takes the
stream as a plain DataFrame, so it runs the same on a file stream in tests.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_stream(spark: SparkSession, servers: str, topics: Sequence[str], group_id: str | None = None,
                 starting_offsets: str = "latest") -> DataFrame:
    """Subscribe to topics, starting at the latest offsets."""
    r = (spark.readStream.format("kafka")
         .option("kafka.bootstrap.servers", servers)
         .option("subscribe", ",".join(topics))
         .option("startingOffsets", starting_offsets))
    if group_id:
        r = r.option("kafka.group.id", group_id)
    return r.load()


def kafka_values(df: DataFrame) -> DataFrame:
    """Kafka rows -> ``key, value`` strings (UTF-8)."""
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def keyed_records(df: DataFrame, key: Column | str, values: Sequence[Column | str], sep: str = ",") -> DataFrame:
    """``(key, value)`` strings, value = the given columns joined by ``sep``.
    A NULL column is an empty field, so the others keep their places."""
    k = F.col(key) if isinstance(key, str) else key
    vs = [F.col(v) if isinstance(v, str) else v for v in values]
    return df.select(k.cast("string").alias("key"), F.concat_ws(sep, *[F.coalesce(v.cast("string"), F.lit("")) for v in vs]).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Stream ``key, value`` records to a topic (checkpointed)."""
    return (df.selectExpr("CAST(key AS STRING) key", "CAST(value AS STRING) value")
            .writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("topic", topic)
            .option("checkpointLocation", checkpoint)
            .start())
