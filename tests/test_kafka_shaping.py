"""Record decoding and shaping (the connector itself is a deployment jar)."""

from pyspark.sql import functions as F

from logweave.operators.aggregates import token_count
from logweave.sources import kafka


def test_keyed_records_and_decode(spark):
    df = spark.createDataFrame([(1700000000000, "a", None, 123)], "ts bigint, t string, x string, n int")
    recs = kafka.keyed_records(df, "ts", ["t", "x", "n"])
    r = recs.collect()[0]
    assert (r.key, r.value) == ("1700000000000", "a,,123")      # a NULL field stays, empty
    raw = recs.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    back = kafka.kafka_values(raw).collect()[0]
    assert (back.key, back.value) == ("1700000000000", "a,,123")


def test_sample_record_token_count(spark):
    df = spark.createDataFrame([("a,123,456,789,12567",), ("a,123",)], "value string")
    got = {r.token: r.n for r in token_count(df).collect()}
    assert got == {"a": 2, "123": 2, "456": 1, "789": 1, "12567": 1}

