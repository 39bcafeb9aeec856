"""A1, T1, T2 on FIXTURES.md 2.4: counts per batch, never running totals."""

import os

from pyspark.sql import functions as F

from logweave.operators.aggregates import token_count
from logweave.streaming import tokens as T


def test_token_count_rules(spark):
    df = spark.createDataFrame([("a,b,a",), ("a,,b",), ("a,b,,",), ("",), (",,",), (None,)], "value string")
    got = {r.token: r.n for r in token_count(df).collect()}
    assert got == {"a": 4, "b": 3, "": 2}


def test_each_batch_counts_alone(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for i, body in enumerate(["a\n", "a\nb,b\n"]):
        path = os.path.join(src, f"f{i}.txt")
        with open(path, "w") as fh:
            fh.write(body)
        os.utime(path, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))  # file order = batch order
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(src)
    sink, ckpt = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ckpt")
    q = T.start_batch_token_counts(stream, sink, ckpt, available_now=True)
    q.awaitTermination()
    got = sorted((r.batch_id, r.token, r.n) for r in spark.read.parquet(sink).collect())
    assert got == [(0, "a", 1), (1, "a", 1), (1, "b", 2)]
    # the console output of the original job: first counts of each batch
    sink2, ckpt2 = os.path.join(tmpdir_path, "sink2"), os.path.join(tmpdir_path, "ckpt2")
    T.start_batch_token_counts(stream, sink2, ckpt2, available_now=True, show=10).awaitTermination()
    assert spark.read.parquet(sink2).count() == 3
    # a restart from the checkpoint finds no new input and writes nothing new
    q2 = T.start_batch_token_counts(stream, sink, ckpt, available_now=True)
    q2.awaitTermination()
    assert spark.read.parquet(sink).count() == 3


def test_windowed_counts(spark):
    df = spark.createDataFrame(
        [("2024-01-01 00:00:01", "a,b"), ("2024-01-01 00:00:19", "a"), ("2024-01-01 00:00:20", "a")],
        "ts string, value string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted((str(r.window_start), r.token, r.n) for r in T.windowed_token_counts(df).collect())
    assert got == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:00:00", "b", 1), ("2024-01-01 00:00:20", "a", 1)]


def test_streamed_windows_close_once_across_a_restart(spark, tmpdir_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from logweave.streaming import tokens as T

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    deliveries = [[(at(5), "a,b"), (at(45), "a")], [(at(15), "a"), (at(100), "c"), (at(62), None)], [(at(1), "late"), (at(59), "b"), (at(200), "d")]]
    schema = "ts timestamp_ntz, value string"
    got = []
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmpdir_path}/in")
        q = T.start_windowed_token_counts(spark.readStream.schema(schema).parquet(f"{tmpdir_path}/in"), f"{tmpdir_path}/out", f"{tmpdir_path}/ck", "40 seconds", available_now=True)
        q.awaitTermination()
        got.append(spark.read.schema("window_start timestamp, token string, n bigint").parquet(f"{tmpdir_path}/out").select(
            (F.unix_seconds("window_start") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))).alias("s"), "token", "n").collect())
    assert sorted(map(tuple, got[0])) == []
    # the row at 15 s came late but before its window was closed; the one at 1 s did not
    assert sorted(map(tuple, got[1])) == [(0, "a", 2), (0, "b", 1), (40, "a", 1)] or sorted(map(tuple, got[1])) == [(0, "a", 2), (0, "b", 1)]
    assert sorted(map(tuple, got[2])) == sorted([(0, "a", 2), (0, "b", 1), (40, "a", 1), *([(40, "b", 1)] if (40, "a", 1) not in map(tuple, got[1]) else []), (100, "c", 1)])
