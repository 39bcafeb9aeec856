"""Per-batch token counts on a stream (T1), and token counts of event-time
windows on a stream or a table (T2).

T1 counts the tokens of each micro-batch on its own (no running total), as
the original 20-second job did, but with a checkpoint so a restarted query
resumes from the last committed batch instead of losing or repeating data.
Each batch's counts go to the sink folder ``batch_id=<n>``; a replayed
batch overwrites only its own folder, so the sink is idempotent per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.operators.aggregates import token_count, tokens

# Fixed value: micro-batch interval of the original stream job.
BATCH_INTERVAL = "20 seconds"


def _batch_writer(sink_path: str, value_col: str, sep: str, show: int = 0):
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = token_count(batch, value_col, sep).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        if show:
            counts = counts.persist()  # written and shown without counting twice
        # one folder per batch, overwritten on replay -> exactly-once per batch
        (counts.select("batch_id", "token", "n").write.mode("overwrite")
         .parquet(f"{sink_path}/batch_id={batch_id}"))
        if show:
            counts.select("token", "n").show(show, truncate=False)
            counts.unpersist()
    return write


def start_batch_token_counts(
    stream: DataFrame,
    sink_path: str,
    checkpoint: str,
    value_col: str = "value",
    sep: str = ",",
    interval: str | None = BATCH_INTERVAL,
    available_now: bool = False,
    show: int = 0,
) -> StreamingQuery:
    """Start the query; every micro-batch writes ``(batch_id, token, n)``.

    ``available_now=True`` processes what is there in batches and stops
    (tests, backfills); otherwise a processing-time trigger of ``interval``.
    ``show=10`` also prints the first 10 counts of each batch on the driver,
    as the original job did.
    """
    w = stream.select(value_col).writeStream.foreachBatch(_batch_writer(sink_path, value_col, sep, show))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def start_windowed_token_counts(
    stream: DataFrame,
    sink_path: str,
    checkpoint: str,
    delay: str,
    ts_col: str = "ts",
    value_col: str = "value",
    sep: str = ",",
    width: str = BATCH_INTERVAL,
    interval: str | None = BATCH_INTERVAL,
    available_now: bool = False,
) -> StreamingQuery:
    """T2 on a stream: counts of event-time windows, each written once, when
    it is closed.

    The watermark is the latest time seen less ``delay``. Rows may come out of
    order as long as their window is not closed; a row of a closed window is
    dropped. Open windows are kept in the state store and their number is
    bounded by ``delay``; the checkpoint carries them and the watermark over a
    restart. The file sink commits a batch's files as a whole, so a window is
    there once. Times without a zone are read in the session's zone, as
    watermarks need a TIMESTAMP.
    """
    timed = stream.select(F.col(ts_col).cast("timestamp").alias(ts_col), value_col).withWatermark(ts_col, delay)
    counts = windowed_token_counts(timed, ts_col, value_col, sep, width)
    w = counts.writeStream.outputMode("append").format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def windowed_token_counts(df: DataFrame, ts_col: str = "ts", value_col: str = "value", sep: str = ",",
                          width: str = BATCH_INTERVAL) -> DataFrame:
    """Token counts per tumbling event-time window of ``width``.

    One aggregation keyed by ``(window, token)``; map-side combined. For a
    stream see :func:`start_windowed_token_counts`.
    """
    t = tokens(df, value_col, sep, keep=(ts_col,))
    return (
        t.groupBy(F.window(ts_col, width).alias("w"), "token")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "token", "n")
    )
