"""Reconciliation and token-count queries: F1-F3, R1, R2, S9, A1, S4, S5,
T1, T2 on lines and records derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions.text import java_split, parse_long_or_zero
from logweave.functions.convert import epoch_millis
from logweave.operators import aggregates, reconcile
from logweave.plans import duck, inputs
from logweave.plans.registry import register
from logweave.session import shared_dir, table
from logweave.sources import kafka
from logweave.streaming import tokens as stream_tokens


def recon_lines(spark, sf):
    return inputs.recon_lines(table(spark, sf, "events"))


@register("f1_java_split_arity", f"""
WITH {duck.RECON_LINES},
rw AS (SELECT event_id, {duck.java_split('value', ',')} AS w FROM rl)
SELECT event_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, '|') AS joined, len(w) >= 3 AS kept FROM rw""")
def f1_java_split_arity(spark, sf):
    w = java_split("value", ",")
    return recon_lines(spark, sf).select(
        "event_id", F.size(w).alias("n_tokens"), F.array_join(w, "|").alias("joined"),
        (F.size(w) >= reconcile.MIN_TOKENS).alias("kept"),
    )


@register("f2_line_classify", f"""
WITH {duck.CLASSIFIED}
SELECT event_id, key, CASE WHEN actual = 1 THEN 'detail' ELSE 'summary' END AS kind FROM classified""")
def f2_line_classify(spark, sf):
    c = reconcile.classify(recon_lines(spark, sf), keep=("event_id",))
    return c.select("event_id", "key", F.when(F.col("actual") == 1, "detail").otherwise("summary").alias("kind"))


@register("f3_safe_long_parse", f"""
WITH {duck.RECON_LINES},
rw AS (SELECT event_id, {duck.java_split('value', ',')}[3] AS token FROM rl)
SELECT event_id, token,
  CASE WHEN regexp_full_match(token, '[+-]?[0-9]+') THEN coalesce(TRY_CAST(token AS BIGINT), 0) ELSE 0 END::BIGINT AS parsed
FROM rw""")
def f3_safe_long_parse(spark, sf):
    tok = F.get(java_split("value", ","), 2)
    return recon_lines(spark, sf).select("event_id", tok.alias("token"), parse_long_or_zero(tok).alias("parsed"))


R1_SQL = f"""
WITH {duck.CLASSIFIED}
SELECT key, CAST(sum(reported) AS BIGINT) AS reported, CAST(sum(actual) AS BIGINT) AS actual
FROM classified GROUP BY key"""


@register("r1_reconcile", R1_SQL)
def r1_reconcile(spark, sf):
    return reconcile.reconcile(recon_lines(spark, sf))


@register("r2_reconcile_mismatch", f"""
WITH t AS ({R1_SQL})
SELECT key, reported, actual, reported - actual AS diff FROM t WHERE reported <> actual""")
def r2_reconcile_mismatch(spark, sf):
    return reconcile.mismatches(reconcile.reconcile(recon_lines(spark, sf)))


@register("s9_pair_text_sink", f"""
WITH t AS ({R1_SQL})
SELECT '(' || key || ',(' || CAST(reported AS VARCHAR) || ',' || CAST(actual AS VARCHAR) || '))' AS value FROM t""")
def s9_pair_text_sink(spark, sf):
    path = shared_dir(spark, "s9")
    reconcile.write_pair_text(reconcile.reconcile(recon_lines(spark, sf)), path)
    return spark.read.text(path)


@register("a1_token_count", f"""
WITH {duck.TOKENS}
SELECT token, count(*) AS n FROM toks GROUP BY token""")
def a1_token_count(spark, sf):
    return aggregates.token_count(inputs.event_records(table(spark, sf, "events")))


@register("a1_document_word_count", f"""
SELECT token, count(*) AS n FROM (SELECT unnest({duck.java_split('text', ' ')}) AS token FROM documents) GROUP BY token""")
def a1_document_word_count(spark, sf):
    """A1 over whole document texts: blank-separated tokens, counted."""
    return aggregates.token_count(table(spark, sf, "documents"), "text", " ")


@register("s4_kafka_decode", f"""
WITH {duck.EVENT_RECORDS}
SELECT key, value FROM recs""")
def s4_kafka_decode(spark, sf):
    # rows shaped as the Kafka source delivers them: binary key and value
    recs = inputs.event_records(table(spark, sf, "events"))
    raw = recs.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
                      F.lit("events").alias("topic"))
    return kafka.kafka_values(raw)


@register("s5_keyed_records", """
SELECT CAST(epoch_us(ts) // 1000 AS VARCHAR) AS key,
       event_type || ',' || CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END || ',' || json_extract_string(props, '$.k') AS value
FROM events""")
def s5_keyed_records(spark, sf):
    """Errors have no user: their second field stays, empty."""
    e = table(spark, sf, "events")
    user = F.when(F.col("event_type") != "error", F.col("user_id"))
    return kafka.keyed_records(e, epoch_millis("ts"), ["event_type", user, F.get_json_object("props", "$.k")])


T1_BATCHES = 3
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


@register("t1_stream_batch_counts", f"""
WITH {duck.TOKENS.replace('SELECT CAST(epoch_us(ts)', 'SELECT event_id % 3 AS batch_id, CAST(epoch_us(ts)').replace('toks AS (SELECT ts,', 'toks AS (SELECT batch_id, ts,')}
SELECT CAST(batch_id AS BIGINT) AS batch_id, token, count(*) AS n FROM toks GROUP BY batch_id, token""")
def t1_stream_batch_counts(spark, sf):
    """A file stream that gets three deliveries of events; the query is stopped
    and resumed from its checkpoint in between, so each delivery is one
    micro-batch with counts of its own."""
    events = table(spark, sf, "events")
    inbox, sink, ckpt = (shared_dir(spark, "t1", part) for part in ("inbox", "sink", "checkpoint"))
    for i in range(T1_BATCHES):
        events.where(F.col("event_id") % T1_BATCHES == i).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        q = stream_tokens.start_batch_token_counts(inputs.event_records(stream), sink, ckpt, available_now=True)
        q.awaitTermination()
    return spark.read.parquet(sink).select(F.col("batch_id").cast("bigint").alias("batch_id"), "token", "n")


#: Rows up to an hour before the end of a delivery may come with the next one;
#: every 97th row of the first delivery comes with the last, long after its window.
_LATE = "(event_id % 97 = 0 AND part = 0)"
_DELIVERED = """
seg AS (SELECT *, least((epoch_us(ts) - lo) * 3 // (hi - lo + 1), 2) AS part,
               lo + (least((epoch_us(ts) - lo) * 3 // (hi - lo + 1), 2) + 1) * (hi - lo + 1) // 3 AS part_end
        FROM recs, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM recs))"""


@register("t2_stream_window_counts", f"""
WITH {duck.EVENT_RECORDS.replace('SELECT CAST(epoch_us(ts)', 'SELECT event_id, CAST(epoch_us(ts)')}, {_DELIVERED.strip()},
toks AS (SELECT ts, unnest({duck.java_split('value', ',')}) AS token FROM seg WHERE value IS NOT NULL AND NOT {_LATE}),
w AS (SELECT time_bucket(INTERVAL 20 SECOND, ts, TIMESTAMP '1970-01-01') AS s, token, count(*) AS n FROM toks GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, token, n FROM w
WHERE s + INTERVAL 20 SECOND <= (SELECT date_trunc('millisecond', max(ts)) FROM recs) - INTERVAL 2 HOUR""")
def t2_stream_window_counts(spark, sf):
    """Three deliveries, the query stopped and resumed in between. Some rows
    come one delivery late but within the delay of the watermark, others long
    after their window is closed; these are dropped. The closed windows are
    those of the batch twin."""
    events = table(spark, sf, "events")
    lo, hi = events.select(F.min(F.expr(_MICROS)), F.max(F.expr(_MICROS))).first()
    span = hi - lo + 1
    part = F.least(F.expr(f"({_MICROS} - {lo}L) * 3 div {span}L"), F.lit(2))
    staged = events.withColumn("part", part).withColumn("left", F.expr(f"{lo}L + (part + 1) * {span}L div 3 - {_MICROS}"))
    late = (F.col("event_id") % 97 == 0) & (F.col("part") == 0)
    behind = (F.col("left") < 3_600_000_000) & (F.col("event_id") % 3 == 0) & (F.col("part") < 2)
    delivery = F.when(late, F.lit(2)).when(behind, F.col("part") + 1).otherwise(F.col("part"))
    inbox, sink, ckpt = (shared_dir(spark, "t2", part) for part in ("inbox", "sink", "checkpoint"))
    for i in range(3):
        staged.where(delivery == i).select(*events.columns).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        q = stream_tokens.start_windowed_token_counts(inputs.event_records(stream), sink, ckpt, "2 hours", available_now=True)
        q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "token", "n")


@register("t2_window_token_counts", f"""
WITH {duck.TOKENS}
SELECT strftime(time_bucket(INTERVAL 20 SECOND, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
       token, count(*) AS n
FROM toks GROUP BY ALL""")
def t2_window_token_counts(spark, sf):
    w = stream_tokens.windowed_token_counts(inputs.event_records(table(spark, sf, "events")))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "token", "n")
