"""Inputs derived from the driver tables for the registered queries and the bench.

The log jobs read access-log lines, two-layout comma lines and keyed stream
records. The driver tables hold none of these, so they are rendered from
``events`` by Spark (and by the same expressions in the oracle SQL of
``plans/duck.py``); their size grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.convert import epoch_millis


def access_lines(events: DataFrame) -> DataFrame:
    """Access-log lines derived from the ``events`` table (test and bench input).

    Layout: ``date time ip - - GET status bytes url agent``, URL at token 8.
    Line shape follows ``event_type``: ``error`` lines lack the last two
    tokens (rejects), ``purchase`` URLs have no ``?``, ``signup`` URLs repeat
    ``city``, ``view`` URLs carry ``mobile`` without ``=``; ``pvuid`` is
    form-encoded or malformed.
    """
    e = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    base_q = F.concat(
        F.lit("city="), e,
        F.lit("&country="), F.date_format("ts", "EEE"),
        F.lit("&ip=10.0."), F.col("user_id").cast("string"),
        F.lit("&appid="), k,
    )
    pvuid = F.when(e == "click", F.concat(F.lit("u%20"), F.col("user_id").cast("string"), F.lit("+x")))\
        .otherwise(F.concat(F.lit("%"), F.substring(e, 1, 2), F.col("event_id").cast("string")))
    query = (
        F.when(e == "view", F.concat(base_q, F.lit("&mobile&imsi="), F.col("event_id").cast("string")))
        .when(e == "signup", F.concat(base_q, F.lit("&mobile="), F.col("event_id").cast("string"), F.lit("&city=dup")))
        .otherwise(F.concat(base_q, F.lit("&mobile="), F.col("event_id").cast("string")))
    )
    url = F.when(e == "purchase", F.concat(F.lit("/buy/"), F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit("/pv?"), query, F.lit("&pvuid="), pvuid)
    )
    head = [
        F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), F.lit("-"), F.lit("-"), F.lit("GET"),
        F.lit("200"), F.col("event_id").cast("string"),
    ]
    line = F.when(e == "error", F.concat_ws(" ", *head)).otherwise(
        F.concat_ws(" ", *head, url, F.lit("agent/1.0"))
    )
    return events.select("event_id", "ts", line.alias("value"))


def recon_lines(events: DataFrame) -> DataFrame:
    """Two-layout comma lines derived from ``events`` (test and bench input).

    ``view``/``click``/``signup`` give summary lines ``type,user,count`` whose
    count is the JSON ``k`` (``signup`` appends ``.5``, which does not parse); ``purchase`` gives detail lines whose third token
    is the full timestamp text; ``error`` gives short lines with trailing
    empties that the arity filter drops.
    """
    e = F.col("event_type")
    uid = F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k")
    summary_count = F.when(e == "signup", F.concat(k, F.lit(".5"))).otherwise(k)
    line = (
        F.when(e == "purchase", F.concat_ws(",", F.col("event_id").cast("string"), uid,
                                             F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), e, F.lit("end")))
        .when(e == "error", F.concat(e, F.lit(","), uid, F.lit(",,")))
        .otherwise(F.concat_ws(",", e, uid, summary_count))
    )
    return events.select("event_id", line.alias("value"))


def event_records(events: DataFrame) -> DataFrame:
    """S5-shaped records from ``events``: key = epoch millis, value =
    ``type,user,k`` (``error`` events carry two trailing empty fields)."""
    k = F.get_json_object("props", "$.k")
    value = F.concat_ws(",", "event_type", F.col("user_id").cast("string"), k)
    value = F.when(F.col("event_type") == "error", F.concat(value, F.lit(",,"))).otherwise(value)
    return events.select(epoch_millis("ts").cast("string").alias("key"),
                         value.alias("value"), "ts")
