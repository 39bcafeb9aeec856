"""Web-log request extraction.

One narrow ``select`` turns access-log lines into request records: pick the
URL token, split at the first ``?``, decode the ``name=value`` pairs and pick
the named fields (last one wins). No shuffle, no schema inference, no UDF;
lines too short to carry a URL become rejects instead of killing the job.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import text, urls

# Field names and order of the request record.
REQUEST_FIELDS = ("city", "country", "ip", "appid", "mobile", "imsi", "pvuid")

# 0-based blank-separated token that holds the request URL in the access log.
URL_TOKEN = 8


def with_request_fields(
    df: DataFrame, url_col: str, fields: Sequence[str] = REQUEST_FIELDS, keep: Sequence[str] = ()
) -> DataFrame:
    """W3-W6 on a URL column, keeping ``keep`` columns.

    The decoded name and value arrays are built once, in their own projection
    (Catalyst does not inline a non-cheap alias used many times); each field
    is then a native ``array_position`` lookup of its last occurrence.
    """
    qs = urls.query_string(url_col)
    staged = df.select(*keep, F.reverse(urls.param_names(qs)).alias("_rn"),
                       F.reverse(urls.param_values(qs)).alias("_rv"))
    return staged.select(*keep, *[urls.pick_last("_rn", "_rv", f).alias(f) for f in fields])


def extract_requests(
    lines: DataFrame,
    line_col: str = "value",
    fields: Sequence[str] = REQUEST_FIELDS,
    keep: Sequence[str] = (),
    token_index: int = URL_TOKEN,
    strict: bool = False,
) -> DataFrame:
    """Access-log lines -> request records plus a ``rejected`` flag.

    ``rejected`` is true for a line with fewer than ``token_index + 1``
    tokens (its fields are NULL). ``strict=True`` raises on such a line
    instead, like the original job. A filter on the flag picks the token a
    second time and each action is a pass of its own: use
    :func:`good_requests` for the good rows alone, and write once, partitioned
    by the flag, where both kinds are wanted.
    """
    tok = text.token_at(line_col, token_index)
    if strict:
        tok = F.when(tok.isNull(), F.raise_error(F.concat(F.lit("short log line: "), F.col(line_col)))).otherwise(tok)
    staged = lines.select(*keep, tok.alias("_url"))
    out = with_request_fields(staged, "_url", fields, keep=[*keep, "_url"])
    return out.select(*keep, *fields, F.col("_url").isNull().alias("rejected"))


def good_requests(
    lines: DataFrame,
    line_col: str = "value",
    fields: Sequence[str] = REQUEST_FIELDS,
    keep: Sequence[str] = (),
    token_index: int = URL_TOKEN,
) -> DataFrame:
    """W1 for callers that want the good rows only (no ``rejected`` column).

    The token is picked as a one-element array and exploded, which drops lines
    without a URL: a filter on the picked token would be pushed below the
    projection and pick it a second time, a generator is not.
    """
    tok = text.token_at(line_col, token_index)
    urls_found = F.explode(F.filter(F.array(tok), lambda u: u.isNotNull()))
    staged = lines.select(*keep, urls_found.alias("_url"))
    return with_request_fields(staged, "_url", fields, keep=keep).select(*keep, *fields)


def records_as_json(df: DataFrame, fields: Sequence[str] = REQUEST_FIELDS) -> Column:
    """The record as one compact JSON object, fields in record order.

    A record of all-NULL fields (URL without ``?``) is ``{}``.
    """
    return F.to_json(F.struct(*[F.col(f) for f in fields]))


def partition_layout(df: DataFrame, ds: str | Column, fields: Sequence[str] = REQUEST_FIELDS) -> DataFrame:
    """The fixed column list plus the ``ds`` partition value."""
    return df.select(*fields, (ds if isinstance(ds, Column) else F.lit(ds)).alias("ds"))
