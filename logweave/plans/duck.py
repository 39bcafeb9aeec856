"""DuckDB SQL fragments used by the oracle statements.

They restate the Java rules in DuckDB's dialect (1-based lists, ``lambda``
syntax, RE2 regexes); they are text builders only, nothing here runs Spark.
"""

from __future__ import annotations


def java_split(x: str, sep: str) -> str:
    """Java ``String.split`` of a one-character separator: trailing empties dropped."""
    return (f"(CASE WHEN regexp_full_match({x}, '[{sep}]+') THEN []::VARCHAR[] "
            f"ELSE string_split(regexp_replace({x}, '[{sep}]+$', ''), '{sep}') END)")


def decode(y: str) -> str:
    """Form decoding; text with a ``%`` not followed by two hex digits stays raw.

    Java also reads a signed escape (``%+a`` is a newline, ``%-a`` fails);
    DuckDB has no such form, so the oracle treats both as malformed. Escapes
    that decode to invalid UTF-8 become U+FFFD in Java and raise in DuckDB.
    The driver tables carry none of these.
    """
    return (f"(CASE WHEN strpos(regexp_replace({y}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') > 0 "
            f"THEN {y} ELSE url_decode(replace({y}, '+', ' ')) END)")


def query_string(u: str) -> str:
    return f"(CASE WHEN strpos({u}, '?') > 0 THEN substr({u}, strpos({u}, '?') + 1) END)"


def pairs(qs: str) -> str:
    name = "substr(kv, 1, strpos(kv, '=') - 1)"
    value = "substr(kv, strpos(kv, '=') + 1)"
    kv_split = (f"CASE WHEN strpos(kv, '=') = 0 THEN [{decode('kv')}, ' '] "
                f"ELSE [{decode(name)}, {decode(value)}] END")
    return f"list_transform({java_split(qs, '&')}, lambda kv: {kv_split})"


def pick(pairs_col: str, qs_col: str, name: str) -> str:
    return (f"CASE WHEN {qs_col} IS NULL THEN NULL "
            f"ELSE coalesce(list_filter({pairs_col}, lambda p: p[1] = '{name}')[-1][2], '') END")


# events -> access-log lines (mirror of plans.inputs.access_lines)
ACCESS_LINES = """
ev AS (
  SELECT event_id, ts, user_id, event_type AS e, json_extract_string(props, '$.k') AS k FROM events
),
ev_q AS (
  SELECT *,
    'city=' || e || '&country=' || strftime(ts, '%a') || '&ip=10.0.' || CAST(user_id AS VARCHAR) || '&appid=' || k AS base_q,
    CASE WHEN e = 'click' THEN 'u%20' || CAST(user_id AS VARCHAR) || '+x'
         ELSE '%' || substr(e, 1, 2) || CAST(event_id AS VARCHAR) END AS pvuid
  FROM ev
),
ev_u AS (
  SELECT *,
    CASE WHEN e = 'purchase' THEN '/buy/' || CAST(event_id AS VARCHAR)
         ELSE '/pv?' || CASE WHEN e = 'view' THEN base_q || '&mobile&imsi=' || CAST(event_id AS VARCHAR)
                             WHEN e = 'signup' THEN base_q || '&mobile=' || CAST(event_id AS VARCHAR) || '&city=dup'
                             ELSE base_q || '&mobile=' || CAST(event_id AS VARCHAR) END
              || '&pvuid=' || pvuid END AS url
  FROM ev_q
),
lines AS (
  SELECT event_id, ts,
    CASE WHEN e = 'error' THEN concat_ws(' ', strftime(ts, '%Y-%m-%d'), strftime(ts, '%H:%M:%S'),
                                         '10.0.0.' || CAST(user_id AS VARCHAR), '-', '-', 'GET', '200', CAST(event_id AS VARCHAR))
         ELSE concat_ws(' ', strftime(ts, '%Y-%m-%d'), strftime(ts, '%H:%M:%S'),
                        '10.0.0.' || CAST(user_id AS VARCHAR), '-', '-', 'GET', '200', CAST(event_id AS VARCHAR),
                        url, 'agent/1.0') END AS value
  FROM ev_u
)"""

REQUEST_FIELDS = ("city", "country", "ip", "appid", "mobile", "imsi", "pvuid")

# access-log lines -> request records with the rejected flag
REQUEST_RECORDS = ACCESS_LINES + f""",
tok AS (SELECT event_id, ts, {java_split('value', ' ')}[9] AS url FROM lines),
rq AS (SELECT event_id, ts, url, {query_string('url')} AS qs FROM tok),
rp AS (SELECT event_id, ts, url, qs, {pairs('qs')} AS kvs FROM rq),
records AS (
  SELECT event_id, ts, {', '.join(pick('kvs', 'qs', f) + ' AS ' + f for f in REQUEST_FIELDS)},
         url IS NULL AS rejected
  FROM rp
)"""

# events -> two-layout comma lines (mirror of plans.inputs.recon_lines)
RECON_LINES = """
rl AS (
  SELECT event_id, ts,
    CASE WHEN event_type = 'purchase'
           THEN concat_ws(',', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR),
                          strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), event_type, 'end')
         WHEN event_type = 'error' THEN event_type || ',' || CAST(user_id AS VARCHAR) || ',,'
         ELSE concat_ws(',', event_type, CAST(user_id AS VARCHAR),
                        CASE WHEN event_type = 'signup' THEN json_extract_string(props, '$.k') || '.5'
                             ELSE json_extract_string(props, '$.k') END)
    END AS value
  FROM events
)"""

CLASSIFIED = RECON_LINES + f""",
rw AS (SELECT event_id, {java_split('value', ',')} AS w FROM rl),
classified AS (
  SELECT event_id,
    CASE WHEN length(w[3]) > 18 THEN w[len(w) - 1] ELSE w[1] END AS key,
    CASE WHEN length(w[3]) > 18 THEN 0
         WHEN regexp_full_match(w[3], '[+-]?[0-9]+') THEN coalesce(TRY_CAST(w[3] AS BIGINT), 0)
         ELSE 0 END::BIGINT AS reported,
    CASE WHEN length(w[3]) > 18 THEN 1 ELSE 0 END::BIGINT AS actual
  FROM rw WHERE len(w) >= 3
)"""

# events -> Kafka-style records (mirror of plans.inputs.event_records)
EVENT_RECORDS = """
recs AS (
  SELECT CAST(epoch_us(ts) // 1000 AS VARCHAR) AS key, ts,
    concat_ws(',', event_type, CAST(user_id AS VARCHAR), json_extract_string(props, '$.k'))
      || CASE WHEN event_type = 'error' THEN ',,' ELSE '' END AS value
  FROM events
)"""

TOKENS = EVENT_RECORDS + f""",
toks AS (SELECT ts, unnest({java_split('value', ',')}) AS token FROM recs WHERE value IS NOT NULL)"""
