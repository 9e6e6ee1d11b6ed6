"""SQL twins of the streaming jobs (the batch result and which part of it the final watermark has closed) and of the stores."""

from __future__ import annotations

from attestry.plans import sql_case, sql_ledger, sql_pairing

_SESSIONS = """
s0 AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM {module_updates} AS m0
  WINDOW w AS (PARTITION BY verification_id ORDER BY ts)
),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY verification_id ORDER BY ts) AS session FROM s0)
"""

# chain of answers: the first lookup asks, and so does the first one more than 300 seconds after the last that asked
_FRESH = """
WITH RECURSIVE a0 AS (
  SELECT document_type, query_hash, provider, ts, min({'e': event_id, 'o': outcome}) AS answer, count(*) AS n
  FROM {lookups} AS l0 WHERE outcome NOT IN ('UNAVAILABLE', 'TIMEOUT', 'PROVIDER_ERROR', 'RATE_LIMITED', 'ERROR')
  GROUP BY document_type, query_hash, provider, ts
),
a AS (SELECT *, (SELECT max(ts) FROM {lookups} AS l1) - INTERVAL 15 MINUTE AS mark FROM a0),
chain AS (
  SELECT document_type, query_hash, provider, min(ts) AS opened FROM a GROUP BY document_type, query_hash, provider
  UNION ALL
  SELECT c.document_type, c.query_hash, c.provider, min(a.ts) FROM chain c JOIN a ON a.document_type = c.document_type
    AND a.query_hash = c.query_hash AND a.provider = c.provider AND a.ts > c.opened + INTERVAL 300 SECOND
  GROUP BY c.document_type, c.query_hash, c.provider, c.opened
),
placed AS (
  SELECT a.*, c.opened FROM a ASOF JOIN chain c ON a.document_type = c.document_type AND a.query_hash = c.query_hash
    AND a.provider = c.provider AND a.ts >= c.opened
)
SELECT document_type, query_hash, provider, strftime(opened, '%Y-%m-%d %H:%M:%S.%f') AS answered_at, min_by(answer, ts).e AS event_id,
  min_by(answer, ts).o AS outcome, CAST(sum(n) AS BIGINT) AS served{state}
FROM placed GROUP BY document_type, query_hash, provider, opened
"""


# the total as a whole and rounded in decimals, so that neither the order of the rows nor a binary fraction decides a half
_EXACT_MEAN = "round(CAST(CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS DECIMAL(20, 8)), 2)::DOUBLE"


def _latency(windows: str, state: str, mean: str = "round(sum(value) / count(*), 2)") -> str:
    """Latency per window of ``windows`` (w, stage, value); a quantile is the first value that q of the rows reach."""
    return f"""
WITH rows AS ({windows}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w, stage ORDER BY value) AS r, count(*) OVER (PARTITION BY w, stage) AS n FROM rows)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, stage, count(*) AS runs, {mean} AS avg_ms,
  round(min(value) FILTER (r >= 0.5 * n), 2) AS p50_ms, round(min(value) FILTER (r >= 0.95 * n), 2) AS p95_ms{state}
FROM ranked GROUP BY w, stage"""


SQL = {
    "case_documents_reader": "SELECT CAST(case_id AS VARCHAR) AS case_id, document_id, document_type, status FROM {case_documents} AS c0",
    "ledger_store": sql_ledger.CHAIN + "SELECT target_id, block_index, event_id, block_hash FROM blocks",
    "registry_type_scan": "SELECT record_id, document_number, name, date_of_birth FROM {registry} AS r0 WHERE document_type = 'passport'",
    "registry_purge": "SELECT document_type, count(*) AS records FROM {registry} AS r0 WHERE document_type <> 'passport' GROUP BY document_type",
    "session_stream": "WITH " + _SESSIONS + """
SELECT verification_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(max(ts) + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS expires_at,
  max_by(result, (ts, result)) FILTER (module = 'M1') AS m1, max_by(result, (ts, result)) FILTER (module = 'M2') AS m2,
  max_by(result, (ts, result)) FILTER (module = 'M3') AS m3, max_by(result, (ts, result)) FILTER (module = 'M4') AS m4,
  max_by(result, (ts, result)) FILTER (module = 'M5') AS m5, count(*) AS updates,
  CASE WHEN max(ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM s) - INTERVAL 15 MINUTE THEN 'closed' ELSE 'open' END AS state
FROM s GROUP BY verification_id, session""",
    "registry_fresh": _FRESH.replace("{state}", ""),
    "registry_dedup_stream": _FRESH.replace("{state}", ", CASE WHEN opened + INTERVAL 300 SECOND < any_value(mark) THEN 'closed' ELSE 'open' END AS state"),
    "latency_stream": _latency(
        "SELECT time_bucket(INTERVAL 1 HOUR, started_at) AS w, stage, duration_ms AS value, max(started_at) OVER () AS newest FROM {stage_events} AS e0",
        ", CASE WHEN w + INTERVAL 1 HOUR <= any_value(newest) - INTERVAL 15 MINUTE THEN 'closed' ELSE 'open' END AS state",
    ),
    "latency_sliding": _latency(
        "SELECT time_bucket(INTERVAL 1 HOUR, started_at) - i * INTERVAL 1 HOUR AS w, stage, duration_ms AS value FROM {stage_events} AS e0, range(24) AS r(i)", "", _EXACT_MEAN
    ),
    "case_stream_expiring": f"""
SELECT r.*, CASE WHEN l.newest + INTERVAL 3600 SECOND < (SELECT max(CAST(uploaded_at AS TIMESTAMP)) FROM {{case_documents}} AS d0) - INTERVAL 15 MINUTE
  THEN 'expired' ELSE 'open' END AS state
FROM ({sql_case.SQL['case_risk'].replace('{case_documents}', '{live_documents}')}) AS r
JOIN (SELECT case_id, max(moment) AS newest FROM {{live_documents}} AS l0 GROUP BY case_id) AS l ON l.case_id = r.case_id""",
    "stage_order_stream": sql_pairing.SQL["stage_order"].replace(
        "END AS progress FROM s",
        "END AS progress, CASE WHEN started_at < (SELECT max(started_at) FROM s) - INTERVAL 15 MINUTE THEN 'closed' ELSE 'open' END AS state FROM s",
    ),
}
