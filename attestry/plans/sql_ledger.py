"""SQL twins of the ledger and hash queries; chains are recursive, one step per block."""

from __future__ import annotations

from attestry.operators.ledger import SEGMENT_BLOCKS, ZERO_HASH
from attestry.plans.sql_risk import SQL as RISK_SQL

CHAIN = f"""
WITH RECURSIVE numbered AS (
  SELECT *, sha256(payload) AS evidence_hash, row_number() OVER (PARTITION BY target_id ORDER BY event_id) AS block_index
  FROM {{ledger_events}} AS l0
),
placed AS (
  SELECT *, (block_index - 1) // {SEGMENT_BLOCKS} AS segment, (block_index - 1) % {SEGMENT_BLOCKS} AS pos,
    block_index || '|' || recorded_at || '|' || target_id || '|' || event_type || '|' || evidence_hash || '|1.0.0|1.0.0' AS content
  FROM numbered
),
chain AS (
  SELECT target_id, segment, pos, sha256(target_id || '|' || segment) AS previous_hash,
    sha256(sha256(target_id || '|' || segment) || '|' || content) AS block_hash FROM placed WHERE pos = 0
  UNION ALL
  SELECT p.target_id, p.segment, p.pos, c.block_hash, sha256(c.block_hash || '|' || p.content)
  FROM chain c JOIN placed p ON p.target_id = c.target_id AND p.segment = c.segment AND p.pos = c.pos + 1
),
blocks AS (
  SELECT p.target_id, p.segment, p.block_index, p.event_id, p.event_type, p.recorded_at, p.evidence_hash, c.previous_hash, c.block_hash,
    p.payload
  FROM placed p JOIN chain c ON c.target_id = p.target_id AND c.segment = p.segment AND c.pos = p.pos
),
kept AS (SELECT target_id, max(block_index) AS last_index FROM blocks GROUP BY target_id),
left_over AS (
  SELECT * FROM blocks
  WHERE NOT (event_id % 1201 = 0 OR (target_id % 53 = 5 AND block_index <= 2) OR (target_id % 59 = 7 AND block_index > 4) OR target_id % 211 = 11)
),
bad AS (
  SELECT target_id, block_index, CASE WHEN block_index <> before + 1 OR (event_id % 1499 = 0 AND previous_hash <> '{ZERO_HASH}') THEN 'BROKEN_LINK'
    WHEN event_id % 997 = 0 THEN 'TAMPERED_CONTENT' END AS cause
  FROM (SELECT *, coalesce(lag(block_index) OVER (PARTITION BY target_id ORDER BY block_index), 0) AS before FROM left_over) AS b0
),
first_bad AS (
  SELECT target_id, min(block_index) AS block_index, min_by(cause, block_index) AS cause FROM bad WHERE cause IS NOT NULL GROUP BY target_id
),
verified AS (
  SELECT k.target_id, coalesce(n, 0) AS events_verified,
    coalesce(f.block_index, CASE WHEN coalesce(last, 0) < last_index THEN coalesce(last, 0) + 1 END) AS first_bad_block,
    coalesce(f.cause, CASE WHEN coalesce(last, 0) < last_index THEN 'MISSING_BLOCKS' END) AS first_cause
  FROM kept k
  LEFT JOIN (SELECT target_id, count(*) AS n, max(block_index) AS last FROM left_over GROUP BY target_id) l ON l.target_id = k.target_id
  LEFT JOIN first_bad f ON f.target_id = k.target_id
)
"""

_LINES = """
WITH e AS (
  SELECT *, {0} AS line, row_number() OVER (PARTITION BY case_id ORDER BY {1}) - 1 AS pos FROM {{evidence}} AS e0
),
chunks AS (
  SELECT case_id, pos // {2} AS chunk, sha256(string_agg(line, chr(10) ORDER BY pos)) AS h FROM e GROUP BY ALL
),
trees AS (
  SELECT case_id, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, chr(10) ORDER BY chunk)) END AS tree
  FROM chunks GROUP BY case_id
)"""

SQL = {
    "ledger_build": CHAIN + "SELECT * EXCLUDE (payload) FROM blocks",
    "ledger_heads": CHAIN + f""",
heads AS (SELECT target_id, segment, max_by(block_hash, block_index) AS h FROM blocks GROUP BY ALL),
groups AS (SELECT target_id, segment // {SEGMENT_BLOCKS} AS g, sha256(string_agg(h, chr(10) ORDER BY segment)) AS h FROM heads GROUP BY ALL)
SELECT target_id, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, chr(10) ORDER BY g)) END AS head_hash
FROM groups GROUP BY target_id""",
    "ledger_verify": CHAIN + """
SELECT target_id, events_verified, first_cause IS NULL AS chain_valid, first_bad_block, first_cause FROM verified""",
    "integrity_report": CHAIN + """
SELECT target_id, events_verified, first_cause IS NULL AS chain_valid, NOT differs AS evidence_match,
  CASE WHEN first_cause IS NULL AND NOT coalesce(differs, false) THEN 'VALID' ELSE 'INTEGRITY_FAILURE' END AS integrity_status
FROM verified LEFT JOIN (
  SELECT l.target_id, max_by(l.evidence_hash, l.block_index) <> any_value(c.evidence_hash) AS differs FROM left_over l JOIN (
    SELECT target_id, sha256(max_by(payload, event_id) || CASE WHEN target_id % 10 = 0 THEN ' ' ELSE '' END) AS evidence_hash
    FROM {ledger_events} AS l1 GROUP BY target_id) c ON c.target_id = l.target_id
  GROUP BY l.target_id) d USING (target_id)""",
    "evidence_package_hash": _LINES.format(
        "item_seq || '|' || case_id || '|' || module || '|' || signal || '|' || category || '|' || status || '|' || severity || '|' || "
        "printf('%.4f', confidence) || '|' || coalesce(correlation_group, '')",
        "item_seq",
        SEGMENT_BLOCKS,
    )
    + "SELECT case_id, tree AS evidence_hash FROM trees",
    "risk_snapshot": _LINES.format(
        "module || '|' || signal || '|' || status || '|' || severity || '|' || printf('%.4f', confidence)",
        "module, signal, item_seq",
        SEGMENT_BLOCKS,
    )
    + f""", assessed AS ({RISK_SQL['risk_override']})
SELECT t.case_id, risk_score, risk_level,
  sha256(t.case_id || '|0.6.0|' || risk_score || '|' || risk_level || '|' || tree) AS snapshot_hash
FROM trees t JOIN assessed a ON a.case_id = t.case_id""",
    "officer_decisions": """
SELECT target_id, count(*) AS decisions, max_by(decision, event_id) AS decision,
  max_by(sha256(target_id || '|' || event_id || '|' || decision || '|' || recorded_at), event_id) AS decision_hash,
  max(event_id) AS event_id FROM {ledger_events} AS l0 GROUP BY target_id""",
}
