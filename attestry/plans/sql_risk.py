"""The same results as the risk operators, as plain SQL with windows."""

from __future__ import annotations

from attestry import dims

_POINTS = ", ".join(f"('{s}', '{v}', {p})" for s, _, v, p in dims.signal_points())
_CAPS = ", ".join(f"({i}, '{c}', {cap})" for i, (c, cap) in enumerate(dims.CATEGORY_CAPS.items()))
_ADVICE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.RECOMMENDATIONS.items())
_FALLBACK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.DEFAULT_POINTS.items())

SCORED = f"""
WITH evidence AS (SELECT * FROM {{evidence}} AS e0),
points(signal, severity, points) AS (VALUES {_POINTS}),
caps(pos, category, cap) AS (VALUES {_CAPS}),
based AS (
  SELECT e.*,
    CASE WHEN e.severity = 'NONE' OR NOT e.available THEN 0.0
         ELSE CAST(coalesce(p.points, CASE e.severity {_FALLBACK} END) AS DOUBLE) END AS base,
    CASE WHEN confidence >= 0.80 THEN 1.0 WHEN confidence >= 0.50 THEN 0.85 ELSE 0.60 END::DOUBLE AS cf,
    CASE WHEN quality < 0.99 THEN 0.5 + 0.5 * quality ELSE 1.0 END AS qf
  FROM evidence e LEFT JOIN points p ON e.signal = p.signal AND e.severity = p.severity
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY case_id, category, correlation_group, available
                               ORDER BY base DESC, item_seq) AS rn,
    min(item_seq) OVER (PARTITION BY case_id, category, correlation_group, available) AS group_start
  FROM based
),
scored AS (
  SELECT *, base * (CASE WHEN correlation_group IS NULL OR rn = 1 THEN 1.0 WHEN rn = 2 THEN 0.5 WHEN rn = 3 THEN 0.25
                    ELSE 0.10 END)::DOUBLE * cf * qf AS effect,
    severity IN ('HIGH', 'CRITICAL') AND confidence < 0.5 AS uncertain
  FROM ranked
),
cats AS (
  SELECT k.case_id, c.pos, c.category, CAST(c.cap AS DOUBLE) AS cap, round(coalesce(s.raw, 0), 8) AS raw,
    least(round(coalesce(s.raw, 0), 8), CAST(c.cap AS DOUBLE)) AS capped
  FROM (SELECT DISTINCT case_id FROM evidence) k CROSS JOIN caps c
  LEFT JOIN (SELECT case_id, category, sum(effect) AS raw FROM scored GROUP BY case_id, category) s
    ON s.case_id = k.case_id AND s.category = c.category
),
totals AS (
  SELECT case_id, CAST(least(round_even(round(sum(capped), 8), 0), 100) AS INTEGER) AS score FROM cats GROUP BY case_id
),
modules AS (
  SELECT k.case_id, m.module, count(e.case_id) FILTER (e.available) AS seen,
    count(e.case_id) FILTER (NOT e.available) AS lost
  FROM (SELECT DISTINCT case_id FROM evidence) k
  CROSS JOIN (VALUES ('M1'), ('M2'), ('M3'), ('M4'), ('M5'), ('M7')) m(module)
  LEFT JOIN evidence e ON e.case_id = k.case_id AND e.module = m.module
  GROUP BY k.case_id, m.module
),
states AS (
  SELECT *, CASE WHEN seen > 0 AND lost > 0 THEN 'partial' WHEN seen > 0 THEN 'completed'
                 WHEN lost > 0 THEN 'unavailable' ELSE 'not_run' END AS status
  FROM modules WHERE module <> 'M7' OR seen + lost > 0
),
complete AS (
  SELECT case_id, round(least(1.0, (count(*) FILTER (status = 'completed')
      + 0.5 * count(*) FILTER (status = 'partial')) / count(*)), 3)::DOUBLE AS completeness
  FROM states GROUP BY case_id
)
"""

_LEVEL = "CASE WHEN {0} >= 75 THEN 'CRITICAL' WHEN {0} >= 50 THEN 'HIGH' WHEN {0} >= 25 THEN 'MEDIUM' ELSE 'LOW' END"

SQL = {
    "risk_score": SCORED + f"""
SELECT case_id, score AS risk_score, {_LEVEL.format('score')} AS risk_level,
  CASE {_LEVEL.format('score')} {_ADVICE} END AS officer_recommendation, '0.6.0' AS risk_config_version
FROM totals""",
    "risk_category_breakdown": SCORED + """
SELECT case_id, category, round(CAST(raw AS DECIMAL(20, 8)), 4)::DOUBLE AS raw_contribution, round(CAST(capped AS DECIMAL(20, 8)), 2)::DOUBLE AS contribution, cap AS maximum,
  round(CAST(capped / cap * 100 AS DECIMAL(20, 8)), 1)::DOUBLE AS percentage_of_max FROM cats""",
    "risk_override": SCORED + f""",
flags AS (
  SELECT case_id, count(*) FILTER (uncertain) AS uncertain,
    max(CASE WHEN available AND signal = 'registry_revoked' AND status = 'REVOKED' THEN 85
             WHEN available AND signal = 'presentation_attack_detected' AND severity = 'CRITICAL' THEN 80
             WHEN available AND signal = 'qr_crypto_invalid' THEN 80 ELSE 0 END) AS target
  FROM scored GROUP BY case_id
),
judged AS (
  SELECT t.case_id, score AS base_score, greatest(score, target) AS risk_score, completeness,
    score < target AS critical_override_applied,
    CASE WHEN completeness = 0 THEN 0.0
         ELSE greatest(0.0, least(1.0, round(completeness - 0.05 * uncertain, 3))) END::DOUBLE AS assessment_confidence
  FROM totals t JOIN flags f ON f.case_id = t.case_id JOIN complete c ON c.case_id = t.case_id
),
levels AS (
  SELECT *, CASE WHEN assessment_confidence < 0.20 AND risk_score < 50 THEN 'INCONCLUSIVE'
            ELSE {_LEVEL.format('risk_score')} END AS risk_level FROM judged
)
SELECT *, CASE risk_level {_ADVICE} END AS officer_recommendation FROM levels""",
    "risk_top_contributors": SCORED + """,
placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY case_id ORDER BY effect DESC, c.pos, correlation_group IS NULL,
      CASE WHEN correlation_group IS NOT NULL THEN group_start END,
      CASE WHEN correlation_group IS NOT NULL THEN base END DESC, item_seq) AS position
  FROM scored s JOIN caps c ON c.category = s.category WHERE effect > 0
)
SELECT case_id, CAST(position AS INTEGER) AS position, item_seq, module, signal, severity,
  round(CAST(effect AS DECIMAL(20, 8)), 4)::DOUBLE AS contribution FROM placed WHERE position <= 5""",
    "risk_reasons": SCORED + """,
placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY case_id ORDER BY effect DESC, c.pos, correlation_group IS NULL,
      CASE WHEN correlation_group IS NOT NULL THEN group_start END,
      CASE WHEN correlation_group IS NOT NULL THEN base END DESC, item_seq) AS position
  FROM scored s JOIN caps c ON c.category = s.category WHERE effect > 0 AND severity <> 'NONE'
)
SELECT case_id, 'R-' || module || '-' || lpad(CAST(position AS VARCHAR), CAST(greatest(3, length(CAST(position AS VARCHAR))) AS INTEGER), '0') AS reason_id, position, module, signal, severity,
  round(confidence, 3) AS confidence, round(CAST(effect AS DECIMAL(20, 8)), 4)::DOUBLE AS contribution FROM placed""",
    "risk_uncertainties": SCORED + """
SELECT case_id, item_seq, module, signal, severity, confidence FROM scored WHERE uncertain""",
    "evidence_first_per_signal": SCORED + """
SELECT case_id, 'SUPPORTING' AS kind, module, signal, item_seq,
  CASE WHEN status = 'MATCH' THEN 'CORROBORATED' ELSE 'PASS' END AS value
FROM evidence WHERE available AND (is_positive OR severity = 'NONE')
QUALIFY row_number() OVER (PARTITION BY case_id, signal ORDER BY item_seq) = 1
UNION ALL
SELECT case_id, 'LIMITATION', module, signal, item_seq,
  CASE WHEN module IN ('M1', 'M2') THEN 'HIGH' WHEN module IN ('M4', 'M5') THEN 'MEDIUM' ELSE 'LOW' END
FROM evidence WHERE NOT available OR status IN ('UNAVAILABLE', 'NOT_RUN', 'INCONCLUSIVE')
QUALIFY row_number() OVER (PARTITION BY case_id, module, signal ORDER BY item_seq) = 1""",
    "module_completeness": SCORED + """
SELECT s.case_id, module, status, seen AS evidence_count, completeness
FROM states s JOIN complete c ON c.case_id = s.case_id""",
}
