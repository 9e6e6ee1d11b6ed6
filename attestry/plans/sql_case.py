"""SQL twins of the conflict and case queries."""

from __future__ import annotations

from attestry import dims
from attestry.plans.sql_identity import DOCUMENT_TYPE, lenient, nat, tokens
from attestry.plans.sql_risk import _ADVICE, _LEVEL, SCORED

_FAILURES = "('document_number_binding_mismatch', 'viz_mrz_document_number_mismatch', 'document_number_checksum_fail')"


def flags(source: str) -> str:
    """CTEs flags and found (one row per active pattern) over an evidence relation."""
    return f"""
live AS (SELECT * FROM {source} WHERE available),
qr AS (
  SELECT *, CASE WHEN signal LIKE '%dob%' THEN 'dob' WHEN signal LIKE '%docnumber%' THEN 'document_number'
    ELSE 'data_field' END AS qf
  FROM live WHERE module = 'M7' AND (signal LIKE '%mismatch%' OR status = 'MISMATCH')
),
f AS (
  SELECT k.case_id,
    count(*) FILTER (module = 'M4' AND signal = 'face_match_pass') > 0 AS pass,
    count(*) FILTER (module = 'M4' AND signal IN ('face_mismatch_high_quality', 'face_mismatch_poor_quality',
      'presentation_attack_detected')) > 0 AS adverse,
    count(*) FILTER (module = 'M4' AND signal = 'presentation_attack_detected') > 0 AS attack,
    count(*) FILTER (module = 'M4') > 0 AS m4, count(*) FILTER (module = 'M5') > 0 AS m5,
    count(*) FILTER (module = 'M2') > 0 AS m2,
    count(*) FILTER (module = 'M5' AND status IN ('REVOKED', 'SUSPENDED', 'MISMATCH')) > 0 AS blocked,
    count(*) FILTER (module = 'M5' AND status IN ('REVOKED', 'SUSPENDED', 'MISMATCH', 'NOT_FOUND')) > 0 AS a5,
    count(*) FILTER (module = 'M5' AND status IN ('REVOKED', 'SUSPENDED', 'MISMATCH', 'NOT_FOUND', 'EXPIRED', 'INVALID',
      'AMBIGUOUS', 'INCONCLUSIVE')) > 0 AS bad5,
    count(*) FILTER (module = 'M5' AND (status = 'MATCHED' OR signal = 'registry_matched')) > 0 AS matched,
    count(*) FILTER (module = 'M5' AND signal IN ('registry_field_mismatch', 'registry_mismatch')) > 0 AS regmis,
    count(*) FILTER (module = 'M2' AND signal IN {_FAILURES}) > 0 AS numfail,
    count(*) FILTER (module = 'M2' AND signal IN ('document_number_checksum_fail', 'document_number_binding_mismatch')) > 0 AS a2,
    count(*) FILTER (module = 'M3' AND signal = 'forensic_high_concern') > 0 AS high,
    count(*) FILTER (module = 'M3' AND signal IN ('forensic_high_concern', 'forensic_suspicious')) > 0 AS a3,
    min(CASE WHEN signal LIKE '%dob_mismatch%' THEN item_seq END) AS dob_item
  FROM (SELECT DISTINCT case_id FROM {source}) k JOIN live l ON l.case_id = k.case_id GROUP BY k.case_id
),
found AS (
  SELECT case_id, 'C-01' AS conflict_id, 'high' AS severity, 'M4,M5' AS modules_involved FROM f
    WHERE (pass OR (NOT adverse AND m4)) AND blocked
  UNION ALL SELECT case_id, 'C-02', 'warning', 'M2,M3' FROM f WHERE NOT numfail AND high AND m2
  UNION ALL SELECT case_id, 'C-03', 'warning', 'M2,M5' FROM f WHERE NOT numfail AND regmis
  UNION ALL SELECT case_id, 'C-04', 'high', 'M4,M5' FROM f WHERE attack AND (matched OR (m5 AND NOT bad5))
  UNION ALL SELECT case_id, 'C-05', 'high', concat_ws(',', CASE WHEN a2 THEN 'M2' END, CASE WHEN a3 THEN 'M3' END,
    CASE WHEN a5 THEN 'M5' END) FROM f WHERE a2::INT + a3::INT + a5::INT >= 2
  UNION ALL SELECT DISTINCT case_id, 'C-06', 'high', 'M1,M7' FROM qr
)"""


_DEFS = ", ".join(
    f"('{s}', '{t}', '{a}', '{b}', '{m}', '{k}', {c}, {'NULL' if g is None else repr(g)}, {p})"
    for s, t, a, b, m, k, c, g, p in dims.relationships()
)
_FIELDS = "document_number passport_number name date_of_birth nationality".split()


def relations(filter_status: str) -> str:
    """CTEs active and rel (one row per definition of every active pair)."""
    values = {
        side: f"CASE {field} " + " ".join(f"WHEN '{f}' THEN {side}.{f}" for f in _FIELDS) + " END"
        for side, field in (("a", "sf"), ("b", "tf"))
    }
    return f"""
typed AS (SELECT * REPLACE ({DOCUMENT_TYPE.format('document_type')} AS document_type) FROM {{case_documents}} AS c0),
active AS (
  SELECT * FROM (SELECT *, count(*) FILTER (status <> 'REMOVED') OVER (PARTITION BY case_id, document_type) AS document_revision FROM typed) AS t0
  WHERE {filter_status}
  QUALIFY row_number() OVER (PARTITION BY case_id, document_type ORDER BY uploaded_at DESC, document_id DESC) = 1
),
defs(st, tt, sf, tf, mode, kind, conf, grp, pos) AS (VALUES {_DEFS}),
pairs AS (
  SELECT a.case_id, a.document_id AS source_id, b.document_id AS target_id, d.*,
    trim(coalesce({values['a']}, '')) AS s, trim(coalesce({values['b']}, '')) AS t
  FROM active a JOIN defs d ON d.st = a.document_type JOIN active b ON b.case_id = a.case_id AND b.document_type = d.tt
),
parsed AS (
  SELECT *, {lenient('s')} AS sd, {lenient('t')} AS td, {tokens('s')} AS sn, {tokens('t')} AS tn,
    regexp_matches(s, '^\\d{{4}}$') AS sy, regexp_matches(t, '^\\d{{4}}$') AS ty FROM pairs
),
judged AS (
  SELECT *, CASE WHEN s = '' AND t = '' THEN 'UNAVAILABLE' WHEN s = '' THEN 'MISSING_SOURCE_FIELD'
    WHEN t = '' THEN 'MISSING_TARGET_FIELD'
    WHEN mode = 'STRICT' THEN CASE WHEN regexp_replace(upper(s), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(t), '[^A-Z0-9]', '', 'g')
      THEN 'MATCHED' ELSE 'MISMATCH' END
    WHEN mode = 'NORMALIZED_DATE' AND (sy OR ty) THEN
      CASE WHEN (NOT sy AND sd IS NULL) OR (NOT ty AND td IS NULL) THEN 'INCONCLUSIVE'
        WHEN CASE WHEN sy THEN s ELSE sd[1:4] END = CASE WHEN ty THEN t ELSE td[1:4] END THEN 'CONSISTENT_YEAR'
        ELSE 'MISMATCH' END
    WHEN mode = 'NORMALIZED_DATE' THEN CASE WHEN sd IS NULL OR td IS NULL THEN 'INCONCLUSIVE' WHEN sd = td THEN 'MATCHED' ELSE 'MISMATCH' END
    WHEN mode = 'NORMALIZED_TOKEN_SET' THEN CASE WHEN sn = tn THEN 'MATCHED'
      WHEN list_has_all(sn, tn) OR list_has_all(tn, sn) THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END
    ELSE CASE WHEN {nat('s')} = {nat('t')} THEN 'MATCHED' ELSE 'MISMATCH' END END AS status
  FROM parsed
),
rel AS (
  SELECT *, CASE WHEN status = 'MISMATCH' THEN 'HIGH' WHEN status IN ('PARTIAL_MATCH', 'INCONCLUSIVE') THEN 'LOW' ELSE 'NONE' END AS severity
  FROM judged
)"""


_NOT_REMOVED = "status NOT IN ('REMOVED', 'SUPERSEDED')"
RELATED = "WITH " + relations(_NOT_REMOVED)

# the evidence CTE of the scoring text, replaced by the merged evidence of each case
_MERGED = f"""WITH {relations(_NOT_REMOVED)},
own AS (
  SELECT a.case_id, row_number() OVER (PARTITION BY a.case_id ORDER BY a.document_id, e.item_seq) AS item_seq, e.module, e.signal,
    e.category, e.status, e.severity, e.confidence, e.quality, e.available, e.correlation_group, e.is_positive
  FROM {{evidence}} AS e JOIN active a ON a.document_id = 'DOC-' || e.case_id
),
merged AS (
  SELECT * FROM own
  UNION ALL
  SELECT case_id, 1000000000 + row_number() OVER (PARTITION BY case_id ORDER BY source_id || '-' || target_id, pos), 'CROSS_DOCUMENT',
    'cross_doc_' || lower(kind) || '_' || lower(status), 'DOCUMENT_CONSISTENCY',
    CASE WHEN status = 'MISMATCH' THEN 'MISMATCH' ELSE 'WARNING' END, severity, CAST(conf AS DOUBLE), 1.0, true, grp, false
  FROM rel WHERE status IN ('MISMATCH', 'PARTIAL_MATCH')
),
evidence AS (
  SELECT * FROM merged QUALIFY correlation_group IS DISTINCT FROM 'DOCUMENT_NUMBER_BINDING'
    OR row_number() OVER (PARTITION BY case_id, category, correlation_group ORDER BY item_seq) = 1
)"""
CASE_SCORED = SCORED.replace("WITH evidence AS (SELECT * FROM {evidence} AS e0)", _MERGED)

SQL = {
    "conflicts": "WITH evidence AS (SELECT * FROM {evidence} AS e0)," + flags("evidence") + "SELECT * FROM found",
    "contradictions": "WITH evidence AS (SELECT * FROM {evidence} AS e0)," + flags("evidence") + """
SELECT case_id, qf AS field, 'ocr,m7_qr' AS sources, CASE WHEN qf = 'data_field' THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  item_seq FROM qr
UNION ALL SELECT case_id, 'identity_status', 'm4_biometrics,m5_registry', 'CRITICAL', NULL FROM found WHERE conflict_id = 'C-01'
UNION ALL SELECT case_id, 'document_number', 'm2_validation,m5_registry', 'HIGH', NULL FROM found WHERE conflict_id = 'C-03'
UNION ALL SELECT case_id, 'liveness_vs_registry', 'm4_biometrics,m5_registry', 'HIGH', NULL FROM found WHERE conflict_id = 'C-04'
UNION ALL SELECT case_id, 'dob', 'ocr_viz,ocr_mrz_or_secondary', 'HIGH', dob_item FROM f
  WHERE dob_item IS NOT NULL AND case_id NOT IN (SELECT case_id FROM qr WHERE qf = 'dob')""",
    "active_revisions": RELATED + "SELECT case_id, document_type, document_id, document_revision FROM active",
    "cross_document": RELATED + """
SELECT case_id, 'XDC-' || source_id || '-' || target_id || '-' || lpad(CAST(pos AS VARCHAR), 3, '0') AS evidence_id,
  st AS source_type, tt AS target_type, sf AS source_field, tf AS target_field, kind AS relationship_type, status, severity,
  CAST(conf AS DOUBLE) AS confidence FROM rel""",
    "reference_check": RELATED + r"""
SELECT v.case_id, v.document_id, CASE WHEN coalesce(v.passport_number, '') = '' OR p.case_id IS NULL THEN 'UNAVAILABLE'
  WHEN regexp_replace(upper(v.passport_number), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(p.document_number), '[^A-Z0-9]', '', 'g')
    THEN 'MATCHED' ELSE 'MISMATCHED' END AS status
FROM active v LEFT JOIN active p ON p.case_id = v.case_id AND p.document_type = 'passport' WHERE v.document_type = 'visa'""",
    "removed_evidence_purge": "WITH " + relations("true") + """
SELECT case_id, source_id, target_id, kind AS relationship_type, status FROM rel
WHERE source_id NOT IN (SELECT document_id FROM typed WHERE status <> 'ACTIVE')
  AND target_id NOT IN (SELECT document_id FROM typed WHERE status <> 'ACTIVE')""",
    "case_risk": CASE_SCORED + "," + flags("evidence") + f""",
doc_modules AS (
  SELECT case_id AS k, module, bool_or(available) AS seen, bool_or(NOT available) AS lost FROM {{evidence}} AS e1 GROUP BY case_id, module
),
doc_complete AS (
  SELECT 'DOC-' || k AS document_id, round(least(1.0, sum(CASE WHEN seen AND lost THEN 0.5 WHEN seen THEN 1 ELSE 0 END)
    / (5 + max(CASE WHEN module = 'M7' THEN 1 ELSE 0 END))), 3)::DOUBLE AS part
  FROM doc_modules GROUP BY k
),
means AS (
  SELECT case_id, round(CAST(avg(coalesce(part, 0)) AS DECIMAL(20, 8)), 2)::DOUBLE AS mean, count(*) AS n
  FROM active a LEFT JOIN doc_complete d ON d.document_id = a.document_id GROUP BY case_id
),
cases AS (SELECT DISTINCT case_id FROM typed),
rows AS (
  SELECT c.case_id, coalesce(t.score, 0) AS risk_score, coalesce(n, 0) AS documents_considered,
    coalesce(mean, 1.0) AS verification_completeness,
    c.case_id IN (SELECT case_id FROM found) OR c.case_id IN (SELECT case_id FROM rel WHERE status = 'MISMATCH') AS conflict_detected
  FROM cases c LEFT JOIN totals t ON t.case_id = c.case_id LEFT JOIN means m ON m.case_id = c.case_id
)
SELECT *, {_LEVEL.format('risk_score')} AS risk_level, CASE {_LEVEL.format('risk_score')} {_ADVICE} END AS officer_recommendation
FROM rows""",
    "evidence_summary": SCORED + "," + flags("evidence") + """,
contra AS (
  SELECT case_id FROM qr UNION ALL SELECT case_id FROM found WHERE conflict_id IN ('C-01', 'C-03', 'C-04')
  UNION ALL SELECT case_id FROM f WHERE dob_item IS NOT NULL AND case_id NOT IN (SELECT case_id FROM qr WHERE qf = 'dob')
),
counted AS (
  SELECT case_id, count(*) AS total_evaluated, count(*) FILTER (available) AS available_count,
    count(*) FILTER (NOT available) AS unavailable_count,
    count(*) FILTER (available AND severity <> 'NONE') AS adverse_count,
    count(*) FILTER (available AND is_positive) AS positive_count, count(*) FILTER (uncertain) AS uncertainty_count
  FROM scored GROUP BY case_id
)
SELECT c.*, (SELECT count(*) FROM found x WHERE x.case_id = c.case_id) AS conflict_count,
  (SELECT count(*) FROM contra x WHERE x.case_id = c.case_id) AS contradiction_count FROM counted c""",
    "case_package": RELATED + """
SELECT case_id, document_id, document_type, 'CASE' AS module, 'document_intake' AS signal_type, 'VALID' AS status, 'INFO' AS severity,
  CAST(1.0 AS DOUBLE) AS confidence, 'INT-' || document_id AS evidence_id FROM active
UNION ALL
SELECT case_id, source_id, st, 'CROSS_DOCUMENT', 'cross_doc_consistency',
  CASE status WHEN 'MATCHED' THEN 'VALID' WHEN 'PARTIAL_MATCH' THEN 'WARNING' WHEN 'MISMATCH' THEN 'MISMATCH' ELSE 'INFO' END,
  CASE status WHEN 'PARTIAL_MATCH' THEN 'MEDIUM' WHEN 'MISMATCH' THEN 'HIGH' ELSE 'INFO' END, CAST(conf AS DOUBLE),
  'XDC-' || source_id || '-' || target_id || '-' || lpad(CAST(pos AS VARCHAR), 3, '0') FROM rel""",
    "module_package": """
WITH m AS (SELECT * FROM {module_results} AS m0)
SELECT case_id, 'OCR' AS module, 'ocr_text_extraction' AS signal_type, CASE WHEN m1_status <> 'failed' THEN 'VALID' ELSE 'WARNING' END AS status,
  CASE WHEN m1_status <> 'failed' THEN 'INFO' ELSE 'LOW' END AS severity, coalesce(m1_confidence, 0.95) AS confidence FROM m WHERE has_m1
UNION ALL
SELECT case_id, 'FORENSICS', 'forensic_tampering_analysis',
  CASE m3_overall WHEN 'clean' THEN 'VALID' WHEN 'suspicious' THEN 'SUSPICIOUS' ELSE 'INFO' END,
  CASE m3_overall WHEN 'suspicious' THEN 'HIGH' ELSE 'INFO' END, 0.90 FROM m WHERE has_m3
UNION ALL
SELECT case_id, 'BIOMETRICS', 'face_verification', CASE WHEN coalesce(m4_match, 'pass') IN ('match', 'pass') THEN 'VALID' ELSE 'MISMATCH' END,
  CASE WHEN coalesce(m4_match, 'pass') IN ('match', 'pass') THEN 'INFO' ELSE 'CRITICAL' END, coalesce(m4_similarity, 0.92) FROM m WHERE has_m4
UNION ALL
SELECT case_id, 'REGISTRY', 'registry_' || lower(m5_status),
  CASE m5_status WHEN 'MATCHED' THEN 'VALID' WHEN 'NOT_FOUND' THEN 'WARNING' WHEN 'EXPIRED' THEN 'WARNING' WHEN 'REVOKED' THEN 'SUSPICIOUS'
    WHEN 'SUSPENDED' THEN 'SUSPICIOUS' WHEN 'MISMATCH' THEN 'MISMATCH' WHEN 'TIMEOUT' THEN 'UNAVAILABLE' ELSE 'INFO' END,
  CASE m5_status WHEN 'NOT_FOUND' THEN 'MEDIUM' WHEN 'EXPIRED' THEN 'MEDIUM' WHEN 'REVOKED' THEN 'CRITICAL' WHEN 'SUSPENDED' THEN 'HIGH'
    WHEN 'MISMATCH' THEN 'HIGH' WHEN 'TIMEOUT' THEN 'LOW' ELSE 'INFO' END, 1.0 FROM m WHERE has_m5""",
}
