"""SQL twins of the evidence normalisers: one SELECT per rule."""

from __future__ import annotations

from attestry.operators.evidence import CHECK_SIGNALS, FORENSIC_SIGNALS
from attestry.plans.sql_identity import LOOKUP, pairs
from attestry.plans.sql_passport import PASSPORTS
from attestry.plans.sql_validate import CARD_RULES, LICENCES, PERMIT_RULES, TYPED, VISA_RULES

_UNCERTAIN = "VERIFICATION_UNCERTAINTY"


def lit(value) -> str:
    if value is None:
        return "NULL"
    return value[1:] if value.startswith("=") else f"'{value}'"


def row(place, module, condition, signal, category, status, severity, confidence, group=None, available=True, positive=False, field=None, source="mr"):
    """One rule; text starting with '=' is an expression."""
    return (
        f"SELECT case_id, {place} AS place, '{module}' AS module, {lit(signal)} AS signal, {lit(category)} AS category, "
        f"{lit(status)} AS status, {lit(severity)} AS severity, CAST({confidence} AS DOUBLE) AS confidence, "
        f"CAST({lit(group)} AS VARCHAR) AS correlation_group, {str(available).lower()} AS available, "
        f"{str(positive).lower()} AS is_positive, CAST({lit(field)} AS VARCHAR) AS field FROM {source} WHERE {condition}"
    )


_M1, _M3, _M4 = "has_m1 AND m1_status <> 'failed'", "has_m3 AND coalesce(m3_overall, 'insufficient_data') <> 'insufficient_data'", "has_m4"
_M5, _M7 = "has_m5", "has_m7 AND m7_applicable"
_DEC = _M7 + " AND m7_detection = 'DECODED'"
_SB = "CASE WHEN m5_sandbox THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END"
_GOOD = "m4_document_quality = 'acceptable' AND m4_live_quality = 'acceptable'"
_CONDITIONS = {
    "invalid": "true", "failed": "p[3] = 'FAIL'", "known": "p[2] <> 'unknown'", "expired": "p[3] IN ('LICENSE_EXPIRED', 'EXPIRED')",
}

ROWS = [
    row(100, "M1", "NOT has_m1", "ocr_unavailable", _UNCERTAIN, "UNAVAILABLE", "LOW", 1, available=False),
    row(101, "M1", "has_m1 AND m1_status = 'failed'", "ocr_unavailable", _UNCERTAIN, "ERROR", "MEDIUM", 1, available=False),
    row(102, "M1", _M1 + " AND (m1_low_regions OR coalesce(m1_confidence, 0) < 0.65)", "ocr_low_confidence", _UNCERTAIN, "WARNING",
        "=CASE WHEN coalesce(m1_confidence, 0) < 0.5 THEN 'MEDIUM' ELSE 'LOW' END", 0.95),
    row(103, "M1", _M1 + " AND NOT m1_mrz_detected AND m1_mrz_applicable", "mrz_unavailable", "DOCUMENT_STRUCTURE", "FAIL", "HIGH", 0.95),
    row("104 + i", "M1", _M1, "critical_field_unavailable", "DOCUMENT_STRUCTURE", "FAIL", "MEDIUM", 0.9, "OCR_FIELD_AVAILABILITY",
        field="=f", source="missing"),
    row(200, "M2", "NOT has_m2", "module_not_run", _UNCERTAIN, "UNAVAILABLE", "LOW", 1, available=False),
    *[
        row(201 + i, "M2", f"has_m2 AND p[1] = '{name}' AND {_CONDITIONS[condition]}", signal, category, status, severity, confidence, group, source="failed")
        for i, (name, condition, signal, category, status, severity, confidence, group) in enumerate(CHECK_SIGNALS)
    ],
    row(300, "M3", "NOT has_m3", "module_not_run", _UNCERTAIN, "UNAVAILABLE", "LOW", 1, available=False),
    row(301, "M3", "has_m3 AND coalesce(m3_overall, 'insufficient_data') = 'insufficient_data'", "module_not_run", _UNCERTAIN, "INCONCLUSIVE",
        "LOW", 1, available=False),
    row("310 + i", "M3", _M3 + " AND p[2] = 'suspicious'",
        "=coalesce((SELECT max(b) FROM (VALUES " + pairs(FORENSIC_SIGNALS) + ") v(a, b) WHERE a = p[1]), 'forensic_suspicious')",
        "FORENSIC_ANOMALY", "SUSPICIOUS", "=CASE WHEN p[3] IN ('low', 'medium', 'high') THEN upper(p[3]) ELSE 'MEDIUM' END", "coalesce(TRY_CAST(p[4] AS DOUBLE), 0.7)",
        "=CASE WHEN p[1] IN ('ela', 'compression', 'metadata') THEN 'FORENSIC_IMAGE_SIGNALS' END", source="signals"),
    row(390, "M3", _M3 + " AND m3_overall = 'high_forensic_concern'", "forensic_high_concern", "FORENSIC_ANOMALY", "SUSPICIOUS", "HIGH", 0.8),
    row(391, "M3", _M3 + " AND m3_overall = 'suspicious'", "forensic_suspicious", "FORENSIC_ANOMALY", "SUSPICIOUS", "MEDIUM", 0.75),
    row(392, "M3", _M3 + " AND m3_overall = 'clean'", "forensic_clean", "FORENSIC_ANOMALY", "PASS", "NONE", 0.9, positive=True),
    row(393, "M3", _M3 + " AND m3_model_hit", "neural_tampering_detected", "FORENSIC_ANOMALY", "SUSPICIOUS", "CRITICAL",
        "coalesce(m3_model_confidence, 0.85)", "FORENSIC_IMAGE_SIGNALS"),
    row(400, "M4", "NOT has_m4", "module_not_run", _UNCERTAIN, "UNAVAILABLE", "LOW", 1, available=False),
    row(401, "M4", _M4 + " AND NOT m4_document_face", "face_detection_failed", "BIOMETRIC_CONSISTENCY", "FAIL", "MEDIUM", 0.95, "BIOMETRIC_QUALITY"),
    row(402, "M4", _M4 + " AND NOT m4_live_face", "face_detection_failed", "BIOMETRIC_CONSISTENCY", "FAIL", "MEDIUM", 0.95, "BIOMETRIC_QUALITY"),
    row(403, "M4", _M4 + " AND m4_pad_status = 'suspected_spoof'", "presentation_attack_detected", "PRESENTATION_ATTACK", "SUSPICIOUS",
        "CRITICAL", "coalesce(m4_pad_score, 0.75)", "PRESENTATION_ATTACK_SIGNALS"),
    row(404, "M4", _M4 + " AND m4_pad_status IN ('pass', 'live')", "pad_pass", "PRESENTATION_ATTACK", "PASS", "NONE",
        "coalesce(m4_pad_score, 0.75)", positive=True),
    row(405, "M4", _M4 + " AND m4_pad_status = 'inconclusive'", "pad_inconclusive", "PRESENTATION_ATTACK", "INCONCLUSIVE", "LOW", 0.6),
    row(406, "M4", _M4 + " AND m4_secondary_flags <> ''", "secondary_pad_anomaly", "PRESENTATION_ATTACK", "SUSPICIOUS", "MEDIUM", 0.7,
        "PRESENTATION_ATTACK_SIGNALS"),
    row(407, "M4", _M4 + " AND m4_match = 'match'", "face_match_pass", "BIOMETRIC_CONSISTENCY", "MATCH", "NONE",
        "greatest(0.7, least(1.0, m4_similarity))", positive=True),
    row(408, "M4", _M4 + " AND m4_match = 'no_match'", f"=CASE WHEN {_GOOD} THEN 'face_mismatch_high_quality' ELSE 'face_mismatch_poor_quality' END",
        "BIOMETRIC_CONSISTENCY", "MISMATCH", f"=CASE WHEN {_GOOD} THEN 'HIGH' ELSE 'MEDIUM' END", "m4_similarity", "FACE_IDENTITY_CONSISTENCY"),
    row(409, "M4", _M4 + " AND coalesce(m4_match, 'unavailable') IN ('inconclusive', 'unavailable')", "face_inconclusive",
        "BIOMETRIC_CONSISTENCY", "INCONCLUSIVE", "LOW", 0.7),
    row(500, "M5", "NOT has_m5", "registry_provider_unavailable", _UNCERTAIN, "UNAVAILABLE", "LOW", 1, available=False),
    row(505, "M5", _M5 + " AND m5_status IS NULL", "registry_provider_unavailable", _UNCERTAIN, "UNAVAILABLE", "LOW", 1, available=False),
    row(501, "M5", _M5 + " AND m5_status = 'TIMEOUT'", "module_timeout", _UNCERTAIN, "TIMEOUT", "LOW", 1, available=False),
    row(502, "M5", _M5 + " AND m5_status = 'PROVIDER_ERROR'", "module_error", _UNCERTAIN, "UNAVAILABLE", "LOW", 1, available=False),
    row(503, "M5", _M5 + " AND m5_status = 'LIVE_PROVIDER_NOT_CONFIGURED'", "registry_provider_unavailable", _UNCERTAIN, "UNAVAILABLE", "NONE", 1,
        available=False),
    row(504, "M5", _M5 + " AND m5_status = 'MATCHED'", "registry_matched", "REGISTRY_STATUS", "MATCH", "NONE", _SB, positive=True),
    row(505, "M5", _M5 + " AND m5_status = 'REVOKED'", "registry_revoked", "REGISTRY_STATUS", "REVOKED", "CRITICAL", 0.97, "REGISTRY_STATUS_SIGNALS"),
    row(506, "M5", _M5 + " AND m5_status = 'SUSPENDED'", "registry_suspended", "REGISTRY_STATUS", "SUSPENDED", "CRITICAL", 0.97, "REGISTRY_STATUS_SIGNALS"),
    row(507, "M5", _M5 + " AND m5_status = 'INVALID'", "registry_invalid", "REGISTRY_STATUS", "FAIL", "CRITICAL", f"0.97::DOUBLE * {_SB}"),
    row(508, "M5", _M5 + " AND m5_status = 'MISMATCH'", "registry_mismatch", "REGISTRY_STATUS", "MISMATCH", "HIGH", f"0.95::DOUBLE * {_SB}"),
    row("510 + i", "M5", _M5 + " AND m5_status = 'MISMATCH'", "registry_field_mismatch", "REGISTRY_STATUS", "MISMATCH", "HIGH",
        f"0.95::DOUBLE * {_SB}", "REGISTRY_FIELD_MISMATCHES", field="=f", source="differing"),
    row(520, "M5", _M5 + " AND m5_status = 'EXPIRED'", "registry_expired", "REGISTRY_STATUS", "EXPIRED", "HIGH", f"0.97::DOUBLE * {_SB}"),
    row(521, "M5", _M5 + " AND m5_status = 'NOT_FOUND'", "registry_not_found", "REGISTRY_STATUS", "NOT_FOUND", "MEDIUM", f"0.80::DOUBLE * {_SB}"),
    row(522, "M5", _M5 + " AND m5_status = 'AMBIGUOUS'", "registry_ambiguous", "REGISTRY_STATUS", "INCONCLUSIVE", "MEDIUM", f"0.75::DOUBLE * {_SB}"),
    row(700, "M7", _M7 + " AND m7_detection = 'NOT_DETECTED'", "qr_not_detected", "MACHINE_READABLE", "NOT_FOUND", "NONE", 0.9, available=False),
    row(701, "M7", _M7 + " AND m7_detection = 'DETECTED_NOT_DECODABLE'", "qr_undecodable", "MACHINE_READABLE", "FAIL", "LOW", 0.85,
        "MACHINE_READABLE_SIGNALS"),
    row(702, "M7", _DEC + " AND m7_crypto_status = 'CRYPTO_VERIFICATION_PASSED'", "qr_crypto_verified", "MACHINE_READABLE", "PASS", "NONE", 1,
        positive=True),
    row(703, "M7", _DEC + " AND m7_crypto_status = 'CRYPTO_VERIFICATION_FAILED'", "qr_crypto_invalid", "MACHINE_READABLE", "FAIL", "CRITICAL",
        0.95, "MACHINE_READABLE_SIGNALS"),
    row(704, "M7", _DEC + " AND m7_crypto_status = 'CRYPTO_VERIFICATION_NOT_CONFIGURED'", "qr_crypto_unavailable", _UNCERTAIN, "UNAVAILABLE",
        "NONE", 1, available=False),
    row("710 + i", "M7", _DEC + " AND p[2] = 'QR_FIELD_MATCH'", "qr_ocr_matched", "MACHINE_READABLE", "MATCH", "NONE", 0.95, positive=True,
        field="=p[1]", source="payload"),
    row("710 + i", "M7", _DEC + " AND p[2] = 'QR_FIELD_MISMATCH'",
        "=CASE p[1] WHEN 'license_number' THEN 'qr_ocr_docnumber_mismatch' WHEN 'dob' THEN 'qr_ocr_dob_mismatch' ELSE 'qr_ocr_mismatch' END",
        "MACHINE_READABLE", "MISMATCH", "=CASE p[1] WHEN 'license_number' THEN 'CRITICAL' ELSE 'HIGH' END", 0.92,
        "=CASE p[1] WHEN 'dob' THEN 'DOB_CONSISTENCY' ELSE 'MACHINE_READABLE_SIGNALS' END", field="=p[1]", source="payload"),
]


def listed(name: str, column: str, entry: str) -> str:
    return (
        f"{name} AS (SELECT *, {entry} FROM (SELECT *, unnest(l) AS e, unnest(range(1, len(l) + 1)) AS i FROM "
        f"(SELECT *, list_filter(string_split(coalesce({column}, ''), ';'), lambda x: x <> '') AS l FROM mr) a) b)"
    )


UNION = "WITH mr AS (SELECT * FROM {module_results} AS m0), " + ", ".join(
    [
        listed("missing", "m1_missing", "e AS f"),
        listed("failed", "m2_failed", "string_split(e, ':') AS p"),
        listed("signals", "m3_signals", "string_split(e, ':') AS p"),
        listed("differing", "m5_mismatched", "e AS f"),
        listed("payload", "m7_checks", "string_split(e, ':') AS p"),
    ]
) + ", every AS (" + " UNION ALL ".join(ROWS) + """)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY place) - 1 AS item_seq, module, signal, category, status, severity,
  confidence, CAST(1.0 AS DOUBLE) AS quality, available, correlation_group, is_positive, field FROM every"""

# Outcome, signal, status, severity, confidence with the sandbox factor, group.
_OUTCOMES = """('MATCHED', 'registry_matched', 'MATCH', 'NONE', 0.7, NULL), ('REVOKED', 'registry_revoked', 'REVOKED', 'CRITICAL', 0.97, 'REGISTRY_STATUS_SIGNALS'),
('SUSPENDED', 'registry_suspended', 'SUSPENDED', 'CRITICAL', 0.97, 'REGISTRY_STATUS_SIGNALS'), ('INVALID', 'registry_invalid', 'FAIL', 'CRITICAL', 0.97::DOUBLE * 0.7::DOUBLE, NULL),
('MISMATCH', 'registry_mismatch', 'MISMATCH', 'HIGH', 0.95::DOUBLE * 0.7::DOUBLE, NULL), ('EXPIRED', 'registry_expired', 'EXPIRED', 'HIGH', 0.97::DOUBLE * 0.7::DOUBLE, NULL),
('NOT_FOUND', 'registry_not_found', 'NOT_FOUND', 'MEDIUM', 0.80::DOUBLE * 0.7::DOUBLE, NULL), ('INCONCLUSIVE', 'registry_ambiguous', 'INCONCLUSIVE', 'MEDIUM', 0.75::DOUBLE * 0.7::DOUBLE, NULL)"""

_MAP = ", ".join(
    f"('{n}', '{c}', '{s}', '{k}', '{st}', '{sv}', {cf}, {'NULL' if g is None else repr(g)})" for n, c, s, k, st, sv, cf, g in CHECK_SIGNALS
)

SQL = {
    "evidence_union": UNION,
    "evidence_from_registry": LOOKUP + f""",
codes(outcome, signal, status, severity, confidence, grp) AS (VALUES {_OUTCOMES})
SELECT verification_id, 'M5' AS module, signal, 'REGISTRY_STATUS' AS category, status, severity, CAST(confidence AS DOUBLE) AS confidence,
  true AS available, grp AS correlation_group, registry_status = 'MATCHED' AS is_positive, CAST(NULL AS VARCHAR) AS field
FROM outcomes JOIN codes ON outcome = registry_status
UNION ALL
SELECT f.verification_id, 'M5', 'registry_field_mismatch', 'REGISTRY_STATUS', 'MISMATCH', 'HIGH', 0.95::DOUBLE * 0.7::DOUBLE, true,
  'REGISTRY_FIELD_MISMATCHES', false, field
FROM fields f JOIN outcomes o ON o.verification_id = f.verification_id AND o.registry_status = 'MISMATCH'
WHERE is_critical AND f.status = 'MISMATCH'""",
    "evidence_from_validation": LICENCES
    + "," + VISA_RULES.replace(TYPED, "typed2 AS (" + TYPED.split("AS (", 1)[1] + "").lstrip(",").replace("FROM typed ", "FROM typed2 ")
    + "," + PERMIT_RULES.replace(TYPED + ",", "").replace("FROM typed ", "FROM typed2 ")
    + "," + CARD_RULES.replace(TYPED + ",", "").replace("FROM typed ", "FROM typed2 ")
    + f""",
every AS (SELECT * FROM ({PASSPORTS} SELECT verification_id, check_name, status, valid, severity, reason FROM passport_long) AS p0
  UNION ALL BY NAME SELECT verification_id, check_name, status, valid, severity, reason FROM driving_license_long UNION ALL BY NAME SELECT verification_id, check_name, status, valid, severity, reason FROM visa_long UNION ALL BY NAME SELECT verification_id, check_name, status, valid, severity, reason FROM border_permit_long
  UNION ALL BY NAME SELECT verification_id, check_name, status, valid, severity, reason FROM aadhaar_long UNION ALL BY NAME SELECT verification_id, check_name, status, valid, severity, reason FROM pan_card_long UNION ALL BY NAME SELECT verification_id, check_name, status, valid, severity, reason FROM voter_id_long),
rules(name, cond, signal, category, st, sv, confidence, grp) AS (VALUES {_MAP})
SELECT DISTINCT verification_id, 'M2' AS module, signal, category, st AS status, sv AS severity, CAST(confidence AS DOUBLE) AS confidence,
  true AS available, grp AS correlation_group, false AS is_positive, name
FROM every JOIN rules ON name = check_name AND CASE cond WHEN 'invalid' THEN NOT valid WHEN 'failed' THEN NOT valid AND reason = 'FAIL'
  WHEN 'known' THEN NOT valid AND status <> 'unknown' ELSE reason IN ('LICENSE_EXPIRED', 'EXPIRED') END""",
}
SQL["evidence_from_validation"] = (
    "SELECT * EXCLUDE (name) FROM (" + SQL["evidence_from_validation"] + ") AS named"
)
