"""SQL twin of the passport job: facts of each passport, then one SELECT per check."""

from __future__ import annotations

from attestry.plans.sql_pairing import VIZ
from attestry.plans.sql_validate import LINES, REF, SQL as VALIDATE_SQL, TYPED, weighted

_UNREAD = "CASE WHEN unequal THEN 'unknown'"


def _select(name: str, status: str, valid: str, severity: str = "NULL", reason: str = "NULL") -> str:
    return f"SELECT verification_id, '{name}' AS check_name, {status} AS status, {valid} AS valid, {severity} AS severity, {reason} AS reason FROM facts"


def _digit(name: str, right: str, severity: str) -> str:
    good = f"NOT unequal AND {right}"
    return _select(
        name, f"CASE WHEN {good} THEN 'passed' ELSE 'failed' END", good,
        f"CASE WHEN NOT unequal AND NOT ({right}) THEN '{severity}' END", f"CASE WHEN NOT unequal AND NOT ({right}) THEN 'CHECK_DIGIT' END",
    )


def _viz(name: str, match: str, severity: str) -> str:
    return _select(
        f"viz_mrz_{name}", f"{_UNREAD} WHEN {match} THEN 'match' WHEN NOT {match} THEN 'mismatch' ELSE 'unknown' END",
        f"unequal OR coalesce({match}, true)", f"CASE WHEN NOT unequal AND NOT {match} THEN {severity} END",
        f"CASE WHEN NOT unequal AND NOT {match} THEN 'VIZ_MRZ_MISMATCH' END",
    )


_LATE, _ODD = f"expires < {REF}", "expires <= issued OR years > 10"
_CHECKS = [
    _select("mrz_structure", "CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END", "n = 0",
            "CASE WHEN n > 0 THEN CASE WHEN grave THEN 'critical' ELSE 'warning' END END", "CASE WHEN n > 0 THEN 'MRZ_STRUCTURE' END"),
    _select("mrz_auto_correction", "CASE WHEN tags = '' THEN 'passed' WHEN risky THEN 'failed' ELSE 'warning' END", "NOT risky",
            "CASE WHEN tags <> '' THEN CASE WHEN risky THEN 'critical' ELSE 'warning' END END",
            "CASE WHEN tags <> '' THEN CASE WHEN risky THEN 'HIGH_RISK_CORRECTION' ELSE 'SAFE_CORRECTION' END END"),
    _select("mrz_length", "CASE WHEN unequal THEN 'failed' ELSE 'passed' END", "NOT unequal", "CASE WHEN unequal THEN 'critical' END",
            "CASE WHEN unequal THEN 'LENGTH_CRITICAL' END"),
    _digit("document_number_checksum", f"CAST({weighted('substr(l2, 1, 9)')} AS VARCHAR) = l2[10]", "failure"),
    _digit("dob_checksum", f"CAST({weighted('substr(l2, 14, 6)')} AS VARCHAR) = l2[20]", "failure"),
    _digit("expiry_checksum", f"CAST({weighted('substr(l2, 22, 6)')} AS VARCHAR) = l2[28]", "failure"),
    _digit("composite_checksum", f"CAST({weighted('(substr(l2, 1, 10) || substr(l2, 14, 7) || substr(l2, 22, 22))')} AS VARCHAR) = l2[44]", "critical"),
    _select("expiry_date", f"{_UNREAD} WHEN expires IS NULL THEN 'unknown' WHEN {_LATE} THEN 'failed' ELSE 'passed' END",
            f"NOT unequal AND coalesce(NOT {_LATE}, false)", f"CASE WHEN NOT unequal AND coalesce({_LATE}, true) THEN 'failure' END",
            f"CASE WHEN NOT unequal THEN CASE WHEN expires IS NULL THEN 'UNPARSEABLE_DATE' WHEN {_LATE} THEN 'EXPIRED' END END"),
    _select("validity_period", f"{_UNREAD} WHEN {_ODD} THEN 'warning' WHEN expires > issued THEN 'passed' ELSE 'unknown' END",
            f"NOT unequal AND NOT coalesce({_ODD}, false)", f"CASE WHEN NOT unequal AND ({_ODD}) THEN 'warning' END",
            "CASE WHEN NOT unequal THEN CASE WHEN expires <= issued THEN 'INVERTED_VALIDITY' WHEN years > 10 THEN 'EXCEEDS_STANDARD_TERM' END END"),
    _select("passport_number_binding", f"{_UNREAD} WHEN num THEN 'passed' WHEN NOT num THEN 'failed' ELSE 'unknown' END",
            "NOT unequal AND coalesce(num, true)", "CASE WHEN NOT unequal AND NOT num THEN 'critical' END",
            "CASE WHEN NOT unequal AND NOT num THEN 'NUMBER_MISMATCH' END"),
    _viz("document_number", "num", "NULL"),
    _viz("name", "nam", "'warning'"),
    _viz("date_of_birth", "born", "'warning'"),
    _viz("other", "other", "'warning'"),
]

PASSPORTS = TYPED + f""",
marks AS (SELECT verification_id, count(*) AS n, bool_or(severity = 'critical') AS grave FROM ({LINES} SELECT * FROM issues) AS i0 GROUP BY 1),
zones AS (
  SELECT verification_id, bool_or(match) FILTER (field = 'document_number') AS num, bool_or(match) FILTER (field = 'name') AS nam,
    bool_or(match) FILTER (field = 'date_of_birth') AS born, bool_and(match) FILTER (field IN ('nationality', 'expiry_date', 'gender')) AS other
  FROM ({VIZ}) AS v0 GROUP BY 1
),
spans AS ({VALIDATE_SQL['validity_window']}),
facts AS (
  SELECT t.verification_id, coalesce(n, 0) AS n, coalesce(grave, false) AS grave, num, nam, born, other,
    replace(upper(trim(t.mrz_line2)), ' ', '<') AS l2, length(trim(t.mrz_line1)) <> 44 OR length(trim(t.mrz_line2)) <> 44 AS unequal,
    coalesce(t.mrz_corrections, '') AS tags, len(list_filter(string_split(coalesce(t.mrz_corrections, ''), ','),
      lambda x: x <> '' AND NOT ends_with(string_split(x, ':')[2], '_safe'))) > 0 AS risky,
    CAST(s.mrz_expiry_date AS DATE) AS expires, CAST(s.issue_date AS DATE) AS issued,
    round(date_diff('day', CAST(s.issue_date AS DATE), CAST(s.mrz_expiry_date AS DATE)) / 365.25, 2) AS years
  FROM typed t LEFT JOIN marks m ON m.verification_id = t.verification_id LEFT JOIN zones z ON z.verification_id = t.verification_id
    LEFT JOIN spans s ON s.verification_id = t.verification_id WHERE t.kind = 'passport'
),
passport_long AS ({' UNION ALL '.join(_CHECKS)})
"""

SQL = {
    "passport_rules": PASSPORTS + """
SELECT verification_id, 'passport' AS document_type, check_name, status, valid, severity, reason,
  CASE WHEN bool_or(severity IN ('critical', 'failure')) OVER w THEN 'failed' WHEN bool_or(severity = 'warning') OVER w THEN 'warning'
    ELSE 'passed' END AS overall
FROM passport_long WINDOW w AS (PARTITION BY verification_id)""",
}
