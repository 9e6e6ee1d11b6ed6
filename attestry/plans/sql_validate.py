"""SQL twins of the validation, routing, capture quality and forensic vote queries."""

from __future__ import annotations

from attestry import dims
from attestry.functions.checks import ICAO_ALPHABET, VERHOEFF_D, VERHOEFF_P
from attestry.plans.sql_identity import (
    DOCUMENT_TYPE, STANDARD, dob, extract, in_list, licence, permit, visa, yob,
)

REF = "DATE '2024-02-01'"


def blank(c: str) -> str:
    return rf"(coalesce({c}, '') = '' OR regexp_matches({c}, '^\s*$'))"


def rule(name: str, *cases: tuple, default: tuple) -> str:
    """One check as a struct; cases are (condition, status, valid, severity, reason)."""

    def value(status, valid, severity=None, reason=None):
        quoted = ["NULL" if v is None else f"'{v}'" for v in (severity, reason)]
        return (
            f"{{'check_name': '{name}', 'status': '{status}', 'valid': {str(valid).lower()}, "
            f"'severity': CAST({quoted[0]} AS VARCHAR), 'reason': CAST({quoted[1]} AS VARCHAR)}}"
        )

    whens = " ".join(f"WHEN {c[0]} THEN {value(*c[1:])}" for c in cases)
    return f"CASE {whens} ELSE {value(*default)} END"


def missing(*columns: str) -> str:
    return " + ".join(f"CAST({blank(c)} AS INT)" for c in columns)


def document_rules(kind: str, date, extra: str, rules: list[str], overall: str) -> str:
    """CTEs ``<kind>_rows`` with the checks list and ``<kind>_long`` with one row per check."""
    return f"""
{kind}_rows AS (
  SELECT *, [{', '.join(rules)}] AS checks FROM (
    SELECT *, CAST({date('date_of_birth')} AS DATE) AS born, CAST({date('issue_date')} AS DATE) AS issued,
      CAST({date('expiry_date')} AS DATE) AS expires{extra}
    FROM typed WHERE kind = '{kind}') q
),
{kind}_long AS (
  SELECT verification_id, kind AS document_type, c.check_name, c.status, c.valid, c.severity, c.reason, {overall} AS overall
  FROM (SELECT verification_id, kind, checks, unnest(checks) AS c FROM {kind}_rows) u
)"""


def severity(*values: str) -> str:
    return f"len(list_filter(checks, lambda x: x.severity IN {in_list(values)})) > 0"


TYPED = f"""
WITH typed AS (SELECT *, {DOCUMENT_TYPE.format('document_type')} AS kind FROM {{submissions}} AS s0)"""

_SIMPLE = "CASE WHEN {0} THEN 'failed' WHEN {1} THEN 'warning' ELSE 'passed' END"

LICENCE_RULES = document_rules(
    "driving_license",
    licence,
    f""", CAST({licence('transport_validity')} AS DATE) AS until, classes_known, classes_unknown, items,
      norm, upper(substr(coalesce(norm, trim(document_number)), 1, 2)) AS code, needed, transport,
      date_diff('day', CAST({licence('date_of_birth')} AS DATE),
        coalesce(CAST({licence('issue_date')} AS DATE), {REF})) / 365.25 AS age""",
    [
        rule(
            "required_fields",
            (f"{missing('name', 'document_number', 'date_of_birth')} > 0", "failed", False, "critical", "REQUIRED_FIELD_MISSING"),
            default=("passed", True),
        ),
        rule(
            "license_number_format",
            (blank("document_number"), "failed", False, "critical", "IDENTIFIER_MISSING"),
            (r"regexp_matches(norm, '^[A-Z]{2}[0-9]{2}(19|20)[0-9]{2}[0-9]{7}$')", "passed", True, None, "VALID"),
            (
                r"regexp_matches(norm, '^[A-Z]{2}[0-9]{2}[0-9]{7,11}$|^[A-Z]{2}[0-9]{2}(19|20)?[0-9]{2,4}[0-9]{4,8}$|^DL[A-Z0-9]{10,16}$')",
                "passed", True, None, "LEGACY_VALID",
            ),
            (
                r"regexp_matches(norm, '^[A-Z]{2}[A-Z0-9\-\s/]{7,22}$') OR regexp_matches(replace(trim(document_number), ' ', ''), '^[A-Z]{2}[A-Z0-9\-\s/]{7,22}$')",
                "warning", False, "warning", "IDENTIFIER_FORMAT_WARNING",
            ),
            default=("warning", False, "warning", "IDENTIFIER_INVALID"),
        ),
        rule(
            "state_validation",
            (f"code IN {in_list(dims.LEGACY_STATES)}", "warning", True, "info", "STATE_CODE_LEGACY"),
            (f"code IN {in_list(dims.STATE_NAMES)}", "passed", True, None, "STATE_CODE_VALID"),
            ("regexp_matches(code, '^[A-Z]{2}$')", "warning", False, "warning", "STATE_CODE_UNKNOWN"),
            default=("unknown", False),
        ),
        rule(
            "date_chronology",
            (f"born > {REF}", "failed", False, "critical", "FUTURE_DOB"),
            ("issued > expires", "failed", False, "critical", "INVERTED_VALIDITY"),
            ("born >= issued", "failed", False, "critical", "DOB_AFTER_ISSUE"),
            ("born >= expires", "failed", False, "critical", "DOB_AFTER_EXPIRY"),
            ("issued IS NULL AND expires IS NULL", "unknown", True),
            default=("passed", True),
        ),
        rule(
            "expiry_date",
            (f"expires < {REF}", "failed", False, "critical", "LICENSE_EXPIRED"),
            ("expires IS NOT NULL", "passed", True),
            default=("unknown", True),
        ),
        rule(
            "age_eligibility",
            ("born IS NULL", "unknown", False),
            ("age > 110", "warning", False, "warning", "IMPLAUSIBLE_AGE"),
            (f"NOT {blank('vehicle_classes')} AND classes_known = '' ", "inconclusive", False),
            (f"NOT {blank('vehicle_classes')} AND age < needed", "failed", False, "critical", "AGE_ELIGIBILITY_FAILED"),
            (f"NOT {blank('vehicle_classes')}", "passed", True),
            ("age >= 18", "passed", True),
            ("age < 16", "failed", False, "critical", "AGE_ELIGIBILITY_FAILED"),
            default=("inconclusive", False),
        ),
        rule(
            "vehicle_class_validation",
            (f"NOT {blank('vehicle_classes')} AND classes_unknown <> ''", "warning", True, "warning", "UNKNOWN_COV"),
            default=("passed", True),
        ),
        rule(
            "transport_validity",
            (f"until < {REF}", "failed", False, "critical", "TRANSPORT_VALIDITY_EXPIRED"),
            ("until IS NOT NULL", "passed", True),
            (f"NOT {blank('transport_validity')}", "warning", False, "warning", "TRANSPORT_VALIDITY_INVALID"),
            ("transport", "warning", False, "warning", "TRANSPORT_VALIDITY_MISSING"),
            default=("passed", True),
        ),
    ],
    f"""CASE WHEN {severity('critical')} OR len(list_filter(checks, lambda x:
        x.check_name IN ('required_fields', 'license_number_format') AND NOT x.valid)) > 0 THEN 'failed'
      WHEN {severity('warning', 'info')} THEN 'warning'
      WHEN len(list_filter(checks, lambda x: x.status = 'inconclusive')) > 0 THEN 'insufficient_data' ELSE 'passed' END""",
)

# classes and numbers of licences, taken from the standardised rows
_AGES = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.CLASS_MIN_AGE.items()) + " ELSE 18 END"
LICENCES = STANDARD + f""",
typed AS (
  SELECT r.*, s.document_number AS norm, s.vehicle_classes AS classes_known, s.unknown_vehicle_classes AS classes_unknown,
    1 AS items, list_max(list_transform(string_split(s.vehicle_classes, ','), lambda c: {_AGES})) AS needed,
    len(list_intersect(string_split(s.vehicle_classes, ','), {list(dims.TRANSPORT_CLASSES)})) > 0 AS transport
  FROM raw r JOIN standard s ON s.verification_id = r.verification_id
),""" + LICENCE_RULES

VISA_RULES = TYPED + "," + document_rules(
    "visa",
    visa,
    "",
    [
        rule(
            "required_fields",
            (f"{missing('document_number', 'name', 'expiry_date')} > 1", "failed", False, "critical", "REQUIRED_FIELDS_MISSING"),
            (f"{missing('document_number', 'name', 'expiry_date')} = 1", "warning", False, "warning", "REQUIRED_FIELDS_MISSING"),
            default=("passed", True),
        ),
        rule(
            "visa_number_format",
            (blank("document_number"), "failed", False),
            ("regexp_matches(upper(trim(document_number)), '^[A-Z0-9]{6,14}$')", "passed", True),
            default=("warning", False, "warning", "NUMBER_FORMAT"),
        ),
        rule(
            "date_chronology",
            ("born >= issued", "failed", False, "critical", "DOB_AFTER_ISSUE"),
            ("issued > expires", "failed", False, "critical", "INVERTED_VALIDITY"),
            ("issued <= expires", "passed", True),
            ("coalesce(issue_date, '') = ''", "passed", True),
            default=("warning", False, "warning", "UNPARSEABLE_DATE"),
        ),
        rule(
            "expiry_date",
            (f"expires < {REF}", "failed", False, "critical", "EXPIRED"),
            ("expires IS NOT NULL", "passed", True),
            default=("warning", False, "warning", "UNPARSEABLE_DATE"),
        ),
        rule(
            "passport_reference",
            (blank("passport_number"), "warning", True),
            ("regexp_matches(upper(trim(passport_number)), '^[A-Z0-9]{6,12}$')", "passed", True),
            default=("warning", False, "warning", "REFERENCE_FORMAT"),
        ),
        rule("field_consistency", ("regexp_matches(name, '[0-9]')", "warning", False, "warning", "DIGIT_IN_NAME"), default=("passed", True)),
    ],
    _SIMPLE.format(severity("critical"), severity("warning")),
)

_PERMIT = r"regexp_replace(upper(trim(document_number)), '[\s\-_/]', '', 'g')"
_AMBIGUOUS = rf"""((regexp_matches(upper(document_number), 'BP[- ]?(20\d{{2}}|19\d{{2}})[- ]?[0-9OIL]{{6}}')
    AND regexp_matches(right(upper(trim(document_number)), 6), '[OIBD]'))
  OR CASE WHEN regexp_matches({_PERMIT}, '^BP\d{{6,12}}$') THEN false
          WHEN {_PERMIT} LIKE 'BP%' AND length({_PERMIT}) >= 8 THEN NOT regexp_matches({_PERMIT}, '^BP\d+$')
          ELSE NOT regexp_matches({_PERMIT}, '^[A-Z0-9]+$') END)"""

PERMIT_RULES = TYPED + "," + document_rules(
    "border_permit",
    permit,
    "",
    [
        rule(
            "required_fields",
            (
                f"{missing('document_number', 'name', 'issue_date', 'expiry_date')} > 0",
                "failed", False, "critical", "REQUIRED_FIELDS_MISSING",
            ),
            default=("passed", True),
        ),
        rule(
            "identifier_format",
            (blank("document_number"), "failed", False),
            (_AMBIGUOUS, "warning", False, "warning", "AMBIGUOUS_IDENTIFIER"),
            (rf"regexp_matches({_PERMIT}, '^BP\d{{6,12}}$')", "passed", True),
            default=("warning", False, "warning", "FORMAT_WARNING"),
        ),
        rule(
            "validity_period",
            ("issued > expires", "failed", False, "high", "INVALID_RANGE"),
            (f"issued IS NOT NULL AND expires < {REF}", "warning", False, "medium", "EXPIRED"),
            (f"expires IS NOT NULL AND issued > {REF}", "warning", False, "medium", "NOT_YET_VALID"),
            ("issued IS NOT NULL AND expires IS NOT NULL", "passed", True, None, "ACTIVE"),
            (f"NOT {blank('issue_date')} OR NOT {blank('expiry_date')}", "warning", False, "warning", "INCOMPLETE_DATES"),
            default=("failed", False, None, "UNKNOWN"),
        ),
        rule(
            "passport_binding",
            (blank("passport_number"), "not_applicable", True),
            ("regexp_matches(upper(trim(passport_number)), '^[A-Z0-9]{6,9}$')", "passed", True),
            default=("warning", False, "warning", "PASSPORT_SYNTAX_WARNING"),
        ),
    ],
    _SIMPLE.format(severity("critical", "high"), severity("warning", "medium")),
)


def verhoeff(c: str) -> str:
    digit = f"CAST(substr('{VERHOEFF_P}', CAST(i % 8 AS INT) * 10 + CAST(substr(reverse({c}), CAST(i AS INT) + 1, 1) AS INT) + 1, 1) AS INT)"
    fold = f"list_reduce(list_prepend(0, list_transform(range(12), lambda i: {digit})), lambda a, p: CAST(substr('{VERHOEFF_D}', a * 10 + p + 1, 1) AS INT))"
    return f"CASE WHEN NOT regexp_matches({c}, '^\\d{{{{12}}}}$') THEN 'INCONCLUSIVE' WHEN {fold} = 0 THEN 'PASS' ELSE 'FAIL' END".replace("{{", "{").replace("}}", "}")


_ID = r"regexp_replace(document_number, '[\s\-]', '', 'g')"


def year_rules(no_date: tuple, no_year: tuple) -> str:
    year = rf"TRY_CAST({extract('date_of_birth', r'\b(19\d{2}|20[0-2]\d)\b', 1)} AS INT)"
    return rule(
        "date_validity",
        (blank("date_of_birth"), *no_date),
        (f"{year} IS NULL", *no_year),
        (f"{year} > 2024", "failed", False, "critical", "BIRTH_YEAR_FUTURE"),
        default=("passed", True),
    )


def card_rules(kind: str, pattern: str, dated: str) -> str:
    number = rf"regexp_matches(regexp_replace(upper(document_number), '[\s\-]', '', 'g'), '{pattern}')"
    return document_rules(
        kind,
        dob,
        "",
        [
            rule(
                "required_fields",
                (f"{missing('document_number', 'name')} > 0", "failed", False, "critical", "REQUIRED_FIELDS_MISSING"),
                default=("passed", True),
            ),
            rule(
                "identifier_format",
                (number, "passed", True),
                (f"NOT {blank('document_number')}", "failed", False, "critical", "INVALID_IDENTIFIER"),
                default=("unknown", False),
            ),
            dated,
        ],
        _SIMPLE.format(severity("critical"), severity("warning")),
    )


CARD_RULES = (
    TYPED
    + ","
    + document_rules(
        "aadhaar",
        dob,
        rf""", {yob('date_of_birth')} AS yob, CASE WHEN regexp_matches({_ID}, '^\d+$')
          AND NOT regexp_matches(document_number, '[A-Za-z]') THEN {_ID} END AS num""",
        [
            rule(
                "required_fields",
                (f"{missing('document_number', 'name', 'date_of_birth')} > 1", "failed", False, "critical", "REQUIRED_FIELDS_MISSING"),
                (f"{missing('document_number', 'name', 'date_of_birth')} = 1", "warning", False, "warning", "REQUIRED_FIELDS_MISSING"),
                default=("passed", True),
            ),
            rule(
                "identifier_format",
                ("regexp_matches(document_number, '[A-Za-z]')", "warning", False, "warning", "AMBIGUOUS_IDENTIFIER"),
                ("length(num) = 12", "passed", True),
                default=("failed", False, "critical", "INVALID_IDENTIFIER"),
            ),
            rule(
                "identifier_checksum",
                ("num IS NULL OR length(num) <> 12", "unknown", False, None, "INCONCLUSIVE"),
                (f"{verhoeff('num')} = 'PASS'", "passed", True, None, "PASS"),
                default=("warning", False, "warning", "FAIL"),
            ),
            rule(
                "date_validity",
                ("yob IS NULL", "warning", False, "warning", "BIRTH_YEAR_MISSING"),
                ("yob < 1900", "warning", False, "warning", "BIRTH_YEAR_EARLY"),
                ("yob > 2024", "failed", False, "critical", "BIRTH_YEAR_FUTURE"),
                default=("passed", True),
            ),
        ],
        _SIMPLE.format(severity("critical"), severity("high", "warning")),
    )
    + ","
    + card_rules("pan_card", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", year_rules(("not_applicable", True), ("warning", False)))
    + ","
    + card_rules(
        "voter_id", r"\b[A-Z]{3}[0-9]{7}\b",
        year_rules(("warning", False), ("warning", False, "warning", "BIRTH_YEAR_UNREADABLE")),
    )
)


def weighted(c: str) -> str:
    term = f"greatest(instr('{ICAO_ALPHABET}', substr({c}, CAST(i AS INT) + 1, 1)) - 1, 0) * [7, 3, 1][CAST(i % 3 AS INT) + 1]"
    return f"CAST(list_sum(list_transform(range(length({c})), lambda i: {term})) % 10 AS INTEGER)"


LINES = r"""
WITH lines AS (
  SELECT *, replace(upper(trim(coalesce(mrz_line1, ''))), ' ', '<') AS l1,
    replace(upper(trim(coalesce(mrz_line2, ''))), ' ', '<') AS l2 FROM {submissions} AS s0
),
issues AS (
  SELECT verification_id, 'LINE1_LENGTH' AS code, 'critical' AS severity FROM lines WHERE l1 <> '' AND length(l1) <> 44
  UNION ALL SELECT verification_id, 'LINE2_LENGTH', 'critical' FROM lines WHERE l2 <> '' AND length(l2) <> 44
  UNION ALL SELECT verification_id, 'LINE1_MISSING', 'critical' FROM lines WHERE l1 = '' AND l2 <> ''
  UNION ALL SELECT verification_id, 'LINE2_MISSING', 'critical' FROM lines WHERE l2 = '' AND l1 <> ''
  UNION ALL SELECT verification_id, 'LINE1_CHARSET', 'critical' FROM lines WHERE l1 <> '' AND NOT regexp_matches(l1, '^[A-Z0-9<]+$')
  UNION ALL SELECT verification_id, 'LINE2_CHARSET', 'critical' FROM lines WHERE l2 <> '' AND NOT regexp_matches(l2, '^[A-Z0-9<]+$')
  UNION ALL SELECT verification_id, 'DOCUMENT_CODE', 'warning' FROM lines WHERE length(l1) >= 5 AND l1[1] <> 'P'
  UNION ALL SELECT verification_id, 'BIRTH_DATE_DIGITS', 'warning' FROM lines
    WHERE length(l2) >= 28 AND NOT regexp_matches(substr(l2, 14, 6), '^\d{6}$')
  UNION ALL SELECT verification_id, 'SEX', 'warning' FROM lines WHERE length(l2) >= 28 AND l2[21] NOT IN ('M', 'F', '<', 'X')
  UNION ALL SELECT verification_id, 'EXPIRY_DATE_DIGITS', 'warning' FROM lines
    WHERE length(l2) >= 28 AND NOT regexp_matches(substr(l2, 22, 6), '^\d{6}$')
)
"""

_WORDS = {
    "visa": r"ENTRY VISA|VISA / VISA|VISA NUMBER|TYPE OF VISA|VISA TYPE|\bV[<A-Z0-9]{30,}",
    "border_permit": r"BORDER PERMIT|ENTRY PERMIT|CROSS-BORDER|WORK PERMIT|EMPLOYMENT PERMIT|CROSSING PERMIT|BORDER CONTROL"
    r"|REGIONAL BORDER|BORDER MANAGEMENT|\bPERMIT\s*NO\b|\bBP[-0-9]{5,}\b",
    "passport": r"REPUBLIC OF INDIA|PASSEPORT|\bPASSPORT\b|\bP<[A-Z]{3}",
    "driving_license": r"DRIVING LICENCE|DRIVING LICENSE|UNION OF INDIA DRIVING|TRANSPORT DEPARTMENT|MOTOR VEHICLES|FORM 7|COV"
    r"|MCWG|\bDL\s*NO\b",
    "aadhaar": r"AADHAAR|UNIQUE IDENTIFICATION AUTHORITY OF INDIA|UIDAI|ENROLMENT NO|MERI PEHCHAN|\b\d{4}\s\d{4}\s\d{4}\b",
    "voter_id": r"ELECTION COMMISSION|ELECTORS PHOTO IDENTITY|EPIC|ELECTORAL ROLL|VOTER ID|\b[A-Z]{3}\d{7}\b",
    "pan_card": r"INCOME TAX DEPARTMENT|PERMANENT ACCOUNT NUMBER|INCOME TAX INDIA|NSDL|UTIITSL|\b[A-Z]{5}[0-9]{4}[A-Z]\b",
}
ROUTED = (
    "WITH up AS (SELECT doc_id, " + DOCUMENT_TYPE.format("declared_type") + " AS declared_type, upper(text) AS t "
    "FROM {text_routing} AS t0), routed AS (SELECT doc_id, declared_type, CASE "
    r"WHEN regexp_matches(t, '\bVISA\b') AND regexp_matches(t, 'CONSULAR') "
    "AND NOT regexp_matches(t, 'PASSPORT|DRIVING LICENCE|DRIVING LICENSE') THEN 'visa' "
    + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in _WORDS.items())
    + " END AS detected_type FROM up)"
)

_CHECKS = "SELECT verification_id, document_type, check_name, status, valid, severity, reason, overall FROM "

SQL = {
    "licence_rules": LICENCES + _CHECKS + "driving_license_long",
    "visa_rules": VISA_RULES + _CHECKS + "visa_long",
    "permit_rules": PERMIT_RULES + _CHECKS + "border_permit_long",
    "identity_card_rules": CARD_RULES + _CHECKS + "aadhaar_long UNION ALL " + _CHECKS + "pan_card_long UNION ALL "
    + _CHECKS + "voter_id_long",
    "mrz_audit": LINES + """,
every AS (
  SELECT * FROM issues
  UNION ALL SELECT verification_id, 'AUTO_CORRECTED',
    CASE WHEN len(list_filter(string_split(mrz_corrections, ','),
      lambda t: NOT ends_with(string_split(t, ':')[2], '_safe'))) > 0 THEN 'critical' ELSE 'warning' END
  FROM lines WHERE coalesce(mrz_corrections, '') <> ''
)
SELECT e.verification_id, CASE WHEN e.verification_id IN (SELECT verification_id FROM issues) THEN 'failed' ELSE 'passed' END
  AS structure_status, code, severity FROM every e""",
    "check_digit_audit": LINES + f""",
whole AS (SELECT verification_id, substr(l1, 3, 3) AS issuer, l2 FROM lines WHERE length(l1) = 44 AND length(l2) = 44),
digits AS (
  SELECT issuer, 'document_number' AS field, {weighted('substr(l2, 1, 9)')} AS c, l2[10] AS a FROM whole
  UNION ALL SELECT issuer, 'date_of_birth', {weighted('substr(l2, 14, 6)')}, l2[20] FROM whole
  UNION ALL SELECT issuer, 'expiry_date', {weighted('substr(l2, 22, 6)')}, l2[28] FROM whole
  UNION ALL SELECT issuer, 'composite', {weighted("(substr(l2, 1, 10) || substr(l2, 14, 7) || substr(l2, 22, 22))")}, l2[44] FROM whole
)
SELECT issuer, field, count(*) AS checked, count(*) FILTER (CAST(c AS VARCHAR) <> a) AS failed,
  round(count(*) FILTER (CAST(c AS VARCHAR) <> a) / count(*), 4) AS failure_rate
FROM digits GROUP BY issuer, field""",
    "verhoeff_audit": TYPED + rf"""
SELECT verification_id, CASE WHEN coalesce(document_number, '') = '' THEN '' ELSE 'XXXX XXXX ' || right({_ID}, 4) END AS number,
  CASE WHEN document_number IS NULL OR regexp_matches(document_number, '[A-Za-z]') THEN 'INCONCLUSIVE'
    ELSE {verhoeff(_ID)} END AS checksum_status FROM typed WHERE kind = 'aadhaar'""",
    "validity_window": f"""
WITH d AS (
  SELECT verification_id, {licence('issue_date')} AS issue_date, {licence('expiry_date')} AS expiry_date,
    substr(upper(trim(mrz_line2)), 14, 6) AS b, substr(upper(trim(mrz_line2)), 22, 6) AS x FROM {{submissions}} AS s0
),
e AS (
  SELECT *, CAST(issue_date AS DATE) AS i, CAST(expiry_date AS DATE) AS e,
    CASE WHEN regexp_matches(b, '^[0-9]{{6}}$') THEN TRY_CAST('20' || b[1:2] || '-' || b[3:4] || '-' || b[5:6] AS DATE) END AS b20,
    CASE WHEN regexp_matches(b, '^[0-9]{{6}}$') THEN TRY_CAST('19' || b[1:2] || '-' || b[3:4] || '-' || b[5:6] AS DATE) END AS b19,
    CASE WHEN regexp_matches(x, '^[0-9]{{6}}$') THEN TRY_CAST('20' || x[1:2] || '-' || x[3:4] || '-' || x[5:6] AS DATE) END AS x20
  FROM d
)
SELECT verification_id, issue_date, expiry_date,
  CAST(CASE WHEN TRY_CAST(b[1:2] AS INT) > 24 THEN b19 WHEN b20 <= {REF} THEN b20 WHEN b20 IS NULL THEN NULL ELSE b19 END AS VARCHAR)
    AS mrz_birth_date,
  CAST(x20 AS VARCHAR) AS mrz_expiry_date,
  CASE WHEN e < {REF} THEN 'failed' WHEN e IS NOT NULL THEN 'passed' ELSE 'unknown' END AS expiry_status,
  CASE WHEN e > i THEN round(date_diff('day', i, e) / 365.25, 2) END AS validity_years,
  CASE WHEN e <= i OR round(date_diff('day', i, e) / 365.25, 2) > 10 THEN 'warning' WHEN e > i THEN 'passed'
    ELSE 'unknown' END AS validity_status
FROM e""",
    "text_routing_matrix": ROUTED + """
SELECT declared_type, coalesce(detected_type, 'none') AS detected_type, count(*) AS row_count,
  count(*) FILTER (detected_type <> declared_type) AS mismatches FROM routed GROUP BY ALL""",
    "quality_score": """
WITH s AS (
  SELECT *, least(width, height) AS lo, greatest(width, height) AS hi FROM {quality_metrics} AS q0
),
scored AS (
  SELECT capture_id,
    CAST(CASE WHEN lo < 320 OR hi < 450 THEN greatest(10, trunc(lo / 320 * 45))
      ELSE trunc(75 + least(1.0, width * height / 400000) * 25) END AS INTEGER) AS resolution_score,
    CAST(CASE WHEN blur < 35 THEN greatest(10, trunc(blur / 35.0 * 45))
      WHEN blur < 100 THEN trunc(60 + (blur - 35.0) / 65.0 * 30)
      ELSE least(100, trunc(90 + least(10.0, (blur - 100.0) / 20))) END AS INTEGER) AS sharpness_score,
    CAST(CASE WHEN brightness < 45 THEN greatest(15, trunc(brightness / 45.0 * 40))
      WHEN brightness > 248 THEN greatest(15, trunc(50 - (brightness - 248.0) * 2))
      WHEN brightness BETWEEN 80 AND 185 THEN 95 ELSE 80 END AS INTEGER) AS brightness_score,
    CAST(CASE WHEN contrast < 22 THEN greatest(15, trunc(contrast / 22.0 * 45))
      WHEN contrast < 45 THEN trunc(65 + (contrast - 22.0) / 23.0 * 25)
      ELSE least(100, trunc(90 + least(10.0, (contrast - 45.0) / 5))) END AS INTEGER) AS contrast_score,
    CAST(CASE WHEN glare_ratio BETWEEN 0.015 AND 0.30 AND (glare_cluster OR glare_ratio > 0.035)
        THEN greatest(15, trunc(45 - glare_ratio * 300))
      WHEN glare_ratio > 0.01 AND glare_ratio <= 0.30 THEN 75 ELSE 98 END AS INTEGER) AS glare_score
  FROM s
),
total AS (
  SELECT *, CAST(greatest(0, least(100, trunc(sharpness_score * 0.30::DOUBLE + resolution_score * 0.25::DOUBLE
    + brightness_score * 0.15::DOUBLE + contrast_score * 0.15::DOUBLE + glare_score * 0.15::DOUBLE))) AS INTEGER) AS overall_score
  FROM scored
)
SELECT *, CASE WHEN sharpness_score < 48 OR resolution_score < 48 OR brightness_score < 45 OR glare_score < 45
    OR contrast_score < 45 OR overall_score < 55 THEN 'poor' WHEN overall_score < 72 THEN 'warning' ELSE 'acceptable' END AS status
FROM total""",
    "forensic_vote": """
WITH c AS (
  SELECT doc_id, count(*) FILTER (status = 'suspicious' AND severity = 'high') AS strong,
    count(*) FILTER (status = 'suspicious' AND severity = 'medium') AS weak,
    count(*) FILTER (status NOT IN ('unavailable', 'insufficient_data')) AS votes
  FROM {forensic_votes} AS f0 GROUP BY doc_id
)
SELECT *, CASE WHEN strong >= 2 THEN 'high_forensic_concern' WHEN strong = 1 OR weak >= 2 THEN 'suspicious'
  ELSE 'no_significant_anomaly' END AS overall_assessment FROM c""",
}
