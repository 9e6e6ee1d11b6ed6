"""SQL twins of the permit and card payload queries."""

from __future__ import annotations

from attestry.plans.sql_identity import permit, strip


def _after(*marks: str, source: str = "payload") -> str:
    """Text behind the first of ``marks`` up to a quote or separator; NULL when empty."""
    return f"""nullif(trim(regexp_extract({source}, '(?:{"|".join(marks)})([^"|;]*)', 1)), '')"""


def _permit_number(c: str) -> str:
    return rf"nullif(regexp_replace(upper({c}), '[\s\-_/]', '', 'g'), '')"


def _card_number(c: str) -> str:
    bare = rf"regexp_replace({c}, '[\s\-]', '', 'g')"
    return rf"CASE WHEN regexp_matches({bare}, '^\d+$') THEN {bare} END"


def _holder(c: str) -> str:
    label = r"^(?:HOLDER\s*NAME|NAME|HOLDER)\s*[:.-]?\s*"
    return rf"nullif(trim(regexp_replace(upper({strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")}), '{label}', '')), '')"


# a permit's delimited text holds at least one key with something behind its mark
_PAIRED = r"(?i)[A-Z_]\s*[:=]\s*[^|;\n\r]"

_CARDS = rf"""
WITH raw AS (
  SELECT *, CASE document_type WHEN 'borderPermit' THEN 'border_permit' ELSE 'aadhaar' END AS kind, coalesce(trim(payload), '') AS p FROM {{card_documents}} AS d0
),
cut AS (
  SELECT *, CASE WHEN p IN ('', 'scan me') THEN NULL WHEN p LIKE '{{%' THEN 'JSON' WHEN p LIKE '<%' OR p LIKE 'uid=%' THEN 'XML'
      WHEN kind = 'border_permit' AND NOT regexp_matches(p, '{_PAIRED}') THEN NULL ELSE 'DELIMITED' END AS layout,
    {_after('"permitNo": "', '"docNumber": "', '"uid": "', 'permit_number="', ' uid="', '^BP=', '^permit: ', '^UID:', '^ID:', source='p')} AS n,
    {_after('"holder_name": "', '"name": "', ' name="', 'NAME=', 'holder: ', 'NAME:', source='p')} AS h,
    {_after('"passportNo": "', 'PPT=', source='p')} AS pp, {_after('"validTo": "', source='p')} AS till, {_after(' dob="', source='p')} AS born,
    upper({_after('"gender": "', ' gender="', 'GENDER:', source='p')}) AS g
  FROM raw
),
parsed AS (
  SELECT verification_id, kind AS document_type, layout, payload, document_number, name, passport_number,
    CASE WHEN layout IS NOT NULL THEN 'PAYLOAD_DECODED' WHEN p = '' THEN CASE kind WHEN 'aadhaar' THEN 'NOT_FOUND' ELSE 'absent' END
      ELSE CASE kind WHEN 'aadhaar' THEN 'PAYLOAD_MALFORMED' ELSE 'MALFORMED_PAYLOAD' END END AS payload_status,
    CASE kind WHEN 'aadhaar' THEN {_card_number('n')} ELSE {_permit_number('n')} END AS f_number,
    CASE kind WHEN 'aadhaar' THEN upper(h) ELSE {_holder('h')} END AS f_name,
    pp AS f_passport_number, CASE WHEN kind = 'border_permit' THEN {permit('till')} END AS f_valid_to, {permit('born')} AS f_date_of_birth,
    CASE WHEN p LIKE '<P%' THEN '1990' END AS f_year_of_birth, CASE WHEN p LIKE '<P%' THEN 'S/O A, 600001' END AS f_address,
    CASE WHEN g IN ('M', 'MALE') THEN 'MALE' WHEN g IN ('F', 'FEMALE') THEN 'FEMALE' ELSE g END AS f_gender,
    CASE kind WHEN 'aadhaar' THEN {_card_number('document_number')} ELSE {_permit_number('document_number')} END AS p_number,
    CASE kind WHEN 'aadhaar' THEN nullif(upper({strip('name')}), '') ELSE {_holder('name')} END AS p_name,
    nullif(upper({strip('passport_number')}), '') AS p_passport_number
  FROM cut
)"""
_FIELDS = "number name date_of_birth passport_number valid_to year_of_birth gender address".split()


def _words(c: str, pattern: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all({c}, '{pattern}')))"


_SAME_NAME = rf"""CASE document_type WHEN 'border_permit' THEN {_words('p_name', r'\S+')} = {_words('f_name', r'\S+')} OR contains(p_name, f_name) OR contains(f_name, p_name)
  ELSE list_has_all({_words('p_name', r'\w+')}, {_words('f_name', r'\w+')}) OR list_has_all({_words('f_name', r'\w+')}, {_words('p_name', r'\w+')}) END"""
_JUDGED = _CARDS + f""",
compared AS (
  SELECT verification_id, 'number' AS field, CASE WHEN p_number = f_number THEN 'MATCHED' ELSE 'MISMATCH' END AS status FROM parsed
    WHERE p_number IS NOT NULL AND f_number IS NOT NULL
  UNION ALL SELECT verification_id, 'name', CASE WHEN {_SAME_NAME} THEN 'MATCHED' ELSE 'MISMATCH' END FROM parsed WHERE p_name IS NOT NULL AND f_name IS NOT NULL
  UNION ALL SELECT verification_id, 'passport_number', CASE WHEN p_passport_number = upper(f_passport_number) THEN 'MATCHED' ELSE 'MISMATCH' END FROM parsed
    WHERE p_passport_number IS NOT NULL AND f_passport_number IS NOT NULL
),
judged AS (
  SELECT p.verification_id, any_value(p.document_type) AS document_type, any_value(p.payload) AS payload,
    CASE WHEN any_value(layout) IS NULL THEN CASE any_value(p.document_type) WHEN 'border_permit' THEN 'NOT_AVAILABLE' ELSE 'NOT_APPLICABLE' END
      WHEN count(*) FILTER (c.status = 'MISMATCH') > 0 THEN 'MISMATCH' WHEN any_value(p.document_type) = 'border_permit' OR count(c.field) > 0 THEN 'MATCHED'
      ELSE 'INCONCLUSIVE' END AS overall
  FROM parsed p LEFT JOIN compared c USING (verification_id) GROUP BY p.verification_id
)"""

SQL = {
    "card_payload_fields": _CARDS + """,
long AS (
""" + " UNION ALL ".join(f"SELECT verification_id, '{f}' AS field, f_{f} AS value FROM parsed WHERE f_{f} IS NOT NULL" for f in _FIELDS) + """)
SELECT p.verification_id, document_type, layout, payload_status, field, value FROM parsed p LEFT JOIN long l USING (verification_id)""",
    "card_payload_crosscheck": _JUDGED + """
SELECT j.verification_id, document_type, field, status, overall FROM judged j LEFT JOIN compared c USING (verification_id)""",
    "payload_consistency": _JUDGED + """,
rated AS (
  SELECT *, CASE WHEN coalesce(payload, '') = '' THEN 'not_applicable' WHEN overall = 'MATCHED' THEN 'passed' WHEN overall = 'MISMATCH' THEN 'failed'
    WHEN document_type = 'border_permit' THEN 'warning' ELSE 'inconclusive' END AS status FROM judged
)
SELECT verification_id, document_type, 'qr_consistency' AS check_name, status, status NOT IN ('failed', 'warning') AS valid,
  CASE WHEN status = 'failed' THEN 'high' END AS severity, CASE WHEN status = 'failed' THEN 'QR_OCR_MISMATCH' END AS reason FROM rated""",
}
