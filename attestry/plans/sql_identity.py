"""SQL twins of standardisation, registry and cross-document queries."""

from __future__ import annotations

from attestry import dims
from attestry.operators.standardize import STATUS_FIELDS


def pairs(mapping: dict) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in mapping.items())


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def squeeze(c: str) -> str:
    return rf"regexp_replace({strip(c)}, '\s+', ' ', 'g')"


def calendar(y: str, m: str, d: str) -> str:
    day = f"lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"
    return f"strftime(TRY_CAST({day} AS DATE), '%Y-%m-%d')"


MONTH = "CASE lower(substr({0}, 1, 3)) " + " ".join(
    f"WHEN '{m}' THEN '{i + 1:02d}'" for i, m in enumerate(dims.MONTHS)
) + " END"


def lenient(c: str) -> str:
    s = f"replace({strip(c)}, ' ', '')"
    ymd = r"^(\d{4})[/\-.]?(\d{2})[/\-.]?(\d{2})$"
    dmy = r"^(\d{2})[/\-.](\d{2})[/\-.](\d{4})$"
    yy = r"^\d{6}$"
    iso = f"""CASE
      WHEN regexp_matches({s}, '{ymd}') THEN regexp_replace({s}, '{ymd}', '\\1-\\2-\\3')
      WHEN regexp_matches({s}, '{dmy}') THEN regexp_replace({s}, '{dmy}', '\\3-\\2-\\1')
      WHEN regexp_matches({s}, '{yy}') THEN CASE WHEN CAST(substr({s}, 1, 2) AS INT) >= 30 THEN '19' ELSE '20' END
        || substr({s}, 1, 2) || '-' || substr({s}, 3, 2) || '-' || substr({s}, 5, 2) END"""
    return f"""(SELECT CASE WHEN CAST(substr(iso, 1, 4) AS INT) BETWEEN 1900 AND 2100
      AND CAST(substr(iso, 6, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr(iso, 9, 2) AS INT) BETWEEN 1 AND 31
      THEN iso END FROM (SELECT {iso} AS iso))"""


def extract(c: str, p: str, g: int) -> str:
    return f"regexp_extract({c}, '{p}', {g})"


def licence(c: str) -> str:
    s = strip(c)
    ymd, dmy = r"^(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})$", r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})$"
    named = r"^(\d{1,2})[-/. ]([A-Za-z]{3,9})[-/. ](\d{4})$"
    return f"""CASE WHEN regexp_matches({s}, '{ymd}') THEN {calendar(*[extract(s, ymd, g) for g in (1, 2, 3)])}
      WHEN regexp_matches({s}, '{named}') THEN
        {calendar(extract(s, named, 3), MONTH.format(extract(s, named, 2)), extract(s, named, 1))}
      WHEN regexp_matches({s}, '{dmy}') THEN {calendar(*[extract(s, dmy, g) for g in (3, 2, 1)])} END"""


def visa(c: str) -> str:
    s = rf"regexp_replace({strip(f'''regexp_replace({c}, '[,/]', ' ', 'g')''')}, '\s+', ' ', 'g')"
    ymd, dmy = r"^(\d{4})[-\s](\d{1,2})[-\s](\d{1,2})$", r"(\d{1,2})[.\-\s/](\d{1,2})[.\-\s/](\d{4})"
    return f"""CASE WHEN regexp_matches({s}, '{ymd}') THEN {calendar(*[extract(s, ymd, g) for g in (1, 2, 3)])}
      WHEN regexp_matches({c}, '{dmy}') THEN {calendar(*[extract(c, dmy, g) for g in (3, 2, 1)])} END"""


def permit(c: str) -> str:
    s = strip(c)
    ymd, dmy = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    return f"""CASE WHEN regexp_matches({s}, '{ymd}') THEN {calendar(*[extract(s, ymd, g) for g in (1, 2, 3)])}
      WHEN regexp_matches({s}, '{dmy}') THEN {calendar(*[extract(s, dmy, g) for g in (3, 2, 1)])} END"""


def dob(c: str) -> str:
    s = strip(c)
    dmy, ymd = r"(\d{2})[/.-](\d{2})[/.-](\d{4})", r"(\d{4})[/.-](\d{2})[/.-](\d{2})"
    return f"""coalesce(
      CASE WHEN regexp_matches({s}, '{dmy}') THEN {calendar(*[extract(s, dmy, g) for g in (3, 2, 1)])} END,
      CASE WHEN regexp_matches({s}, '{ymd}') THEN {calendar(*[extract(s, ymd, g) for g in (1, 2, 3)])} END)"""


def yob(c: str) -> str:
    return rf"TRY_CAST(coalesce(substr({dob(c)}, 1, 4), regexp_extract({strip(c)}, '\b(19\d\d|20[0-2]\d)\b', 1)) AS INT)"


def typed_date(c: str) -> str:
    return f"""CASE kind WHEN 'driving_license' THEN {licence(c)} WHEN 'visa' THEN {visa(c)}
      WHEN 'border_permit' THEN {permit(c)} ELSE {lenient(c)} END"""


def person(c: str) -> str:
    return rf"nullif(trim(regexp_replace(replace(upper({c}), '<', ' '), '\s+', ' ', 'g')), '')"


def tokens(c: str) -> str:
    return f"list_sort(list_distinct(string_split({person(c)}, ' ')))"


def nat(c: str) -> str:
    return f"nullif(replace(upper({strip(c)}), '<', ''), '')"


DOCUMENT_TYPE = (
    f"(SELECT coalesce(max(canon), lower(trim({{0}}))) FROM (VALUES {pairs(dims.TYPE_ALIASES)}) a(alias, canon) "
    "WHERE a.alias = lower(trim({0})))"
)

_BLOOD = "upper(trim(blood_group))"
for _pattern, _sign in (
    (r"\bPOSITIVE\b", "+"), (r"\bNEGATIVE\b", "-"), (r"\bPOS\.?\b", "+"), (r"\bNEG\.?\b", "-"),
    (r"\+\s*VE\b", "+"), (r"-\s*VE\b", "-"), (r"\s+", ""),
):
    _BLOOD = f"regexp_replace({_BLOOD}, '{_pattern}', '{_sign}', 'g')"

_CLASS_KEYS = in_list(dims.VEHICLE_CLASSES)
_STATUSES = ",\n  ".join(
    rf"""CASE WHEN raw_{f} IS NULL OR regexp_matches(raw_{f}, '^\s*$') THEN 'UNKNOWN' WHEN {f} IS NULL THEN 'INVALID'
      WHEN {f} = raw_{f} THEN 'UNCHANGED' ELSE 'NORMALIZED' END AS {f}_status"""
    for f in STATUS_FIELDS
)

# canonical rows; vehicle classes are tokenised relationally
STANDARD = rf"""
WITH raw AS (SELECT *, {DOCUMENT_TYPE.format('document_type')} AS kind FROM {{submissions}} AS s0),
parts AS (
  SELECT verification_id, unnest(range(1, len(p) + 1)) AS pn, unnest(p) AS part
  FROM (SELECT verification_id, regexp_split_to_array(trim(vehicle_classes), '[,;\n\r]+') AS p FROM raw) q
),
phrases AS (
  SELECT *, regexp_replace(regexp_replace(upper(trim(part)), '\s+', ' ', 'g'), '^[ :.\-]+|[ :.\-]+$', '', 'g') AS phrase
  FROM parts
),
toks AS (
  SELECT verification_id, pn, 0 AS tn, phrase AS tok FROM phrases WHERE phrase IN {_CLASS_KEYS}
  UNION ALL
  SELECT verification_id, pn, tn, regexp_replace(upper(t), '^[ :.,;()\[\]]+|[ :.,;()\[\]]+$', '', 'g')
  FROM (SELECT verification_id, pn, unnest(range(1, len(ts) + 1)) AS tn, unnest(ts) AS t
        FROM (SELECT *, regexp_split_to_array(trim(part), '\s+') AS ts FROM phrases
              WHERE phrase NOT IN {_CLASS_KEYS}) x) y
),
canon(spelling, class) AS (VALUES {pairs(dims.VEHICLE_CLASSES)}),
classes AS (
  SELECT verification_id, string_agg(DISTINCT class, ',' ORDER BY class) FILTER (class IS NOT NULL) AS known,
    string_agg(tok, ',' ORDER BY pn, tn) FILTER (class IS NULL AND regexp_matches(tok, '^[A-Z0-9\-/]{{2,10}}$')) AS unknown
  FROM toks LEFT JOIN canon ON tok = spelling
  WHERE tok <> '' AND tok NOT IN {in_list(dims.VEHICLE_STOPWORDS)} GROUP BY verification_id
),
staged AS (
  SELECT verification_id, case_id, kind, document_number AS raw_document_number, name AS raw_name,
    date_of_birth AS raw_date_of_birth, nationality AS raw_nationality, expiry_date AS raw_expiry_date,
    issue_date AS raw_issue_date, blood_group AS raw_blood_group,
    CASE kind
      WHEN 'driving_license' THEN CASE WHEN NOT regexp_matches(trim(document_number), '[^A-Za-z0-9\s\-_/.]')
        THEN nullif(upper(regexp_replace(document_number, '[\s\-_/.]', '', 'g')), '') END
      WHEN 'border_permit' THEN nullif(regexp_replace(upper(document_number), '[\s\-_/]', '', 'g'), '')
      WHEN 'aadhaar' THEN CASE WHEN regexp_matches(regexp_replace(document_number, '[\s\-]', '', 'g'), '^\d+$')
        THEN regexp_replace(document_number, '[\s\-]', '', 'g') END
      WHEN 'pan_card' THEN nullif(regexp_extract(regexp_replace(upper(document_number), '[\s\-]', '', 'g'),
        '\b([A-Z]{{5}}[0-9]{{4}}[A-Z])\b', 1), '')
      WHEN 'voter_id' THEN nullif(regexp_extract(regexp_replace(upper(document_number), '[\s\-]', '', 'g'),
        '\b([A-Z]{{3}}[0-9]{{7}})\b', 1), '')
      WHEN 'visa' THEN nullif(regexp_replace(upper(document_number), '[^A-Z0-9]', '', 'g'), '')
      ELSE nullif(upper(regexp_replace(document_number, '\s+', '', 'g')), '') END AS document_number,
    CASE kind WHEN 'border_permit' THEN nullif(upper(trim(regexp_replace({squeeze('name')},
        '^(?:HOLDER\s*NAME|NAME|HOLDER)\s*[:.-]?\s*', '', 'i'))), '')
      WHEN 'visa' THEN nullif(upper({squeeze(r"regexp_replace(name, '[^\w\s\-.,/]', ' ', 'g')")}), '')
      ELSE {person('name')} END AS name,
    CASE kind WHEN 'aadhaar' THEN {dob('date_of_birth')} ELSE {typed_date('date_of_birth')} END AS date_of_birth,
    {nat('nationality')} AS nationality,
    {typed_date('expiry_date')} AS expiry_date,
    {typed_date('issue_date')} AS issue_date,
    CASE WHEN NOT (regexp_matches(upper(blood_group), '\b(OR|AND|/)\b') AND regexp_matches(upper(blood_group), '\+|-|POS|NEG'))
      AND {_BLOOD} IN {in_list(dims.BLOOD_GROUPS)} THEN {_BLOOD} END AS blood_group,
    CASE WHEN coalesce(document_number, '') = '' THEN ''
      ELSE 'XXXX XXXX ' || right(regexp_replace(document_number, '[\s\-]', '', 'g'), 4) END AS document_number_masked,
    {yob('date_of_birth')} AS year_of_birth,
    upper({squeeze('issuing_authority')}) AS issuing_authority,
    CASE lower(gender) WHEN 'm' THEN 'MALE' WHEN 'female' THEN 'FEMALE' WHEN 'mahila' THEN 'FEMALE'
      WHEN 'sex: male' THEN 'MALE' END AS gender,
    upper(trim(state)) AS state, address AS raw_address, permit_type AS raw_permit, entries AS raw_entries,
    nullif(regexp_replace(upper(passport_number), '[^A-Z0-9]', '', 'g'), '') AS passport_number
  FROM raw
),
standard AS (
SELECT s.verification_id, case_id, kind AS document_type, document_number, name, date_of_birth, nationality, expiry_date,
  issue_date, blood_group,
  {_STATUSES},
  document_number_masked, year_of_birth, issuing_authority, gender, n.state_name,
  CASE WHEN state IN {in_list(dims.LEGACY_STATES)} THEN 'LEGACY' WHEN n.state_name IS NOT NULL THEN 'CURRENT'
    ELSE 'UNKNOWN' END AS state_status,
  coalesce(known, '') AS vehicle_classes, coalesce(unknown, '') AS unknown_vehicle_classes,
  nullif(regexp_replace(regexp_replace(regexp_replace(trim(raw_address),
    '^(ADDRESS|ADDR|PATTA|C/O|S/O|D/O|W/O)\s*[:\-,\s]*', '', 'i'), '\s+', ' ', 'g'), '^[ ,.\-]+|[ ,.\-]+$', '', 'g'), '')
    AS address,
  coalesce(p.permit_type, upper(trim(raw_permit))) AS permit_type,
  CASE WHEN upper(raw_entries) LIKE '%MULT%' OR upper(raw_entries) = 'M' THEN 'MULTIPLE'
    WHEN upper(raw_entries) LIKE '%SING%' OR upper(raw_entries) IN ('S', '1') THEN 'SINGLE'
    WHEN raw_entries = '2' OR upper(raw_entries) LIKE '%DOUB%' THEN 'DOUBLE' ELSE upper(raw_entries) END AS entries,
  passport_number,
  coalesce(CASE kind
    WHEN 'border_permit' THEN
      (regexp_matches(upper(raw_document_number), 'BP[- ]?(20\d{{2}}|19\d{{2}})[- ]?[0-9OIL]{{6}}')
        AND regexp_matches(right(upper(trim(raw_document_number)), 6), '[OIBD]'))
      OR CASE WHEN regexp_matches(document_number, '^BP\d{{6,12}}$') THEN false
              WHEN document_number LIKE 'BP%' AND length(document_number) >= 8
                THEN NOT regexp_matches(document_number, '^BP\d+$')
              ELSE NOT regexp_matches(document_number, '^[A-Z0-9]+$') END
    WHEN 'aadhaar' THEN regexp_matches(raw_document_number, '[A-Za-z]') ELSE false END, false) AS number_ambiguous,
  CASE WHEN kind <> 'aadhaar' THEN NULL WHEN raw_document_number IS NULL THEN 'EMPTY_IDENTIFIER'
    WHEN regexp_matches(raw_document_number, '[A-Za-z]') THEN 'AMBIGUOUS_IDENTIFIER'
    WHEN document_number IS NULL THEN 'NON_NUMERIC_IDENTIFIER' WHEN length(document_number) <> 12 THEN 'INVALID_LENGTH'
    WHEN document_number[1] IN ('0', '1') THEN 'INVALID_FIRST_DIGIT' END AS national_id_error,
  CASE WHEN kind = 'pan_card' AND document_number IS NOT NULL THEN coalesce(g.label, 'Unknown') END AS holder_category
FROM staged s LEFT JOIN classes c ON c.verification_id = s.verification_id
LEFT JOIN (VALUES {pairs(dims.STATE_NAMES)}) n(code, state_name) ON n.code = s.state
LEFT JOIN (VALUES {pairs(dims.PERMIT_TYPES)}) p(wording, permit_type) ON p.wording = lower(trim(raw_permit))
LEFT JOIN (VALUES {pairs(dims.PAN_CATEGORIES)}) g(code, label) ON g.code = document_number[4]
)
"""


def same_state(a: str, b: str) -> str:
    """Codes of one state name, or a pair of codes that stand for each other."""
    both = ", ".join(f"('{x}', '{y}'), ('{y}', '{x}')" for x, y in (p.split("=") for p in dims.STATE_PAIRS))
    name = "coalesce((SELECT max(nm) FROM (VALUES {0}) t(cd, nm) WHERE cd = upper(trim({1}))), upper(trim({1})))"
    names = pairs({k: v.upper() for k, v in dims.STATE_NAMES.items()})
    return (
        f"({name.format(names, a)} = {name.format(names, b)} "
        f"OR (upper(trim({a})), upper(trim({b}))) IN ({both}))"
    )


_SPELLINGS = {k.translate(str.maketrans("", "", " .-_")): v for k, v in reversed(dims.VEHICLE_CLASSES.items())}


def class_set(c: str) -> str:
    token = r"regexp_replace(upper(t), '[\s.\-_]+', '', 'g')"
    return f"""list_sort(list_distinct(list_transform(
      list_filter(list_transform(regexp_split_to_array({c}, '[,;/\\n]+'), lambda t: {token}), lambda t: t <> ''),
      lambda t: coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in _SPELLINGS.items())}}}[t], t))))"""


_POLICY = ", ".join(
    f"('{kind}', '{field}', {flag})"
    for flag, policy in (("true", dims.CRITICAL_FIELDS), ("false", dims.SECONDARY_FIELDS))
    for kind, fields in policy.items()
    for field in fields.split()
)
_HALVES = ", ".join(f"('{k}', {len(f.split()) // 2})" for k, f in dims.CRITICAL_FIELDS.items())


def letters(c: str) -> str:
    return f"array_to_string(list_sort(string_split(array_to_string({tokens(c)}, ''), '')), '')"


def equal_names(a: str, b: str) -> str:
    return f"({tokens(a)} = {tokens(b)} OR {letters(a)} = {letters(b)})"


LOOKUP = rf"""
WITH subs AS (
  SELECT *, {DOCUMENT_TYPE.format('document_type')} AS kind,
    regexp_replace(upper(document_number), '[\s\-_/.]+', '', 'g') AS clean
  FROM {{submissions}} AS s0
),
records AS (
  SELECT *, NULL AS watchlist_reason, 'official' AS origin, 1 AS source_rank FROM {{registry}} AS r0
  UNION ALL SELECT *, 'watchlist', 0 FROM {{watchlist}} AS w0
),
probes AS (
  SELECT verification_id, kind, clean AS key, 0 AS cand, 0 AS step FROM subs
  UNION ALL SELECT verification_id, kind, substr(clean, 1, 8), 1, 1 FROM subs WHERE kind = 'passport' AND length(clean) = 9
  UNION ALL SELECT verification_id, kind, clean || d, 1, d + 1 FROM subs, range(10) t(d)
    WHERE kind = 'passport' AND length(clean) = 8
),
hits AS (
  SELECT p.*, r.* EXCLUDE (document_type),
    count(*) OVER (PARTITION BY verification_id, cand, source_rank) AS n,
    row_number() OVER (PARTITION BY verification_id ORDER BY source_rank, cand, step, record_id) AS rn
  FROM probes p JOIN records r ON r.document_type = p.kind
    AND regexp_replace(upper(r.document_number), '[\s\-_/.]+', '', 'g') = p.key
),
best AS (SELECT * FROM hits WHERE rn = 1),
matched AS (
  SELECT s.verification_id, s.kind, s.document_number AS d_document_number, b.document_number AS r_document_number,
    s.name AS d_name, b.name AS r_name, s.date_of_birth AS d_date_of_birth, b.date_of_birth AS r_date_of_birth,
    s.nationality AS d_nationality, b.nationality AS r_nationality, s.expiry_date AS d_expiry_date,
    b.expiry_date AS r_expiry_date, s.issuing_authority AS d_authority, b.issuing_authority AS r_authority,
    s.state AS d_state, b.state AS r_state, s.vehicle_classes AS d_classes, b.vehicle_classes AS r_classes,
    s.blood_group AS d_blood, b.blood_group AS r_blood, s.issue_date AS d_valid, CAST(NULL AS VARCHAR) AS r_valid,
    b.registry_document_status, b.origin, b.record_id
  FROM subs s JOIN best b ON b.verification_id = s.verification_id
),
sets AS (SELECT *, {class_set('d_classes')} AS ds, {class_set('r_classes')} AS rs FROM matched),
long AS (
  SELECT verification_id, kind, registry_document_status, origin, 'document_number' AS field, d_document_number AS d,
    r_document_number AS r, 'normalized_identifier' AS method,
    upper(regexp_replace(d_document_number, '\s+', '', 'g')) AS dv,
    upper(regexp_replace(r_document_number, '\s+', '', 'g')) AS rv,
    CASE WHEN CASE WHEN kind = 'driving_license'
        THEN upper(regexp_replace(d_document_number, '[\s\-_/.]+', '', 'g')) = upper(regexp_replace(r_document_number, '[\s\-_/.]+', '', 'g'))
        ELSE dv = rv END THEN 'MATCH' ELSE 'MISMATCH' END AS st
  FROM sets
  UNION ALL SELECT verification_id, kind, registry_document_status, origin, 'date_of_birth', d_date_of_birth, r_date_of_birth,
    'iso_date_equality', coalesce({lenient('d_date_of_birth')}, upper(d_date_of_birth)) AS dv,
    coalesce({lenient('r_date_of_birth')}, upper(r_date_of_birth)) AS rv,
    CASE WHEN {lenient('d_date_of_birth')} = {lenient('r_date_of_birth')} THEN 'MATCH' ELSE 'MISMATCH' END FROM sets
  UNION ALL SELECT verification_id, kind, registry_document_status, origin, 'expiry_date', d_expiry_date, r_expiry_date,
    'iso_date_equality', coalesce({lenient('d_expiry_date')}, upper(d_expiry_date)),
    coalesce({lenient('r_expiry_date')}, upper(r_expiry_date)),
    CASE WHEN {lenient('d_expiry_date')} = {lenient('r_expiry_date')} THEN 'MATCH' ELSE 'MISMATCH' END FROM sets
  UNION ALL SELECT verification_id, kind, registry_document_status, origin, 'valid_from', d_valid, r_valid,
    'iso_date_equality', coalesce({lenient('d_valid')}, upper(d_valid)), NULL, 'MISMATCH' FROM sets
  UNION ALL SELECT verification_id, kind, registry_document_status, origin, 'name', d_name, r_name,
    'token_normalized', {person('d_name')}, {person('r_name')},
    CASE WHEN {equal_names('d_name', 'r_name')} THEN 'MATCH' ELSE 'MISMATCH' END FROM sets
  UNION ALL SELECT verification_id, kind, registry_document_status, origin, 'nationality', d_nationality, r_nationality,
    'iso_alpha3_equality', {nat('d_nationality')}, {nat('r_nationality')},
    CASE WHEN {nat('d_nationality')} = {nat('r_nationality')} THEN 'MATCH' ELSE 'MISMATCH' END FROM sets
  UNION ALL SELECT verification_id, kind, registry_document_status, origin, 'vehicle_classes', d_classes, r_classes,
    'cov_taxonomy', upper(trim(d_classes)), upper(trim(r_classes)),
    CASE WHEN ds = rs THEN 'MATCH' WHEN len(list_intersect(ds, rs)) = 0 THEN 'MISMATCH' ELSE 'PARTIAL_MATCH' END FROM sets
  UNION ALL SELECT verification_id, kind, registry_document_status, origin, 'state', d_state, r_state,
    'state_code_registry', upper(trim(d_state)), upper(trim(r_state)),
    CASE WHEN {same_state('d_state', 'r_state')} THEN 'MATCH' ELSE 'MISMATCH' END FROM sets
  UNION ALL SELECT verification_id, kind, registry_document_status, origin, 'issuing_authority', d_authority, r_authority,
    'case_insensitive', upper({squeeze('d_authority')}), upper({squeeze('r_authority')}),
    CASE WHEN upper(trim(d_authority)) = upper(trim(r_authority)) THEN 'MATCH' ELSE 'MISMATCH' END FROM sets
  UNION ALL SELECT verification_id, kind, registry_document_status, origin, 'blood_group', d_blood, r_blood,
    'case_insensitive', upper(trim(d_blood)), upper(trim(r_blood)),
    CASE WHEN upper(trim(d_blood)) = upper(trim(r_blood)) THEN 'MATCH' ELSE 'MISMATCH' END FROM sets
),
policy(kind, field, is_critical) AS (VALUES {_POLICY}),
halves(kind, half) AS (VALUES {_HALVES}),
fields AS (
  SELECT verification_id, l.kind AS document_type, l.field, is_critical, registry_document_status, origin,
    CASE WHEN d IS NULL OR r IS NULL THEN 'none' ELSE method END AS comparison_method,
    dv AS document_value, rv AS registry_value,
    CASE WHEN d IS NULL AND r IS NULL THEN 'NOT_COMPARED' WHEN d IS NULL THEN 'MISSING_IN_DOCUMENT'
      WHEN r IS NULL THEN 'MISSING_IN_REGISTRY' ELSE st END AS status
  FROM long l JOIN policy p ON p.kind = l.kind AND p.field = l.field
),
decided AS (
  SELECT f.verification_id, document_type, origin,
    CASE WHEN origin = 'watchlist' AND registry_document_status <> 'SUSPENDED' THEN 'REVOKED'
      WHEN registry_document_status IN ('REVOKED', 'SUSPENDED', 'INVALID', 'EXPIRED') THEN registry_document_status
      WHEN count(*) FILTER (is_critical AND status = 'MISMATCH') > 0 THEN 'MISMATCH'
      WHEN count(*) FILTER (is_critical AND status <> 'NOT_COMPARED') = 0 THEN 'INCONCLUSIVE'
      WHEN count(*) FILTER (is_critical AND status LIKE 'MISSING%') >= max(half) THEN 'INCONCLUSIVE'
      WHEN count(*) FILTER (is_critical AND status = 'MATCH') = count(*) FILTER (is_critical AND status <> 'NOT_COMPARED')
        THEN 'MATCHED' ELSE 'INCONCLUSIVE' END AS registry_status
  FROM fields f JOIN halves h ON h.kind = f.document_type
  GROUP BY f.verification_id, document_type, origin, registry_document_status
),
outcomes AS (
  SELECT s.verification_id, s.kind AS document_type, coalesce(registry_status, 'NOT_FOUND') AS registry_status, origin
  FROM subs s LEFT JOIN decided d ON d.verification_id = s.verification_id
)
"""

def _hmac(kind: str) -> str:
    """HMAC-SHA256 from two plain hashes over bytes; the key is the secret and the type, shorter than a block."""
    key = (b"sample lookup secret" + kind.encode()).ljust(64, b"\0")
    inner, outer = (bytes(b ^ mask for b in key).hex() for mask in (0x36, 0x5C))
    number = "hex(encode(regexp_replace(upper(document_number), '[\\s\\-_/.]', '', 'g')))"
    return f"WHEN '{kind}' THEN sha256(unhex('{outer}' || sha256(unhex('{inner}' || {number}))))"


_HMAC = " ".join(_hmac(k) for k in ["passport", "visa", "driving_license", "pan_card", "border_permit", "aadhaar", "voter_id"])

SQL = {
    "standardize": STANDARD + "SELECT * FROM standard",
    "standardization_profile": STANDARD
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT document_type, '{f}' AS field, {f}_status AS status FROM standard" for f in STATUS_FIELDS
    )
    + """),
counted AS (SELECT document_type, field, status, count(*) AS row_count FROM long GROUP BY ALL)
SELECT *, round(row_count / sum(row_count) OVER (PARTITION BY document_type, field), 4) AS share FROM counted""",
    "identity_collisions": STANDARD
    + f""",
keyed AS (SELECT *, array_to_string({tokens('name')}, ' ') AS person_key FROM standard)
SELECT * REPLACE (sha256('sample lookup secret|' || collision_key) AS collision_key) FROM (
SELECT 'NUMBER' AS kind, document_type || ':' || document_number AS collision_key,
  count(DISTINCT person_key) AS names, count(DISTINCT date_of_birth) AS birth_dates, CAST(1 AS BIGINT) AS numbers
FROM keyed WHERE document_number IS NOT NULL GROUP BY ALL HAVING names > 1 OR birth_dates > 1
UNION ALL
SELECT 'PERSON', document_type || ':' || person_key || ':' || date_of_birth, 1, 1, count(DISTINCT document_number) AS c
FROM keyed WHERE document_number IS NOT NULL AND person_key <> '' AND date_of_birth IS NOT NULL
GROUP BY ALL HAVING c > 1) AS k""",
    "registry_lookup": LOOKUP + """
SELECT verification_id, kind AS document_type, origin, CAST(record_id AS BIGINT) AS record_id, cand AS candidate,
  registry_document_status, watchlist_reason FROM best""",
    "registry_not_found": LOOKUP + r"""
SELECT verification_id, kind AS document_type, CASE WHEN coalesce(document_number, '') = '' THEN ''
  ELSE 'XXXX XXXX ' || right(regexp_replace(document_number, '[\s\-]', '', 'g'), 4) END AS number
FROM subs WHERE verification_id NOT IN (SELECT verification_id FROM best)""",
    "registry_ambiguous": LOOKUP + """
SELECT verification_id, kind AS document_type, origin, n AS match_count FROM best WHERE n > 1""",
    "field_comparison": LOOKUP + """
SELECT verification_id, document_type, field, is_critical, comparison_method, sha256('sample lookup secret|' || document_value) AS document_hash,
  sha256('sample lookup secret|' || registry_value) AS registry_hash, status
FROM fields""",
    "protected_registry": f"""
SELECT record_id, document_type, CASE document_type {_HMAC} END AS blind_index,
  CASE WHEN coalesce(document_number, '') = '' THEN '' ELSE 'XXXX XXXX ' || right(regexp_replace(document_number, '[\\s\\-]', '', 'g'), 4) END AS number,
  name IS NOT NULL AS has_name, date_of_birth IS NOT NULL AS has_date_of_birth
FROM {{registry}} AS r0""",
    "registry_outcome": LOOKUP + "SELECT * FROM outcomes",
}
