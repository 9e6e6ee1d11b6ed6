"""SQL twins of the pairing, payload, face and telemetry queries."""

from __future__ import annotations

from attestry.operators.pairing import PATTERNS
from attestry.operators.standardize import VOCABULARIES
from attestry.operators.telemetry import STAGES
from attestry.plans.sql_identity import in_list

_CLEAN = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(upper(coalesce({c}, '')), '[<,.\\-_/\\s]+', ' ', 'g'), ' '), lambda x: x <> '')"


def ymd(c: str) -> str:
    """y-m-d text of a printed date without leading zeros."""
    s = f"trim({c})"
    steps = [
        (r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$", r"\1-\2-\3"), (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", r"\3-\2-\1"),
        (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]([0-4]\d)$", r"20\3-\2-\1"), (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]([5-9]\d)$", r"19\3-\2-\1"),
    ]
    whens = " ".join(f"WHEN regexp_matches({s}, '{p}') THEN regexp_replace({s}, '{p}', '{r}')" for p, r in steps)
    return f"replace(CASE {whens} END, '-0', '-')"


VIZ = rf"""
WITH z AS (
  SELECT verification_id, document_number, name, nationality, date_of_birth, gender, expiry_date,
    substr(mrz_line2, 1, 9) AS m_number, substr(mrz_line1, 6, 39) AS m_name, substr(mrz_line2, 11, 3) AS m_nat,
    substr(mrz_line2, 14, 6) AS b, substr(mrz_line2, 21, 1) AS m_sex, substr(mrz_line2, 22, 6) AS x
  FROM {{submissions}} AS s0
),
y AS (
  SELECT *,
    CASE WHEN regexp_matches(b, '^\d{{6}}$') THEN TRY_CAST('20' || b[1:2] || '-' || b[3:4] || '-' || b[5:6] AS DATE) END AS b20,
    CASE WHEN regexp_matches(b, '^\d{{6}}$') THEN TRY_CAST('19' || b[1:2] || '-' || b[3:4] || '-' || b[5:6] AS DATE) END AS b19,
    CASE WHEN regexp_matches(x, '^\d{{6}}$') THEN CAST(TRY_CAST('20' || x[1:2] || '-' || x[3:4] || '-' || x[5:6] AS DATE) AS VARCHAR) END AS m_exp
  FROM z
),
v AS (
  SELECT *, CAST(CASE WHEN TRY_CAST(b[1:2] AS INT) > 24 THEN b19 WHEN b20 <= DATE '2024-02-01' THEN b20 WHEN b20 IS NULL THEN NULL
    ELSE b19 END AS VARCHAR) AS m_dob, {words('name')} AS nv, {words('m_name')} AS nm FROM y
),
pairs AS (
  SELECT verification_id, 'document_number' AS field, {_CLEAN.format('document_number')} AS a, {_CLEAN.format('m_number')} AS b, NULL AS da, NULL AS db, 'eq' AS how FROM v
  UNION ALL SELECT verification_id, 'nationality', {_CLEAN.format('nationality')}, {_CLEAN.format('m_nat')}, NULL, NULL, 'prefix' FROM v
  UNION ALL SELECT verification_id, 'gender', {_CLEAN.format('gender')}[1:1], {_CLEAN.format('m_sex')}[1:1], NULL, NULL, 'eq' FROM v
  UNION ALL SELECT verification_id, 'date_of_birth', {_CLEAN.format('date_of_birth')}, {_CLEAN.format('m_dob')}, {ymd('date_of_birth')}, {ymd('m_dob')}, 'date' FROM v
  UNION ALL SELECT verification_id, 'expiry_date', {_CLEAN.format('expiry_date')}, {_CLEAN.format('m_exp')}, {ymd('expiry_date')}, {ymd('m_exp')}, 'date' FROM v
),
judged AS (
  SELECT verification_id, field, CASE WHEN how = 'date' AND da IS NOT NULL AND db IS NOT NULL THEN da = db WHEN a = '' OR b = '' THEN NULL
    WHEN how = 'prefix' THEN starts_with(a, b) OR starts_with(b, a) ELSE a = b END AS match FROM pairs
  UNION ALL
  SELECT verification_id, 'name', CASE WHEN len(nv) = 0 OR len(nm) = 0 THEN NULL ELSE
    (len(list_intersect(nv, nm)) > 0 AND len(list_intersect(nv, nm)) >= least(len(list_distinct(nv)), len(list_distinct(nm))))
    OR len(list_filter(nv, lambda t: NOT contains(array_to_string(list_sort(nm), ''), t))) = 0
    OR len(list_filter(nm, lambda t: NOT contains(array_to_string(list_sort(nv), ''), t))) = 0 END FROM v
)
SELECT *, CASE WHEN match THEN 'match' WHEN NOT match THEN 'mismatch' ELSE 'unknown' END AS status FROM judged"""

# layouts of the payload table, one pattern per field and layout
_JSON, _KV, _XML = "payload LIKE '{%'", "payload LIKE 'DL No%'", "payload LIKE '<%'"
_POS, _ONE = "payload LIKE 'TN%|%'", "payload LIKE 'dl: %'"
PARSED = rf"""
WITH raw AS (SELECT * REPLACE (coalesce(payload, '') AS payload) FROM {{payloads}} AS p0),
parsed AS (
  SELECT doc_id, CASE WHEN trim(payload) = '' THEN 'CORRUPTED' WHEN {_JSON} THEN 'JSON' WHEN {_XML} THEN 'XML'
      WHEN {_KV} OR {_ONE} THEN 'DELIMITED_KEY_VALUE' WHEN {_POS} THEN 'POSITIONAL_DELIMITED' ELSE 'PLAIN_TEXT' END AS payload_type,
    {_JSON} AS signed,
    CASE WHEN {_JSON} THEN regexp_extract(payload, '"dl_no": "([^"]*)"', 1) WHEN {_KV} THEN trim(regexp_extract(payload, '^DL No:([^|]*)', 1))
      WHEN {_XML} THEN regexp_extract(payload, 'lic_no="([^"]*)"', 1) WHEN {_POS} THEN string_split(payload, '|')[1]
      WHEN {_ONE} THEN substr(payload, 5) END AS license_number,
    CASE WHEN {_JSON} THEN regexp_extract(payload, '"holder_name": "([^"]*)"', 1) WHEN {_KV} THEN trim(regexp_extract(payload, 'Name:([^|]*)', 1))
      WHEN {_XML} THEN regexp_extract(payload, '<name>([^<]*)<', 1) WHEN {_POS} THEN string_split(payload, '|')[2] END AS name,
    CASE WHEN {_JSON} THEN regexp_extract(payload, '"DOB": "([^"]*)"', 1) WHEN {_KV} THEN trim(regexp_extract(payload, 'birth date:([^|]*)', 1))
      WHEN {_XML} THEN regexp_extract(payload, '<dob>([^<]*)<', 1) WHEN {_POS} THEN string_split(payload, '|')[3] END AS dob,
    CASE WHEN {_POS} THEN string_split(payload, '|')[4] END AS valid_from,
    CASE WHEN {_POS} THEN string_split(payload, '|')[5] WHEN {_KV} THEN regexp_extract(payload, 'valid-to=(.*)$', 1) END AS valid_to,
    CASE WHEN {_POS} THEN string_split(payload, '|')[6] END AS cov,
    CASE WHEN {_POS} THEN string_split(payload, '|')[7] END AS address
  FROM raw
)
"""
_LONG = " UNION ALL ".join(
    f"SELECT doc_id, payload_type, signed, '{f}' AS field, {f} AS value FROM parsed WHERE {f} IS NOT NULL"
    for f in "license_number name dob valid_from valid_to cov address".split()
)


def day(c: str) -> str:
    return (
        f"coalesce(TRY_CAST(CASE WHEN regexp_matches({c}, '^\\d{{4}}') THEN regexp_replace({c}, '[/.]', '-', 'g') END AS DATE), "
        f"TRY_CAST(regexp_replace({c}, '^(\\d{{2}})[-/.](\\d{{2}})[-/.](\\d{{4}})$', '\\3-\\2-\\1') AS DATE))"
    )


def classes(c: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_split_to_array(upper({c}), '[,;/]+'), lambda t: trim(t))))"


_EQUAL = {
    "license_number": r"regexp_replace(upper({0}), '[\s\-_/]', '', 'g') = regexp_replace(upper({1}), '[\s\-_/]', '', 'g')",
    "name": r"upper(trim(regexp_replace({0}, '\s+', ' ', 'g'))) = upper(trim(regexp_replace({1}, '\s+', ' ', 'g')))",
}


def compared(field: str) -> str:
    a, b = f"q.{field}", f"o.{field}"
    if field in _EQUAL:
        same = _EQUAL[field].format(a, b)
    elif field == "cov":
        same = f"{classes(a)} = {classes(b)}"
    else:
        same = f"{day(a)} = {day(b)}"
    return (
        f"SELECT doc_id, q.doc_id IS NOT NULL AND q.license_number IS NOT NULL AS has_qr, '{field}' AS field, "
        f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 'QR_FIELD_UNAVAILABLE' WHEN {a} IS NULL OR {b} IS NULL THEN 'QR_FIELD_MISSING' "
        f"WHEN {same} THEN 'QR_FIELD_MATCH' ELSE 'QR_FIELD_MISMATCH' END AS status "
        "FROM parsed q FULL OUTER JOIN printed o USING (doc_id)"
    )


PAIRS = """
WITH t AS (SELECT * FROM {ocr_tokens} AS t0),
near AS (
  SELECT l.doc_id, l.token_id AS label_token, l.text AS label, v.token_id AS value_token, v.text AS value, v.conf, v.y0 - l.y1 AS distance,
    row_number() OVER (PARTITION BY l.doc_id, l.token_id ORDER BY v.y0 - l.y1, v.token_id) AS rn
  FROM t l JOIN t v ON v.doc_id = l.doc_id AND NOT v.is_label AND v.y0 - l.y1 BETWEEN 1 AND 60
    AND least(l.x1, v.x1) - greatest(l.x0, v.x0) > -20
  WHERE l.is_label
),
paired AS (SELECT * EXCLUDE (rn) FROM near WHERE rn = 1)
"""

FACES = """
WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pairs AS (
  SELECT p.*, a.v AS a, b.v AS b FROM {face_pairs} AS p LEFT JOIN vectors a ON a.vec_id = document_id LEFT JOIN vectors b ON b.vec_id = live_id
),
"""


def clipped(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest(0.0, least(1.0, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))) END"


def rounded(c: str, n: int) -> str:
    return f"round(CAST({c} AS DECIMAL(20, 8)), {n})::DOUBLE"


_DECIDE = f"""
decided AS (
  SELECT *, CASE WHEN similarity IS NULL THEN 'unavailable' WHEN similarity >= t THEN 'match' WHEN similarity >= t - 0.06::DOUBLE THEN 'inconclusive'
      ELSE 'no_match' END AS status,
    {rounded('''CASE WHEN similarity >= t THEN 0.76 + least(0.23, (similarity - t) / greatest(0.60::DOUBLE - t, 0.05) * 0.23)
      WHEN similarity >= t - 0.06::DOUBLE THEN 0.50 + (similarity - (t - 0.06::DOUBLE)) / greatest(0.06::DOUBLE, 0.01) * 0.24
      WHEN similarity IS NOT NULL THEN greatest(0.05, similarity / (t - 0.06::DOUBLE) * 0.49) END''', 4)} AS confidence
  FROM measured
)
"""
_P = PATTERNS["driving_license"]
_WORDS = " + ".join(rf"CAST(regexp_matches(t, '\b{w}\b') AS INT)" for w in _P["tokens"].split())
_POSITION = "CASE stage " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STAGES)) + " END"

SQL = {
    "viz_mrz_crosscheck": VIZ,
    "payload_fields": PARSED + _LONG,
    "payload_crosscheck": PARSED + ", printed AS (SELECT * FROM {printed_fields} AS f0), every AS ("
    + " UNION ALL ".join(compared(f) for f in "license_number name dob valid_from valid_to cov".split()) + """),
per AS (
  SELECT doc_id, CASE WHEN NOT bool_or(coalesce(has_qr, false)) THEN 'NO_QR_DATA' WHEN bool_or(status = 'QR_FIELD_MISMATCH') THEN 'MISMATCH_DETECTED'
    WHEN bool_or(status = 'QR_FIELD_MISSING') THEN 'PARTIAL_MATCH' WHEN bool_or(status = 'QR_FIELD_MATCH') THEN 'ALL_MATCHED'
    ELSE 'NO_QR_DATA' END AS overall_status FROM every GROUP BY doc_id
)
SELECT e.doc_id, overall_status, field, status FROM every e JOIN per p ON p.doc_id = e.doc_id""",
    "label_value_pairs": PAIRS + "SELECT * FROM paired",
    "label_value_nearest": """
WITH t AS (
  SELECT *, x0 / page_width AS l, x1 / page_width AS r, y0 / page_height AS t, y1 / page_height AS b FROM {page_tokens} AS p0
),
pairs AS (
  SELECT a.doc_id, a.token_id AS label_token, a.text AS label, v.token_id AS value_token, v.text AS value, v.conf,
    CAST(v.l - a.r AS DOUBLE) AS dx, CAST(v.t - a.b AS DOUBLE) AS dy, abs((v.l + v.r) / 2 - (a.l + a.r) / 2) AS mx, abs((v.t + v.b) / 2 - (a.t + a.b) / 2) AS my,
    least(v.r, a.r) - greatest(v.l, a.l) AS ox, least(v.b, a.b) - greatest(v.t, a.t) AS oy
  FROM t a JOIN t v ON v.doc_id = a.doc_id AND a.is_label AND NOT v.is_label AND v.text IN ('V0', 'V2')
),
ways AS (
  SELECT *, 'LABEL_LEFT_VALUE' AS relationship, 0 AS way, dx + my * 0.5::DOUBLE AS d FROM pairs WHERE dx >= 0 AND dx <= 0.6::DOUBLE AND oy > -0.01::DOUBLE
  UNION ALL
  SELECT *, 'LABEL_ABOVE_VALUE', 1, dy + mx * 0.5::DOUBLE FROM pairs WHERE dy >= 0 AND dy <= 0.25::DOUBLE AND (ox > -0.05::DOUBLE OR mx <= 0.15::DOUBLE)
)
SELECT doc_id, label_token, label, value_token, value, conf, relationship, round(round(d, 10), 4) AS distance FROM ways
QUALIFY row_number() OVER (PARTITION BY doc_id, label_token ORDER BY d, value_token, way) = 1""",
    "field_candidates": PAIRS + """,
found AS (
  SELECT doc_id, label, count(*) AS n, count(DISTINCT value) AS d,
    first(value ORDER BY round(1 - distance / 100, 4) DESC, conf DESC, value_token) AS v,
    first(conf ORDER BY round(1 - distance / 100, 4) DESC, conf DESC, value_token) AS c
  FROM paired GROUP BY doc_id, label
),
labels AS (SELECT DISTINCT doc_id, text AS label FROM t WHERE is_label)
SELECT l.doc_id, l.label, CASE WHEN n IS NULL THEN 'MISSING' WHEN d > 1 THEN 'AMBIGUOUS' WHEN c >= 0.65 THEN 'FOUND' ELSE 'LOW_CONFIDENCE' END AS status,
  coalesce(n, 0) AS candidates, CASE WHEN d = 1 THEN v END AS value
FROM labels l LEFT JOIN found f ON f.doc_id = l.doc_id AND f.label = l.label""",
    "pattern_signals": rf"""
WITH u AS (SELECT doc_id, upper(text) AS t FROM {{text_routing}} AS t0),
s AS (
  SELECT doc_id, regexp_matches(t, '\bP<[A-Z]{{3}}|REPUBLIC OF INDIA PASSPORT') AS p,
    regexp_matches(t, 'ENTRY VISA|VISA / VISA|VISA NUMBER|TYPE OF VISA|\bV[<A-Z0-9]{{30,}}') AS v,
    CAST(regexp_matches(t, '{_P['anchor']}') AS INT) + CAST(regexp_matches(t, '{_P['identifier']}') AS INT)
      + CAST(regexp_matches(t, '{_P['statutory']}') AS INT) + CAST({_WORDS} >= 2 AS INT) AS signals FROM u
)
SELECT doc_id, CASE WHEN p THEN 'passport' WHEN v THEN 'visa' WHEN signals > 0 THEN 'driving_license' END AS document_type, signals,
  CASE WHEN p OR v THEN 'UNSUPPORTED' WHEN signals >= 2 THEN 'SUPPORTED' WHEN signals = 1 THEN 'LOW_CONFIDENCE' ELSE 'UNKNOWN' END AS decision,
  CASE WHEN p THEN 0.98 WHEN v THEN 0.96 WHEN signals >= 2 THEN least(0.97, round(0.70 + 0.07 * (signals - 1), 2)) WHEN signals = 1 THEN 0.42
    ELSE 0.0 END::DOUBLE AS confidence FROM s""",
    "face_verify": FACES + f"measured AS (SELECT *, 0.40::DOUBLE AS t, {rounded(clipped('a', 'b'), 4)} AS similarity FROM pairs)," + _DECIDE + """
SELECT document_id, live_id, similarity, t AS threshold, status, confidence FROM decided""",
    "face_verify_elevated": FACES + f"""flagged AS (
  SELECT DISTINCT case_id FROM {{evidence}} AS e0 WHERE available AND ((module IN ('M2', 'M3') AND severity IN ('CRITICAL', 'HIGH'))
    OR signal = 'forensic_high_concern')
),
reasons AS (
  SELECT case_id, string_agg(reason, '; ' ORDER BY place) AS reasons FROM (
    SELECT case_id, CASE module WHEN 'M2' THEN 'm2_validation: ' WHEN 'M3' THEN 'm3_forensics: ' ELSE module || ': ' END || signal AS reason,
      min((CASE module WHEN 'M2' THEN 0 WHEN 'M3' THEN 1 ELSE 2 END, item_seq)) AS place
    FROM {{evidence}} AS e0 WHERE available AND ((module IN ('M2', 'M3') AND severity IN ('CRITICAL', 'HIGH')) OR signal = 'forensic_high_concern')
    GROUP BY ALL
  ) GROUP BY case_id
),
measured AS (
  SELECT *, document_id IN (SELECT case_id FROM flagged) AS elevated,
    CASE WHEN document_id IN (SELECT case_id FROM flagged) THEN 0.48::DOUBLE ELSE 0.40::DOUBLE END AS t, {rounded(clipped('a', 'b'), 4)} AS similarity
  FROM pairs
),""" + _DECIDE + "SELECT document_id, live_id, elevated, coalesce(r.reasons, '') AS reasons, similarity, t AS threshold, status, confidence FROM decided LEFT JOIN reasons r ON r.case_id = document_id",
    "gallery_topk": f"""
WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
measured AS (
  SELECT q.vec_id AS query_id, g.vec_id, {rounded(clipped('q.v', 'g.v'), 4)} AS similarity
  FROM vectors q JOIN vectors g ON q.vec_id <> g.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM measured)
SELECT query_id, rank, vec_id, similarity, CASE WHEN similarity >= 0.40 THEN 'match' WHEN similarity >= 0.34 THEN 'inconclusive'
  ELSE 'no_match' END AS status FROM ranked WHERE rank <= 5""",
    "face_verify_fused": FACES + f"""
parts AS (
  SELECT *, {clipped('a', 'b')} AS w, {clipped('a[1:32]', 'b[1:32]')} AS r, {clipped('a[17:48]', 'b[17:48]')} AS c, {clipped('a[33:64]', 'b[33:64]')} AS i,
    live_ratio IS NULL OR abs(document_ratio - live_ratio) / greatest(document_ratio, live_ratio) <= 0.18 AS ok
  FROM pairs
),
mixed AS (
  SELECT *, greatest(w, 0.35::DOUBLE * r + 0.35::DOUBLE * c + 0.20::DOUBLE * i + 0.10::DOUBLE * w, CASE WHEN ok AND greatest(r, c) >= 0.36 THEN
    0.45::DOUBLE * r + 0.45::DOUBLE * c + 0.10::DOUBLE * i ELSE 0 END) AS f FROM parts
),
measured AS (
  SELECT *, 0.40::DOUBLE AS t, {rounded('w', 4)} AS g, CASE WHEN b IS NOT NULL THEN {rounded('f', 4)} END AS similarity FROM mixed
),""" + _DECIDE + """
SELECT document_id, live_id, g AS global_similarity, similarity, status, confidence, similarity > g + 0.02 AS fusion_gain FROM decided""",
    "stage_latency": """
WITH s AS (
  SELECT stage, duration_ms, row_number() OVER (PARTITION BY stage ORDER BY duration_ms) - 1 AS r, count(*) OVER (PARTITION BY stage) AS n
  FROM {stage_events} AS e0
)
SELECT stage, count(*) AS runs, round(CAST(sum(duration_ms) / count(*) AS DECIMAL(20, 8)), 2)::DOUBLE AS avg_ms,
  round(max(duration_ms) FILTER (r = CAST(floor(n * 0.5) AS BIGINT)), 2) AS p50_ms,
  round(max(duration_ms) FILTER (r = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)), 2) AS p95_ms
FROM s GROUP BY stage""",
    "stage_order": f"""
WITH s AS (
  SELECT *, {_POSITION} AS p, row_number() OVER w AS step, lag({_POSITION}) OVER w AS q FROM {{stage_events}} AS e0
  WINDOW w AS (PARTITION BY verification_id ORDER BY started_at, event_id)
)
SELECT verification_id, step, event_id, stage, status, CASE WHEN status = 'failed' THEN 'STAGE_FAILED' WHEN q IS NULL THEN 'START'
  WHEN p <= q THEN 'RESTARTED' WHEN p > q + 1 THEN 'GAP' ELSE 'ADVANCED' END AS progress FROM s""",
    "exact_dedup": """
SELECT lower(trim(source)) || ':' || sha256(text) AS content_key, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1""",
    "mask_identifiers": r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\d([ \-]?\d){11,}\b')) AS INTEGER) AS identifiers,
  regexp_replace(text, '(\d([ \-]?\d){7,})([ \-]?)(\d{4})\b', 'XXXX XXXX \4', 'g') AS masked_text FROM documents""",
    "vocabulary_violations": "WITH e AS (SELECT * FROM {foreign_evidence} AS e0)" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, {c} AS value, count(*) AS count FROM e WHERE {c} NOT IN {in_list(allowed)} GROUP BY {c}"
        for c, allowed in VOCABULARIES.items()
    ),
    "session_assembly": """
WITH e AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM {module_updates} AS m0
  WINDOW w AS (PARTITION BY verification_id ORDER BY ts)
),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY verification_id ORDER BY ts) AS session FROM e)
SELECT verification_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(max(ts) + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS expires_at,
  max_by(result, (ts, result)) FILTER (module = 'M1') AS m1, max_by(result, (ts, result)) FILTER (module = 'M2') AS m2,
  max_by(result, (ts, result)) FILTER (module = 'M3') AS m3, max_by(result, (ts, result)) FILTER (module = 'M4') AS m4,
  max_by(result, (ts, result)) FILTER (module = 'M5') AS m5, count(*) AS updates
FROM s GROUP BY verification_id, session""",
    "registry_dedup": """
SELECT document_type, query_hash, provider, strftime(time_bucket(INTERVAL 300 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS period,
  min_by(event_id, (ts, event_id)) AS event_id, min_by(outcome, (ts, event_id)) AS outcome, count(*) AS served
FROM {lookups} AS l0 WHERE outcome NOT IN ('UNAVAILABLE', 'TIMEOUT', 'PROVIDER_ERROR', 'RATE_LIMITED', 'ERROR') GROUP BY document_type, query_hash, provider, time_bucket(INTERVAL 300 SECOND, ts)""",
}
