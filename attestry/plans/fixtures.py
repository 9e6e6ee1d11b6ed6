"""Input tables of the engine, derived from the given TPC-H style tables.

The given data holds no identity documents, so each input table is a SELECT over whole
given tables. The texts use only SQL that Spark and DuckDB read alike; ``{name}`` stands for
a given table or another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from attestry import dims
from attestry.operators.telemetry import STAGES
from attestry.sources.tables import GIVEN_TABLES, read_table
from attestry.streaming.jobs import read_stream


def _letters(expr: str, width: int) -> str:
    return f"translate(lpad(CAST({expr} AS STRING), {width}, '0'), '0123456789', 'ABCDEFGHIJ')"


def _digits(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


def _number(k: str) -> str:
    """Document number of customer ``k``, in the canonical form of its document type."""
    states = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate("TN DL KA MH OR UA XX".split()))
    tail = _digits(f"{k} * 7919 % 10000000", 7)
    return f"""CASE {k} % 8
      WHEN 0 THEN chr(CAST(65 + {k} % 26 AS INT)) || {tail}
      WHEN 1 THEN chr(CAST(65 + {k} % 26 AS INT)) || {tail}
      WHEN 2 THEN 'V' || {_digits(f'{k} * 7919 % 100000000', 8)}
      WHEN 3 THEN CASE {k} % 7 {states} END || {_digits(f'{k} % 90 + 1', 2)}
                  || CAST(1990 + {k} % 30 AS STRING) || {tail}
      WHEN 4 THEN {_letters(f'{k} * 7919 % 1000', 3)} || substr('PCHFATBLJGZ', CAST({k} % 11 + 1 AS INT), 1)
                  || chr(CAST(65 + {k} % 26 AS INT)) || {_digits(f'{k} % 10000', 4)} || 'K'
      WHEN 5 THEN 'BP' || CAST(2015 + {k} % 12 AS STRING) || {_digits(f'{k} % 1000000', 6)}
      WHEN 6 THEN CAST(100000000000 + {k} * 7919 * 104729 % 900000000000 AS STRING)
      ELSE {_letters(f'{k} % 1000', 3)} || {_digits(f'{k} * 7919 % 10000000', 7)} END"""


def _day(k: str, start: str, step: int, span: int, shift: str = "0") -> str:
    return f"CAST(DATE '{start}' + CAST({k} * {step} % {span} + {shift} AS INT) AS STRING)"


def _weighted(chars: list[str]) -> str:
    """7-3-1 weighted sum modulo ten over character expressions (digit, letter or filler)."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = [f"{(7, 3, 1)[i % 3]} * greatest(instr('{alphabet}', {c}) - 1, 0)" for i, c in enumerate(chars)]
    return f"CAST(({' + '.join(terms)}) % 10 AS STRING)"


def _chars(column: str, start: int, stop: int) -> list[str]:
    return [f"substr({column}, {i}, 1)" for i in range(start + 1, stop + 1)]


FAMILY = _letters("{k} % 10000", 4)
GIVEN = _letters("{k} * 31 % 1000", 3) + " || 'A'"
NATION = "'N' || " + _letters("{k} % 25", 2)


def _k(template: str, key: str) -> str:
    return template.replace("{k}", key)


SUBMISSION_KEYS = f"""
SELECT o_orderkey AS o, o_custkey AS k, CAST(o_orderdate AS DATE) AS submitted_on,
  {_number('o_custkey')} AS num,
  {_k(FAMILY, 'o_custkey')} AS family, {_k(GIVEN, 'o_custkey')} AS given,
  {_day('o_custkey', '1950-01-01', 37, 20000, 'CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END')} AS dob,
  {_day('o_custkey', '2020-01-01', 53, 4000)} AS expiry,
  {_day('o_custkey', '2020-01-01', 53, 4000, 'CASE WHEN o_orderkey % 23 = 0 THEN 30 ELSE -3650 - o_custkey % 60 END')}
    AS issued,
  CASE WHEN o_orderkey % 43 = 0 THEN 'XXA' ELSE {_k(NATION, 'o_custkey')} END AS nation
FROM {{orders}}
"""

SUBMISSIONS = """
SELECT 'VER-' || CAST(o AS STRING) AS verification_id, 'CASE-' || CAST(k AS STRING) AS case_id, submitted_on,
  CASE k % 8 WHEN 0 THEN 'passport' WHEN 1 THEN ' Passport' WHEN 2 THEN 'visa' WHEN 3 THEN 'drivingLicense'
    WHEN 4 THEN 'pan' WHEN 5 THEN 'borderPermit' WHEN 6 THEN 'national_id' ELSE 'epic' END AS document_type,
  CASE WHEN o % 41 = 0 THEN NULL
       WHEN o % 29 = 0 THEN replace(num, '1', 'O')
       WHEN o % 5 = 1 THEN substr(num, 1, 4) || ' ' || substr(num, 5)
       WHEN o % 5 = 2 THEN substr(num, 1, 2) || '-' || substr(num, 3)
       WHEN o % 7 = 0 THEN lower(num)
       WHEN o % 3 = 0 AND k % 8 <= 1 THEN num || CAST(o % 10 AS STRING)
       ELSE num END AS document_number,
  CASE WHEN o % 31 = 0 THEN NULL
       WHEN o % 19 = 0 THEN given || ' Q ' || family
       WHEN o % 13 = 0 THEN given || family
       WHEN o % 5 = 0 THEN family || '<<' || given
       WHEN o % 3 = 0 THEN lower(given) || '  ' || lower(family)
       WHEN o % 47 = 0 THEN '   '
       ELSE given || ' ' || family END AS name,
  CASE WHEN o % 37 = 0 THEN NULL
       WHEN o % 53 = 0 THEN substr(dob, 1, 4)
       WHEN o % 59 = 0 THEN '31/02/' || substr(dob, 1, 4)
       WHEN o % 3 = 0 THEN dob
       WHEN o % 3 = 1 THEN substr(dob, 9, 2) || '/' || substr(dob, 6, 2) || '/' || substr(dob, 1, 4)
       ELSE substr(dob, 3, 2) || substr(dob, 6, 2) || substr(dob, 9, 2) END AS date_of_birth,
  CASE WHEN o % 6 = 0 THEN nation || '<' WHEN o % 7 = 0 THEN lower(nation) ELSE nation END AS nationality,
  CASE WHEN o % 61 = 0 THEN 'UNKNOWN'
       WHEN o % 4 = 1 THEN substr(expiry, 9, 2) || '-' || substr(expiry, 6, 2) || '-' || substr(expiry, 1, 4)
       ELSE expiry END AS expiry_date,
  CASE WHEN o % 67 = 0 THEN NULL
       WHEN o % 4 = 2 THEN substr(issued, 9, 2) || '.' || substr(issued, 6, 2) || '.' || substr(issued, 1, 4)
       ELSE issued END AS issue_date,
  'Authority  ' || CAST(k % 5 AS STRING) AS issuing_authority,
  CASE o % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'Female' WHEN 2 THEN 'MAHILA' WHEN 3 THEN 'sex: male' ELSE '?' END AS gender,
  CASE k % 7 WHEN 0 THEN 'tn' WHEN 1 THEN 'DL' WHEN 2 THEN 'KA' WHEN 3 THEN 'MH' WHEN 4 THEN 'OR' WHEN 5 THEN 'UA'
    ELSE 'XX' END AS state,
  CASE o % 8 WHEN 0 THEN 'LMV, MCWG' WHEN 1 THEN 'mc with gear; lmv-nt' WHEN 2 THEN 'COV: TRANS HGV'
    WHEN 3 THEN 'LMV ZZ99' WHEN 4 THEN NULL WHEN 5 THEN 'M/CYCL.WG,TRLR' WHEN 6 THEN 'QQ' ELSE 'LMV' END
    AS vehicle_classes,
  CASE o % 9 WHEN 0 THEN 'O+ve' WHEN 1 THEN 'B POSITIVE' WHEN 2 THEN 'AB NEGATIVE' WHEN 3 THEN 'A1B-' WHEN 4 THEN 'AB'
    WHEN 5 THEN NULL WHEN 6 THEN 'o +' WHEN 7 THEN 'B NEG' ELSE 'A+ OR B+' END AS blood_group,
  CASE o % 4 WHEN 0 THEN 'S/O: 12  Main Road, ' WHEN 1 THEN 'Address - 7 Hill St.' WHEN 2 THEN '' ELSE '5 Lake View' END
    AS address,
  CASE o % 6 WHEN 0 THEN 'entry permit' WHEN 1 THEN 'Crew' WHEN 2 THEN 'local' WHEN 3 THEN 'study' ELSE NULL END
    AS permit_type,
  CASE o % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'Single entry' WHEN 2 THEN '2' WHEN 3 THEN 'multiple' ELSE 'x9' END
    AS entries,
  CASE WHEN o % 9 = 0 THEN NULL WHEN o % 10 = 0 THEN 'P12' ELSE substr(num, 1, 8) END AS passport_number,
  CASE o % 7 WHEN 0 THEN expiry WHEN 1 THEN 'soon' WHEN 2 THEN '2019-05-05' END AS transport_validity,
  CASE o % 12 WHEN 0 THEN 'line2:pad_to_44_safe' WHEN 1 THEN 'line1:insert:pos8,line2:pad_to_44_safe' END
    AS mrz_corrections,
  mrz_line1, mrz_line2
FROM {mrz}
"""

# TD3 lines; check digits are right except where the order key makes them wrong.
MRZ = f"""
SELECT *, 'P<' || nation || rpad(family || '<<' || given, 39, '<') AS mrz_line1,
  CASE WHEN o % 41 = 0 THEN substr(head || dob7 || sex || exp7 || rest, 1, 42)
       ELSE head || dob7 || sex || exp7 || rest END || CASE WHEN o % 9 = 0 THEN '0' ELSE c_all END AS mrz_line2
FROM (
  SELECT *, {_weighted(_chars('head', 0, 10) + _chars('dob7', 0, 7) + _chars('exp7', 0, 7))}
    AS c_all
  FROM (
    SELECT *,
      num9 || CASE WHEN o % 14 = 0 THEN '0' ELSE {_weighted(_chars('num9', 0, 9))} END || nation AS head,
      dob6 || CASE WHEN o % 15 = 0 THEN '<' ELSE {_weighted(_chars('dob6', 0, 6))} END AS dob7,
      exp6 || CASE WHEN o % 16 = 0 THEN '1' ELSE {_weighted(_chars('exp6', 0, 6))} END AS exp7,
      CASE o % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN '<' ELSE 'Q' END AS sex,
      '<<<<<<<<<<<<<<0' AS rest
    FROM (
      SELECT *, substr(rpad(num, 9, '<'), 1, 9) AS num9,
        substr(dob, 3, 2) || substr(dob, 6, 2) || CASE WHEN o % 71 = 0 THEN '4O' ELSE substr(dob, 9, 2) END AS dob6,
        substr(expiry, 3, 2) || substr(expiry, 6, 2) || substr(expiry, 9, 2) AS exp6
      FROM {{submission_keys}}
    ) AS a
  ) AS b
) AS c
"""

_REGISTRY_COLUMNS = f"""
  CASE k % 8 WHEN 0 THEN 'passport' WHEN 1 THEN 'passport' WHEN 2 THEN 'visa' WHEN 3 THEN 'driving_license'
    WHEN 4 THEN 'pan_card' WHEN 5 THEN 'border_permit' WHEN 6 THEN 'aadhaar' ELSE 'voter_id' END AS document_type,
  CASE WHEN k % 11 = 0 THEN 'Z' || num WHEN k % 8 = 0 THEN num || CAST(k % 10 AS STRING) ELSE num END
    AS document_number,
  CASE WHEN k % 13 = 0 THEN given || ' OTHER' ELSE given || ' ' || family END AS name,
  CASE WHEN k % 37 = 0 THEN NULL ELSE dob END AS date_of_birth,
  CASE WHEN k % 43 = 0 THEN 'XXB' ELSE nation END AS nationality,
  expiry AS expiry_date,
  'AUTHORITY ' || CAST(k % 5 AS STRING) AS issuing_authority,
  CASE k % 7 WHEN 0 THEN 'TN' WHEN 1 THEN 'DL' WHEN 2 THEN 'KA' WHEN 3 THEN 'MH' WHEN 4 THEN 'OD' WHEN 5 THEN 'UK'
    ELSE 'GJ' END AS state,
  CASE k % 3 WHEN 0 THEN 'LMV,MCWG' WHEN 1 THEN 'LMV-NT' ELSE 'TRANS,HGV' END AS vehicle_classes,
  CASE k % 3 WHEN 0 THEN 'O+' WHEN 1 THEN 'B+' ELSE 'AB-' END AS blood_group
"""

REGISTRY_KEYS = f"""
SELECT c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment, {_number('c_custkey')} AS num,
  {_k(FAMILY, 'c_custkey')} AS family, {_k(GIVEN, 'c_custkey')} AS given,
  {_day('c_custkey', '1950-01-01', 37, 20000, 'CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END')} AS dob,
  {_day('c_custkey', '2020-01-01', 53, 4000)} AS expiry, {_k(NATION, 'c_custkey')} AS nation
FROM {{customer}}
"""

# Accounts with a high balance were re-issued: the same number appears twice.
REGISTRY = f"""
SELECT k * 2 + copy AS record_id, {_REGISTRY_COLUMNS},
  CASE WHEN k % 19 = 0 THEN 'REVOKED' WHEN k % 23 = 0 THEN 'SUSPENDED' WHEN k % 29 = 0 THEN 'EXPIRED'
    WHEN k % 47 = 0 THEN 'INVALID' WHEN k % 5 = 0 THEN 'VALID' ELSE 'ACTIVE' END AS registry_document_status
FROM (
  SELECT *, 0 AS copy FROM {{registry_keys}}
  UNION ALL
  SELECT *, 1 AS copy FROM {{registry_keys}} WHERE balance > 9000
) AS r
"""

# Accounts in debt are on the watchlist.
WATCHLIST = f"""
SELECT k AS record_id, {_REGISTRY_COLUMNS},
  CASE WHEN k % 2 = 0 THEN 'REVOKED' ELSE 'SUSPENDED' END AS registry_document_status,
  'listed: ' || segment AS watchlist_reason
FROM {{registry_keys}} WHERE balance < 0
"""

_SIGNALS = ", ".join(f"({i}, '{s}', '{c}')" for i, (s, c) in enumerate(dims.signal_categories()))

EVIDENCE = f"""
SELECT case_id, item_seq, module, signal, category, status, severity, confidence, quality, available,
  correlation_group, severity = 'NONE' AND status IN ('MATCH', 'PASS') AS is_positive, observed_at
FROM (
  SELECT l_orderkey AS case_id,
    CAST(l_linenumber AS BIGINT) * 100000000000000000 + l_partkey * 1000000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS item_seq,
    CASE s.category WHEN 'FORENSIC_ANOMALY' THEN 'M3' WHEN 'BIOMETRIC_CONSISTENCY' THEN 'M4'
      WHEN 'PRESENTATION_ATTACK' THEN 'M4' WHEN 'REGISTRY_STATUS' THEN 'M5' WHEN 'MACHINE_READABLE' THEN 'M7'
      WHEN 'VERIFICATION_UNCERTAINTY' THEN 'M1' ELSE 'M2' END AS module,
    CASE WHEN l_partkey % 97 = 0 THEN 'unlisted_signal' ELSE s.signal END AS signal,
    s.category AS category,
    CASE WHEN s.signal LIKE '%revoked' THEN 'REVOKED' WHEN s.signal LIKE '%suspended' THEN 'SUSPENDED'
      WHEN s.signal LIKE '%mismatch%' THEN 'MISMATCH' WHEN s.signal LIKE '%match%' THEN 'MATCH'
      WHEN s.signal LIKE '%not_found' THEN 'NOT_FOUND' WHEN s.signal LIKE '%expired' THEN 'EXPIRED'
      WHEN s.signal LIKE '%unavailable' THEN 'UNAVAILABLE' WHEN s.signal LIKE '%inconclusive' THEN 'INCONCLUSIVE'
      WHEN l_linestatus = 'F' THEN 'FAIL' ELSE 'PASS' END AS status,
    CASE l_suppkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH'
      ELSE 'CRITICAL' END AS severity,
    round(l_quantity / 50, 2) AS confidence,
    greatest(1 - l_tax * 5, CAST(0 AS DOUBLE)) AS quality,
    l_returnflag <> 'N' OR l_linenumber > 1 AS available,
    CASE l_linenumber % 3 WHEN 1 THEN 'REGISTRY_STATUS_SIGNALS' WHEN 2 THEN 'DOCUMENT_NUMBER_BINDING' END
      AS correlation_group,
    l_shipdate AS observed_at
  FROM {{lineitem}} AS l JOIN (VALUES {_SIGNALS}) AS s(n, signal, category) ON l.l_partkey % 94 = s.n
) AS e
"""

# the evidence of one verification is that of one document of a case
DOCUMENT_EVIDENCE = """
SELECT 'DOC-' || CAST(case_id AS STRING) AS document_id, item_seq, module, signal, category, status, severity, confidence, quality,
  available, correlation_group, is_positive FROM {evidence}
"""

# evidence as another system may deliver it: some values are outside the closed vocabularies
FOREIGN_EVIDENCE = """
SELECT item_seq, CASE WHEN item_seq % 101 = 0 THEN 'UNKNOWN' WHEN item_seq % 103 = 0 THEN NULL ELSE status END AS status,
  CASE WHEN item_seq % 107 = 0 THEN 'SEVERE' WHEN item_seq % 109 = 0 THEN 'high' ELSE severity END AS severity,
  CASE WHEN item_seq % 113 = 0 THEN 'OTHER' ELSE category END AS category,
  CASE WHEN item_seq % 127 = 0 THEN 'M9' WHEN item_seq % 131 = 0 THEN 'm1' ELSE module END AS module,
  CASE WHEN item_seq % 137 = 0 THEN 'unlisted' ELSE signal END AS signal
FROM {evidence}
"""

TEXT_ROUTING = """
SELECT doc_id, declared_type,
  CASE mark % 9 WHEN 0 THEN 'Entry Visa no 1. ' WHEN 1 THEN 'Republic of India passport ' WHEN 2 THEN 'DL No TN05 LMV COV '
    WHEN 3 THEN 'Aadhaar 2345 6789 0123 ' WHEN 4 THEN 'Income Tax Department ' WHEN 5 THEN 'Election Commission ABC1234567 '
    WHEN 6 THEN 'Permit No BP-2026 cites passport ' WHEN 7 THEN 'Consular visa ' ELSE '' END || text AS text
FROM (
  SELECT doc_id, doc_id AS mark, CASE doc_id % 7 WHEN 0 THEN 'visa' WHEN 1 THEN 'passport' WHEN 2 THEN 'drivinglicense'
    WHEN 3 THEN 'uid' WHEN 4 THEN 'pan' WHEN 5 THEN 'epic' ELSE 'borderPermit' END AS declared_type, text
  FROM {documents}
  UNION ALL
  SELECT 0 - page_id - 1, page_id, CASE WHEN page_id % 2 = 0 THEN 'passport' ELSE 'visa' END, html FROM {pages}
) AS d
"""

PAGE_TEXTS = """
SELECT doc_id, declared_type, text, CAST(300 + abs(doc_id) * 37 % 500 AS DOUBLE) AS width, CAST(250 + abs(doc_id) * 53 % 300 AS DOUBLE) AS height
FROM {text_routing} AS r0
"""

QUALITY_METRICS = """
SELECT p_partkey AS capture_id, 200 + p_partkey * 37 % 900 AS width, 180 + p_partkey * 53 % 700 AS height,
  p_size * 3.5 AS blur, p_retailprice / 8 AS brightness, p_size * 1.25 AS contrast,
  (p_partkey * 7 % 100) / CAST(250 AS DOUBLE) AS glare_ratio, p_partkey % 4 = 0 AS glare_cluster
FROM {part}
"""

FORENSIC_VOTES = """
SELECT l_orderkey AS doc_id,
  CASE l_linenumber % 5 WHEN 0 THEN 'ela' WHEN 1 THEN 'compression' WHEN 2 THEN 'photo_boundary' WHEN 3 THEN 'metadata'
    ELSE 'copy_move' END AS technique,
  CASE WHEN l_returnflag = 'R' THEN 'suspicious' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'suspicious'
    WHEN l_quantity > 45 THEN 'unavailable' ELSE 'normal' END AS status,
  CASE WHEN l_quantity > 35 THEN 'high' WHEN l_quantity > 15 THEN 'medium' ELSE 'low' END AS severity,
  round(l_quantity / 50, 2) AS confidence
FROM {lineitem}
"""

CASE_DOCUMENTS = f"""
SELECT k AS case_id, 'DOC-' || CAST(o AS STRING) AS document_id, uploaded_at, status,
  CASE o % 7 WHEN 0 THEN 'passport' WHEN 1 THEN 'visa' WHEN 2 THEN 'drivingLicense' WHEN 3 THEN 'aadhaar'
    WHEN 4 THEN 'borderPermit' WHEN 5 THEN 'voterId' ELSE 'pan' END AS document_type,
  CASE WHEN o % 7 = 0 THEN passport ELSE 'N' || CAST(o AS STRING) END AS document_number,
  CASE WHEN o % 23 = 0 THEN NULL WHEN o % 19 = 0 THEN 'X' || passport WHEN o % 2 = 0 THEN lower(passport)
    ELSE substr(passport, 1, 4) || '-' || substr(passport, 5) END AS passport_number,
  CASE WHEN o % 31 = 0 THEN ' ' WHEN o % 13 = 0 THEN given || ' OTHER' WHEN o % 11 = 0 THEN given || ' Q ' || family
    WHEN o % 3 = 0 THEN family || '<<' || given ELSE given || ' ' || family END AS name,
  CASE WHEN o % 37 = 0 THEN NULL WHEN o % 29 = 0 THEN substr(dob, 1, 4) WHEN o % 41 = 0 THEN 'n/a'
    WHEN o % 3 = 0 THEN substr(dob, 9, 2) || '/' || substr(dob, 6, 2) || '/' || substr(dob, 1, 4) ELSE dob END
    AS date_of_birth,
  CASE WHEN o % 43 = 0 THEN 'XXA' WHEN o % 5 = 0 THEN nation || '<' ELSE nation END AS nationality
FROM (
  SELECT o_orderkey AS o, o_custkey AS k, o_orderdate AS uploaded_at,
    CASE WHEN o_orderstatus = 'P' THEN 'REMOVED' WHEN o_orderkey % 5 = 2 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status,
    chr(CAST(65 + o_custkey % 26 AS INT)) || {_digits('o_custkey * 7919 % 10000000', 7)} AS passport,
    {_k(FAMILY, 'o_custkey')} AS family, {_k(GIVEN, 'o_custkey')} AS given, {_k(NATION, 'o_custkey')} AS nation,
    {_day('o_custkey', '1950-01-01', 37, 20000, 'CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END')} AS dob
  FROM {{orders}}
) AS d
"""

MODULE_RESULTS = """
SELECT o_orderkey AS case_id, o % 29 <> 0 AS has_m1, o % 31 <> 0 AS has_m2, o % 23 <> 0 AS has_m3, o % 19 <> 0 AS has_m4,
  o % 37 <> 0 AS has_m5, o % 3 <> 0 AS has_m7,
  CASE WHEN o % 17 = 0 THEN 'failed' ELSE 'completed' END AS m1_status,
  CASE WHEN o % 41 = 0 THEN NULL ELSE (40 + k % 60) / CAST(100 AS DOUBLE) END AS m1_confidence, o % 13 = 0 AS m1_low_regions,
  o % 5 <> 0 AS m1_mrz_detected, o % 4 <> 0 AS m1_mrz_applicable,
  CASE o % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'name;date_of_birth' WHEN 2 THEN '' END AS m1_missing,
  CASE o % 11 WHEN 0 THEN 'mrz_structure:failed' WHEN 1 THEN 'dob_checksum:unknown;composite_checksum:failed'
    WHEN 2 THEN 'identifier_checksum:warning:FAIL;identifier_format:unknown' WHEN 3 THEN 'expiry_date:failed:EXPIRED'
    WHEN 4 THEN 'passport_number_binding:failed;viz_mrz_name:failed' WHEN 5 THEN 'required_fields:failed' ELSE '' END
    AS m2_failed,
  CASE o % 9 WHEN 0 THEN 'high_forensic_concern' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'insufficient_data' WHEN 3 THEN NULL
    ELSE 'clean' END AS m3_overall,
  CASE o % 7 WHEN 0 THEN 'ela:suspicious:high:0.8;metadata:suspicious:low:0.55;copy_move:normal:high:0.9'
    WHEN 1 THEN 'copy_move:suspicious:severe:0.7' WHEN 2 THEN 'photo_boundary:suspicious:medium:0.66' WHEN 3 THEN 'ela:suspicious;metadata;compression:suspicious:low:n/a' ELSE '' END AS m3_signals,
  o % 43 = 0 AS m3_model_hit, CASE WHEN o % 2 = 0 THEN 0.91 END AS m3_model_confidence,
  o % 47 <> 0 AS m4_document_face, o % 53 <> 0 AS m4_live_face,
  CASE WHEN k % 3 = 0 THEN 'poor' ELSE 'acceptable' END AS m4_document_quality,
  CASE WHEN k % 5 = 0 THEN 'poor' ELSE 'acceptable' END AS m4_live_quality,
  CASE o % 8 WHEN 0 THEN 'suspected_spoof' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'live' ELSE 'pass' END AS m4_pad_status,
  CASE WHEN o % 4 = 0 THEN 0.83 END AS m4_pad_score,
  CASE WHEN o % 10 = 0 THEN 'texture_analysis;specular_glare' ELSE '' END AS m4_secondary_flags,
  CASE o % 6 WHEN 0 THEN 'no_match' WHEN 1 THEN 'inconclusive' WHEN 2 THEN NULL ELSE 'match' END AS m4_match,
  CASE WHEN o % 6 <> 2 THEN (k % 100) / CAST(100 AS DOUBLE) END AS m4_similarity,
  CASE o % 13 WHEN 0 THEN 'REVOKED' WHEN 1 THEN 'SUSPENDED' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'MISMATCH' WHEN 4 THEN 'EXPIRED'
    WHEN 5 THEN 'NOT_FOUND' WHEN 6 THEN 'AMBIGUOUS' WHEN 7 THEN 'TIMEOUT' WHEN 8 THEN 'LIVE_PROVIDER_NOT_CONFIGURED'
    WHEN 9 THEN 'PROVIDER_ERROR' WHEN 10 THEN NULL ELSE 'MATCHED' END AS m5_status,
  o % 2 = 0 AS m5_sandbox, CASE WHEN o % 4 = 0 THEN 'name' ELSE 'document_number;date_of_birth;name;nationality' END AS m5_mismatched,
  CASE WHEN o % 59 = 0 THEN false ELSE true END AS m7_applicable,
  CASE o % 5 WHEN 0 THEN 'NOT_DETECTED' WHEN 1 THEN 'DETECTED_NOT_DECODABLE' ELSE 'DECODED' END AS m7_detection,
  CASE o % 4 WHEN 0 THEN 'CRYPTO_VERIFICATION_PASSED' WHEN 1 THEN 'CRYPTO_VERIFICATION_FAILED'
    WHEN 2 THEN 'CRYPTO_VERIFICATION_NOT_CONFIGURED' END AS m7_crypto_status,
  CASE o % 6 WHEN 1 THEN 'license_number:QR_FIELD_MISMATCH;name:QR_FIELD_MATCH' WHEN 2 THEN 'dob:QR_FIELD_MISMATCH;cov:QR_FIELD_MISSING'
    ELSE 'name:QR_FIELD_MISMATCH;dob:QR_FIELD_MATCH' END AS m7_checks
FROM (SELECT o_orderkey, o_orderkey AS o, o_custkey AS k FROM {orders}) AS x
"""

LEDGER_EVENTS = """
SELECT user_id AS target_id, event_id, event_type, CAST(CAST(ts AS DATE) AS STRING) AS recorded_at, props AS payload,
  CASE event_type WHEN 'purchase' THEN 'ADMIT' WHEN 'signup' THEN 'REFER_TO_SECONDARY' WHEN 'view' THEN 'REFUSE_ENTRY'
    WHEN 'click' THEN 'REQUEST_ADDITIONAL_DOCS' ELSE 'CLEAR_ADMIT' END AS decision
FROM {events}
"""

_STAGE_CASE = " ".join(f"WHEN {i} THEN '{stage}'" for i, stage in enumerate(STAGES))
STAGE_EVENTS = f"""
SELECT user_id AS verification_id, event_id, ts AS started_at, value * 100 AS duration_ms,
  CASE event_id % 12 {_STAGE_CASE} END AS stage,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped' ELSE 'completed' END AS status
FROM {{events}}
"""

# braces are written chr(123) and chr(125): the texts are templates
_HOLDER = f"""
SELECT e AS doc_id, e, kind, value, lic, nm, CAST(DATE '1960-01-01' + CAST(u * 37 % 12000 AS INT) AS STRING) AS born,
  CAST(DATE '2015-01-01' + CAST(u * 11 % 2000 AS INT) AS STRING) AS since,
  CAST(DATE '2025-01-01' + CAST(u * 13 % 2000 AS INT) AS STRING) AS till
FROM (
  SELECT event_id AS e, user_id AS u, event_type AS kind, value,
    'TN05' || CAST(1990 + user_id % 30 AS STRING) || {_digits('user_id * 7919 % 10000000', 7)} AS lic,
    {_k(GIVEN, 'user_id')} || ' ' || {_k(FAMILY, 'user_id')} AS nm
  FROM {{events}}
) AS x
"""

PAYLOADS = """
SELECT doc_id, CASE WHEN value <= 5 THEN NULL ELSE CASE e % 6
    WHEN 0 THEN chr(123) || '"dl_no": "' || lic || '", "holder_name": "' || nm || '", "DOB": "' || born || '", "sig": "x1"' || chr(125)
    WHEN 1 THEN 'DL No: ' || lic || '|Name: ' || lower(nm) || '|birth date: ' || born || '|valid-to=' || till
    WHEN 2 THEN lic || '|' || nm || '|' || born || '|' || since || '|' || till || '|LMV,MCWG|12 Long Street Name'
    WHEN 3 THEN '<card lic_no="' || lic || '"><name>' || nm || '</name><dob>' || born || '</dob></card>'
    WHEN 4 THEN 'dl: ' || lic ELSE CASE WHEN e % 4 = 1 THEN ' ' ELSE 'scan me' END END END AS payload
FROM {holders}
"""

PRINTED_FIELDS = """
SELECT doc_id, CASE WHEN kind = 'error' THEN NULL WHEN e % 11 = 0 THEN lic || '9' ELSE substr(lic, 1, 4) || '-' || substr(lic, 5) END AS license_number,
  CASE WHEN kind = 'error' OR e % 13 = 0 THEN NULL WHEN e % 17 = 0 THEN nm || ' X' ELSE '  ' || lower(nm) END AS name,
  CASE WHEN kind = 'error' THEN NULL WHEN e % 3 = 0 THEN substr(born, 9, 2) || '.' || substr(born, 6, 2) || '.' || substr(born, 1, 4) ELSE born END AS dob,
  CASE WHEN kind <> 'error' AND e % 4 = 0 THEN since END AS valid_from, CASE WHEN kind <> 'error' AND e % 4 = 1 THEN replace(till, '-', '/') END AS valid_to,
  CASE WHEN kind = 'error' THEN NULL WHEN e % 5 = 2 THEN 'mcwg; lmv' WHEN e % 5 = 3 THEN 'LMV' END AS cov
FROM {holders}
"""

OCR_TOKENS = """
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) * 100000000000000000 + l_partkey * 1000000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS token_id,
  l_linenumber % 3 = 0 AS is_label,
  CASE WHEN l_linenumber % 3 = 0 THEN 'LABEL ' || CAST(l_suppkey % 2 AS STRING) ELSE 'V' || CAST(l_partkey % 3 AS STRING) END AS text,
  round(l_quantity / 50, 2) AS conf, l_partkey * 13 % 200 AS x0, l_partkey * 13 % 200 + 40 + l_suppkey % 60 AS x1,
  l_suppkey * 7 % 240 AS y0, l_suppkey * 7 % 240 + 18 AS y1
FROM {lineitem}
"""

# pages of two sizes, with the labels' values to their right or below
PAGE_TOKENS = """
SELECT doc_id, token_id, is_label, text, conf, x0, x0 + (x1 - x0) / 2 AS x1, y0, y1, 640 - doc_id % 2 * 320 AS page_width, 260 + doc_id % 3 * 130 AS page_height
FROM {ocr_tokens} AS t0
"""

# permits and national ids with payloads in every layout, some of other holders or unreadable
CARD_DOCUMENTS = """
SELECT verification_id, document_type, document_number, name, passport_number, CASE WHEN document_type = 'borderPermit' THEN CASE o % 8
    WHEN 1 THEN chr(123) || '"permitNo": "' || dn || '", "holder_name": "' || nm || '", "passportNo": "' || pp || '", "validTo": "' || till || '"' || chr(125)
    WHEN 2 THEN '<permit permit_number="' || dn || '" name="' || nm || '" dob="' || born || '"/>'
    WHEN 3 THEN 'BP=' || dn || '|NAME=' || lower(nm) || '|PPT=' || lower(pp) WHEN 4 THEN 'permit: ' || dn || '9; holder: ' || nm || ' X'
    WHEN 5 THEN 'scan me' WHEN 6 THEN ' ' WHEN 7 THEN chr(123) || '"permit_number": "", "docNumber": "' || dn || '", "name": "OTHER"' || chr(125) END
  ELSE CASE o % 8
    WHEN 1 THEN '<PrintLetterBarcodeData uid="' || dn || '" name="' || nm || '" yob="1990" gender="M" co="S/O A" pc="600001"/>'
    WHEN 2 THEN chr(123) || '"uid": "' || dn || '", "name": "' || nm || '", "gender": "f"' || chr(125)
    WHEN 3 THEN 'UID:' || dn || '|NAME:' || lower(nm) || '|GENDER:male' WHEN 4 THEN 'ID:' || dn || '9|NAME:' || nm || ' Y'
    WHEN 5 THEN 'scan me' WHEN 6 THEN ' ' WHEN 7 THEN 'uid=' || dn END END AS payload
FROM (
  SELECT verification_id, document_type, document_number, name, passport_number, CAST(substr(verification_id, 5) AS BIGINT) AS o,
    coalesce(document_number, '') AS dn, coalesce(replace(name, '<', ' '), '') AS nm, coalesce(passport_number, '') AS pp,
    coalesce(date_of_birth, '') AS born, coalesce(expiry_date, '') AS till
  FROM {submissions} AS s0 WHERE document_type IN ('borderPermit', 'national_id')
) AS c0
"""

# each vector against its three successors; the last ones have no partner
FACE_PAIRS = """
SELECT vec_id AS document_id, vec_id + step AS live_id, 1 + vec_id % 10 / CAST(20 AS DOUBLE) AS document_ratio,
  CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(1.2 AS DOUBLE) END AS live_ratio
FROM (
  SELECT vec_id, 1 AS step FROM {embeddings} UNION ALL SELECT vec_id, 2 FROM {embeddings} UNION ALL SELECT vec_id, 10 FROM {embeddings}
) AS e
"""

MODULE_UPDATES = """
SELECT user_id AS verification_id, ts, value AS result,
  CASE event_type WHEN 'purchase' THEN 'M1' WHEN 'signup' THEN 'M2' WHEN 'view' THEN 'M3' WHEN 'click' THEN 'M4' ELSE 'M5' END AS module
FROM {events}
"""

LOOKUPS = """
SELECT event_id, ts, 'passport' AS document_type, CAST(user_id % 20 AS STRING) AS query_hash, 'sandbox' AS provider,
  CASE WHEN event_type = 'error' THEN 'TIMEOUT' ELSE 'MATCHED' END AS outcome
FROM {events}
"""

# documents of a case since its last pause of more than an hour
LIVE_DOCUMENTS = """
SELECT * FROM (
  SELECT *, max(CASE WHEN fresh THEN moment END) OVER (PARTITION BY case_id) AS since FROM (
    SELECT *, coalesce(moment > lag(moment) OVER (PARTITION BY case_id ORDER BY moment) + INTERVAL 3600 SECOND, true) AS fresh FROM (
      SELECT *, CAST(uploaded_at AS TIMESTAMP) AS moment FROM {case_documents} AS c0
    ) AS c1
  ) AS c2
) AS c3 WHERE moment >= since
"""

FIXTURES = {
    "live_documents": LIVE_DOCUMENTS,
    "module_updates": MODULE_UPDATES,
    "lookups": LOOKUPS,
    "holders": _HOLDER,
    "payloads": PAYLOADS,
    "printed_fields": PRINTED_FIELDS,
    "ocr_tokens": OCR_TOKENS,
    "page_tokens": PAGE_TOKENS,
    "face_pairs": FACE_PAIRS,
    "card_documents": CARD_DOCUMENTS,
    "ledger_events": LEDGER_EVENTS,
    "stage_events": STAGE_EVENTS,
    "module_results": MODULE_RESULTS,
    "case_documents": CASE_DOCUMENTS,
    "text_routing": TEXT_ROUTING,
    "page_texts": PAGE_TEXTS,
    "quality_metrics": QUALITY_METRICS,
    "forensic_votes": FORENSIC_VOTES,
    "submission_keys": SUBMISSION_KEYS,
    "mrz": MRZ,
    "submissions": SUBMISSIONS,
    "registry_keys": REGISTRY_KEYS,
    "registry": REGISTRY,
    "watchlist": WATCHLIST,
    "evidence": EVIDENCE,
    "document_evidence": DOCUMENT_EVIDENCE,
    "foreign_evidence": FOREIGN_EVIDENCE,
}


def names_in(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a lazy DataFrame."""
    if name in GIVEN_TABLES:
        return read_table(spark, sf_dir, name)
    text = FIXTURES[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names_in(text)})


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over a given table that is read as a file stream."""
    if name in GIVEN_TABLES:
        return read_stream(spark, sf_dir, name)
    text = FIXTURES[name]
    return spark.sql(text, **{n: stream(spark, sf_dir, n) for n in names_in(text)})


def as_sql(text: str) -> str:
    """The text with every derived table written out, for engines that know only the given ones."""
    for name in names_in(text):
        inner = name if name in GIVEN_TABLES else f"({as_sql(FIXTURES[name])})"
        text = text.replace("{%s}" % name, inner)
    return text
