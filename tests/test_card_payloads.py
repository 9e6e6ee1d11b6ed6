"""Payload layouts of permits and national ids on written-out documents."""

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle

from attestry.operators import card_payloads, validate
from attestry.plans import catalog
from attestry.sources.tables import GIVEN_TABLES

SCHEMA = "verification_id string, document_type string, document_number string, name string, passport_number string, payload string"


def documents(spark, *rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], SCHEMA)


def fields(spark, cases):
    """Layout, status and fields of each payload, read in one job."""
    rows = card_payloads.card_payload_fields(documents(spark, *[(kind, None, None, None, case[0]) for kind, case in cases]))
    found = {}
    for r in rows.collect():
        found.setdefault(r.verification_id, (r.layout, r.payload_status, {}))[2].update({r.field: r.value} if r.field else {})
    return [found[str(i)] for i in range(len(cases))]


PERMITS = [
    (None, None, "absent", {}),
    ("  \n ", None, "absent", {}),
    ('{"permitNo": "BP-2026-000123", "type": "crew", "validFrom": "01/02/2026"}', "JSON", "PAYLOAD_DECODED",
     {"number": "BP2026000123", "permit_type": "crew", "valid_from": "2026-02-01"}),
    # the first key with a value wins, of a repeated key the last value
    ('{"permit_number": "", "docNumber": "BP1", "docNumber": "BP2"}', "JSON", "PAYLOAD_DECODED", {"number": "BP2"}),
    ('{"permitNo": ', None, "MALFORMED_PAYLOAD", {}),
    ("<permit permitNo='BP2026000123' name=\"a  b\"><x/></permit>", "XML", "PAYLOAD_DECODED", {"number": "BP2026000123", "name": "A B"}),
    ('<permit permitNo="BP1"', "DELIMITED", "PAYLOAD_DECODED", {}),
    ("bp: BP-1 ; Holder = Name: x\nppt:P1", "DELIMITED", "PAYLOAD_DECODED", {"number": "BP1", "name": "X", "passport_number": "P1"}),
    ("x" * 200_000, None, "MALFORMED_PAYLOAD", {}),
]
CARDS = [
    (None, None, "NOT_FOUND", {}),
    ('<PrintLetterBarcodeData uid="2234 5678 9012" NAME="ann lee" yob="1990" gender="f" house="1" vtc="Town" pc="6"/>', "XML", "PAYLOAD_DECODED",
     {"number": "223456789012", "name": "ANN LEE", "year_of_birth": "1990", "gender": "FEMALE", "address": "1, Town, 6"}),
    ('{"id": 223456789012, "name": "ann", "address": "Hill"}', "JSON", "PAYLOAD_DECODED", {"number": "223456789012", "name": "ANN", "address": "Hill"}),
    ("AADHAAR:2234-5678-9012|NAME: ann |DOB:01/02/1990", "DELIMITED", "PAYLOAD_DECODED",
     {"number": "223456789012", "name": "ANN", "date_of_birth": "01/02/1990"}),
    ("UID:A23456789012", "DELIMITED", "PAYLOAD_DECODED", {}),
    ("[1, 2]", None, "PAYLOAD_MALFORMED", {}),
]


def test_layouts(spark):
    cases = [("borderPermit", c) for c in PERMITS] + [("national_id", c) for c in CARDS]
    assert fields(spark, cases) == [c[1:] for _, c in cases]


def test_comparison_and_other_types(spark):
    docs = documents(
        spark,
        ("borderPermit", "BP-2026-000123", "ravi kumar", "p1", "BP=BP2026000123|NAME=KUMAR RAVI|PPT=P1"),
        ("borderPermit", "BP-2026-000123", "ravi", None, "NAME=RAVI KUMAR|PPT=P9"),
        ("borderPermit", None, None, None, "PPT=P9"),
        ("national_id", "2234 5678 9012", "Ann Lee", "P1", "UID:223456789012|NAME:LEE"),
        ("national_id", "2234 5678 9012", "Ann Lee", None, "UID:223456789013|NAME:BOB"),
        ("national_id", None, None, None, "NAME:BOB"),
        ("passport", "X", "Y", None, "UID:1"),
        (None, None, None, None, None),
    )
    found = {}
    for r in card_payloads.card_payload_crosscheck(docs).collect():
        found.setdefault((r.verification_id, r.overall), {}).update({r.field: r.status} if r.field else {})
    assert found == {
        ("0", "MATCHED"): {"number": "MATCHED", "name": "MATCHED", "passport_number": "MATCHED"},
        ("1", "MATCHED"): {"name": "MATCHED"},
        ("2", "MATCHED"): {},
        ("3", "MATCHED"): {"number": "MATCHED", "name": "MATCHED"},
        ("4", "MISMATCH"): {"number": "MISMATCH", "name": "MISMATCH"},
        ("5", "INCONCLUSIVE"): {},
    }
    assert card_payloads.card_payload_crosscheck(docs.limit(0)).count() == 0


def test_payload_check_in_the_roll_up(spark):
    docs = documents(
        spark,
        ("borderPermit", "BP-2026-000123", "ravi", "P12345", "NAME=OTHER"),
        ("borderPermit", "BP-2026-000123", "ravi", "P12345", None),
        ("national_id", "2345 6789 0124", "ann", None, "NAME:BOB"),
    ).selectExpr("*", "'01/01/2024' AS issue_date", "'01/01/2027' AS expiry_date", "'01/01/1990' AS date_of_birth")
    got = {}
    for checks in (validate.permit_checks, validate.national_id_checks):
        before = {r.verification_id: r.overall for r in checks(docs).collect()}
        for r in card_payloads.with_payload_check(checks(docs), docs).collect():
            last = r.checks[-1]
            got[r.verification_id] = (before[r.verification_id], r.overall, last.check_name, last.status)
    assert got["0"] == ("passed", "failed", "qr_consistency", "failed")
    assert got["1"] == ("passed", "passed", "qr_consistency", "not_applicable")
    assert got["2"][1:] == ("warning", "qr_consistency", "failed")


@pytest.mark.parametrize("name", ["card_payload_fields", "card_payload_crosscheck", "payload_consistency"])
def test_a_permit_whose_keys_hold_nothing_is_no_delimited_text(spark, tmp_path, name):
    """Order 423243 has no number, name or passport number, so its payload reads BP=|NAME=|PPT=; the SQL called it decoded."""
    day, columns = datetime(1996, 1, 2), "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    orders = [(o, 13, "O", 1.0, day, "5-LOW") for o in (423243, 423235, 3, 4)]
    for t in GIVEN_TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (tmp_path / "orders.parquet").unlink()
    spark.createDataFrame(orders, columns).toPandas().to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    query, sql = catalog.queries()[name], catalog.oracle_sql()[name]
    assert oracle.compare(spark, oracle.connect(str(tmp_path)), str(tmp_path), query, sql)[0] is None
    if name == "payload_consistency":
        assert {r.verification_id: r.status for r in query(spark, str(tmp_path)).collect()}["VER-423243"] == "warning"
