"""Literal vectors of the identity, date and check-digit rules."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from attestry.functions import checks, dates, text
from attestry.operators import crossdoc, payloads, standardize, validate
from attestry.operators.registry import blind_index, blind_index_pads


def one(spark, value, rule, kind="string"):
    row = spark.createDataFrame([(value,)], f"v {kind}").select(rule(F.col("v")).alias("r")).first()
    return row.r


CASES = [
    (text.person_name, "DOE<<JOHN<MICHAEL", "DOE JOHN MICHAEL"),
    (text.person_name, "  alice   bob ", "ALICE BOB"),
    (text.person_name, " << ", None),
    (text.document_number, " t 987 6543", "T9876543"),
    (text.nationality, "ind<", "IND"),
    (text.licence_number, "tn-05 2019/0001234", "TN0520190001234"),
    (text.licence_number, "ＴＮ０５２０１９０００１２３４", "TN0520190001234"),
    (text.licence_number, "TN0520190001234 OR DL0420190001234", None),
    (text.licence_number, "TN05#2019", None),
    (text.blood_group, "B NEGATIVE", "B-"),
    (text.blood_group, "o +ve", "O+"),
    (text.blood_group, "A+ OR B+", None),
    (text.blood_group, "AB", None),
    (text.permit_number, "BP-2026-000123", "BP2026000123"),
    (text.permit_type, "Entry Permit", "ENTRY"),
    (text.holder_name, "Holder Name: ravi  kumar", "RAVI KUMAR"),
    (text.entries, "mult", "MULTIPLE"),
    (text.masked, "1234 5678 9012", "XXXX XXXX 9012"),
    (text.masked, "12", "XXXX XXXX XXXX"),
    (text.national_id_error, "1234 5678 9012", "INVALID_FIRST_DIGIT"),
    (text.national_id_error, "2234 5678 901O", "AMBIGUOUS_IDENTIFIER"),
    (text.national_id_error, "2234 5678 9012", None),
    (text.pan_number, "abcpe 1234-f", "ABCPE1234F"),
    (text.voter_number, "abc 1234567", "ABC1234567"),
    (text.document_type, " drivingLicense ", "driving_license"),
    (text.document_type, "NID", "aadhaar"),
    (text.address, "S/O: 12  Main Road, ", "12 Main Road"),
    (text.gender, "sex: male", "MALE"),
    (text.state_name, "or", "Odisha"),
    (text.state_status, "or", "LEGACY"),
    (dates.lenient_date, "850615", "1985-06-15"),
    (dates.lenient_date, "290615", "2029-06-15"),
    (dates.lenient_date, "31/02/1990", "1990-02-31"),
    (dates.lenient_date, "1990-13-01", None),
    (dates.licence_date, "31-02-1990", None),
    (dates.licence_date, "15 MAY 1992", "1992-05-15"),
    (dates.licence_date, "29.02.2024", "2024-02-29"),
    (dates.licence_date, "15-05-92", None),
    (dates.visa_date, "15 OCT 2028", "2028-10-15"),
    (dates.visa_date, "15/10/2028", "2028-10-15"),
    (dates.permit_date, "5 september 2026", "2026-09-05"),
    (dates.permit_date, "5 sept 2026", None),
    (dates.full_birth_date, "DOB: 05/06/1990", "1990-06-05"),
    (dates.birth_year, "Year of Birth 1984", 1984),
    (dates.visual_date, "05/06/49", "2049-6-5"),
    (dates.visual_date, "05/06/50", "1950-6-5"),
    (checks.icao_digit, "L898902C<", 3),
    (checks.icao_digit, "740812", 2),
    (checks.icao_digit, "", 0),
    (checks.verhoeff_status, "12345", "INCONCLUSIVE"),
    (validate.detected_type, "ENTRY VISA passport no 1", "visa"),
    (validate.detected_type, "work permit, passport 1", "border_permit"),
    (validate.detected_type, "nothing here", None),
]


@pytest.mark.parametrize("rule,value,expected", CASES, ids=[f"{r.__name__}-{v}" for r, v, _ in CASES])
def test_rule(spark, rule, value, expected):
    assert one(spark, value, rule) == expected


def test_verhoeff_accepts_exactly_one_last_digit(spark):
    rows = spark.range(10).select(F.concat(F.lit("23412341234"), F.col("id").cast("string")).alias("v"))
    passed = rows.filter(checks.verhoeff_status(F.col("v")) == "PASS").count()
    assert passed == 1


def test_verhoeff_tables_follow_their_rules():
    def product(a, b):
        if a < 5:
            return (a + b) % 5 if b < 5 else (a + b - 5) % 5 + 5
        return (a - b) % 5 + 5 if b < 5 else (a - b) % 5

    assert checks.VERHOEFF_D == "".join(str(product(a, b)) for a in range(10) for b in range(10))
    rows = [list(range(10)), [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]]
    while len(rows) < 8:
        rows.append([rows[1][d] for d in rows[-1]])
    assert checks.VERHOEFF_P == "".join(str(d) for row in rows for d in row)
    # published sample of the scheme: 236 carries the check digit 3
    state = 0
    for i, digit in enumerate(reversed("2363")):
        state = product(state, rows[i % 8][int(digit)])
    assert state == 0


def test_names_equal(spark):
    def equal(a, b, **options):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        return df.select(text.names_equal(F.col("a"), F.col("b"), **options)).first()[0]

    assert equal("DOE<<JOHN", "john doe")
    assert equal("KAVITHAPRABHAKAR", "KAVITHA PRABHAKAR")
    assert equal("AMY", "MAY")
    assert not equal("AMY", "MAY", strict=True)
    assert not equal("JOHN DOE", "JOHN M DOE")
    assert not equal(None, "JOHN")


def test_vehicle_classes(spark):
    items = spark.createDataFrame([("mc with gear; LMV ZZ99, cov: TRLR",)], "v string").select(
        text.vehicle_class_items(F.col("v")).alias("i")
    )
    row = items.select(text.vehicle_classes(F.col("i")).alias("k"), text.unknown_vehicle_classes(F.col("i")).alias("u")).first()
    assert row.k == ["LMV", "MCWG", "TRAILR"] and row.u == ["ZZ99"]


def test_mrz_century(spark):
    births = [("240131", "2024-01-31"), ("240202", "1924-02-02"), ("850615", "1985-06-15"), ("990230", None)]
    for raw, expected in births:
        got = one(spark, raw, lambda c: dates.mrz_date(c, False).cast("string"))
        assert got == expected, raw
    assert one(spark, "850615", lambda c: dates.mrz_date(c, True).cast("string")) == "2085-06-15"


def test_high_risk_correction(spark):
    assert one(spark, "line1:insert:pos8,line2:pad_to_44_safe", validate.high_risk_correction) is True
    assert one(spark, "line2:pad_to_44_safe", validate.high_risk_correction) is False
    assert one(spark, "", validate.high_risk_correction) is False
    assert one(spark, None, validate.high_risk_correction) is False


def test_canonical_field_takes_first_non_blank_alias(spark):
    df = spark.createDataFrame([({"docNumber": " ", "permitNumber": " P1 ", "sex": "F"},)], "traveler_data map<string,string>")
    row = standardize.canonical_fields(df).first()
    assert row.document_number == "P1" and row.gender == "F" and row.name is None


def test_blind_index_is_hmac(spark):
    secret = b"k" * 70  # longer than one hash block
    df = spark.createDataFrame([("passport", "t 98-76"), ("visa", "V1")], "document_type string, n string")
    pads = blind_index_pads(secret, ["passport", "visa"])
    rows = df.select("document_type", blind_index(F.col("document_type"), F.col("n"), pads).alias("h")).collect()
    expected = {k: hmac.new(secret + k.encode(), n.encode(), hashlib.sha256).hexdigest() for k, n in (("passport", "T9876"), ("visa", "V1"))}
    assert {r.document_type: r.h for r in rows} == expected


def test_payload_layouts(spark):
    texts = [
        ('{"DL-No": "A1", "name": "", "holder": "X", "signature": "s"}', "JSON", "A1", "X"),
        ('<c:card lic_no="A1"><c:name>X</c:name></c:card>', "XML", "A1", "X"),
        ("dl no: A1; Name = X", "DELIMITED_KEY_VALUE", "A1", "X"),
        ("TN0520190001234;X;01-02-1990", "POSITIONAL_DELIMITED", "TN0520190001234", "X"),
        ("dl: A1", "DELIMITED_KEY_VALUE", "A1", None),
        ("a|b", "PLAIN_TEXT", None, None),
        ("  ", "CORRUPTED", None, None),
    ]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id int, payload string")
    rows = payloads.parse_payloads(df).orderBy("doc_id").collect()
    assert [(r.payload_type, r.license_number, r.name) for r in rows] == [t[1:] for t in texts]
    assert [r.signed for r in rows] == [True] + [False] * 6


PAIRS = [
    ("STRICT", "ab-1", "AB1", "MATCHED"), ("STRICT", "--", "AB1", "MISMATCH"), ("STRICT", " ", None, "UNAVAILABLE"),
    ("NORMALIZED_DATE", "1990", "01/02/1990", "CONSISTENT_YEAR"), ("NORMALIZED_DATE", "1990", "1991", "MISMATCH"),
    ("NORMALIZED_DATE", "1990", "soon", "INCONCLUSIVE"), ("NORMALIZED_DATE", "900201", "1990-02-01", "MATCHED"),
    ("NORMALIZED_TOKEN_SET", "doe<<john", "John Doe", "MATCHED"), ("NORMALIZED_TOKEN_SET", "John", "John Doe", "PARTIAL_MATCH"),
    ("NORMALIZED_TOKEN_SET", "<<", "John Doe", "INCONCLUSIVE"), ("NORMALIZED_CODE", "ind<", "IND", "MATCHED"),
    ("NORMALIZED_CODE", "<", "IND", "MISMATCH"), ("EXACT", "a b", "A B", "MATCHED"), ("EXACT", "a", "", "MISSING_TARGET_FIELD"),
]


def test_pairs_are_compared_by_forms_made_once_per_value(spark):
    forms = lambda side: [crossdoc.comparable(F.lit(pair[side]).cast("string"), pair[0]) for pair in PAIRS]
    found = [crossdoc.compare_forms(a, b, F.lit(p[0])).alias(str(i)) for i, (p, a, b) in enumerate(zip(PAIRS, forms(1), forms(2), strict=True))]
    assert list(spark.range(1).select(*found).first()) == [pair[3] for pair in PAIRS]


ODD_DATES = [
    ("1990-02-31", "1990-02-31"), ("2100-12-01", "2100-12-01"), ("2101-12-01", None), ("1990-02-31\n", "1990-02-31"), (" 1990 02 03 ", "1990-02-03"),
    ("1990.0203", "1990-02-03"), ("3/4/1990", None), ("03.04-1990", "1990-04-03"), ("03-04-1990 ", "1990-04-03"), ("003041", None),
    ("300401", "1930-04-01"), ("290401\t", "2029-04-01"), ("99 12 31", "1999-12-31"), ("", None), ("29040", None), (None, None),
]


def test_lenient_dates_by_position_and_by_pattern(spark):
    rows = spark.createDataFrame(ODD_DATES, "v string, expected string")
    assert [(r.v, r.got) for r in rows.select("v", dates.lenient_date(F.col("v")).alias("got")).collect()] == ODD_DATES


def test_name_letters_decide_as_names_equal(spark):
    names = ["John  Doe", "doe<<john", "Doe John John", "JohnDoe", "Jon Doe", " ", "<<", None]
    one = spark.createDataFrame([(n,) for n in names], "a string")
    letters = lambda c: text.name_letters(text.person_name(F.col(c)))
    same = F.coalesce(letters("a") == letters("b"), F.lit(False))
    found = one.crossJoin(one.withColumnRenamed("a", "b")).select(same.alias("x"), text.names_equal(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(r.x == r.y for r in found) and sum(r.x for r in found) == 17
