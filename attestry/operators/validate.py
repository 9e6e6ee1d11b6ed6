"""Validation jobs: every document gets an array of checks, computed without a shuffle.

A check is ``struct<check_name, status, valid, severity, reason>``; severity and reason are set
where the check raises an issue. The overall status is a function of the same array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import dims
from attestry.functions import checks, dates, text
from attestry.functions.dates import REFERENCE_DATE
from attestry.functions.text import case_when, is_blank

KEYS = ["verification_id", "document_type"]
Case = tuple  # (condition, status, valid, severity, reason)


def check(name: str, cases: list[Case], default: tuple) -> Column:
    """First matching case wins; a NULL condition does not match."""

    def verdict(status, valid, severity=None, reason=None):
        return F.struct(
            F.lit(name).alias("check_name"),
            F.lit(status).alias("status"),
            F.lit(valid).alias("valid"),
            F.lit(severity).cast("string").alias("severity"),
            F.lit(reason).cast("string").alias("reason"),
        )

    return case_when([(condition, verdict(*rest)) for condition, *rest in cases], verdict(*default))


def computed_once(df: DataFrame, keys: list[str], inputs: dict[str, Column]) -> DataFrame:
    """``keys`` and the named inputs, evaluated once per row.

    Projections above would otherwise copy each input's expression into every check that reads it. The generator
    over an array of one struct yields one row per row and keeps them apart.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in inputs.items()]))).alias("_in")
    return df.select(*keys, packed).select(*keys, "_in.*")


def _any(array: Column, *severities: str) -> Column:
    return F.exists(array, lambda c: F.coalesce(c["severity"].isin(*severities), F.lit(False)))


def overall_status(array: Column, failing: tuple, warning: tuple) -> Column:
    return case_when([(_any(array, *failing), "failed"), (_any(array, *warning), "warning")], "passed")


def _long(df: DataFrame) -> DataFrame:
    # the outer form, because a plain explode adds a filter that repeats the whole array expression
    rows = df.select("verification_id", "document_type", "overall", F.explode_outer("checks").alias("c"))
    return rows.select("verification_id", "document_type", "c.*", "overall")


def _typed(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(text.document_type(F.col("document_type")) == kind).withColumn("document_type", F.lit(kind))


def _dated(df: DataFrame, rule) -> DataFrame:
    """DATE columns born / issued / expires read by the document family's own rule."""
    return df.withColumns(
        {
            name: rule(F.col(source)).cast("date")
            for name, source in (("born", "date_of_birth"), ("issued", "issue_date"), ("expires", "expiry_date"))
        }
    )


def _missing(*columns: str) -> Column:
    return sum((is_blank(F.col(c)).cast("int") for c in columns), F.lit(0))


# ---------------------------------------------------------------------------------------
# Driving licence


def licence_checks(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    ref = F.lit(reference).cast("date")
    df = _dated(_typed(submissions, "driving_license"), dates.licence_date)
    printed = ["name", "document_number", "date_of_birth", "vehicle_classes", "transport_validity"]
    read = {c: F.col(c) for c in (*printed, "born", "issued", "expires")} | {
        "items": text.vehicle_class_items(F.col("vehicle_classes")),
        "norm": text.licence_number(F.col("document_number")),
        "clean": text.stripped(F.col("document_number")),
        "transport_until": dates.licence_date(F.col("transport_validity")).cast("date"),
    }
    df = computed_once(df, KEYS, read)
    facts = {c: F.col(c) for c in read} | {
        "known": text.vehicle_classes(F.col("items")),
        "unknown": text.unknown_vehicle_classes(F.col("items")),
        "code": F.upper(F.substring(F.coalesce("norm", "clean"), 1, 2)),
        "age": F.datediff(F.coalesce("issued", ref), F.col("born")) / 365.25,
    }
    df = computed_once(df, KEYS, facts)
    norm, code, age = F.col("norm"), F.col("code"), F.col("age")
    born, issued, expires, until = (F.col(c) for c in ("born", "issued", "expires", "transport_until"))
    no_number = is_blank(F.col("document_number"))
    no_class = is_blank(F.col("vehicle_classes"))
    known, unknown = F.size("known") > 0, (F.size("unknown") > 0) | ((F.size("items") == 0) & ~no_class)
    ages = {k: str(v) for k, v in dims.CLASS_MIN_AGE.items()}
    needed = F.array_max(
        F.transform("known", lambda c: F.coalesce(text.lookup(ages, c), F.lit(str(dims.DEFAULT_MIN_AGE))).cast("int"))
    )
    unclear = (unknown & ~known) | F.upper(text.stripped(F.col("vehicle_classes"))).isin("UNKNOWN", "XYZ", "UNKNOWN_COV")
    transport = F.size(F.array_intersect("known", F.array(*[F.lit(c) for c in dims.TRANSPORT_CLASSES]))) > 0
    # Number layouts, canonical first, then older ones, then merely plausible.
    canonical = r"^[A-Z]{2}[0-9]{2}(?:19|20)[0-9]{2}[0-9]{7}$"
    legacy = r"^[A-Z]{2}[0-9]{2}[0-9]{7,11}$|^[A-Z]{2}[0-9]{2}(?:19|20)?[0-9]{2,4}[0-9]{4,8}$|^DL[A-Z0-9]{10,16}$"
    plausible = r"^[A-Z]{2}[A-Z0-9\-\s/]{7,22}$"
    rules = [
        check(
            "required_fields",
            [(_missing("name", "document_number", "date_of_birth") > 0, "failed", False, "critical", "REQUIRED_FIELD_MISSING")],
            ("passed", True),
        ),
        check(
            "license_number_format",
            [
                (no_number, "failed", False, "critical", "IDENTIFIER_MISSING"),
                (norm.rlike(canonical), "passed", True, None, "VALID"),
                (norm.rlike(legacy), "passed", True, None, "LEGACY_VALID"),
                (
                    norm.rlike(plausible) | F.replace(F.col("clean"), F.lit(" ")).rlike(plausible),
                    "warning", False, "warning", "IDENTIFIER_FORMAT_WARNING",
                ),
            ],
            ("warning", False, "warning", "IDENTIFIER_INVALID"),
        ),
        check(
            "state_validation",
            [
                (code.isin(*dims.LEGACY_STATES), "warning", True, "info", "STATE_CODE_LEGACY"),
                (code.isin(*dims.STATE_NAMES), "passed", True, None, "STATE_CODE_VALID"),
                (code.rlike("^[A-Z]{2}$"), "warning", False, "warning", "STATE_CODE_UNKNOWN"),
            ],
            ("unknown", False),
        ),
        check(
            "date_chronology",
            [
                (born > ref, "failed", False, "critical", "FUTURE_DOB"),
                (issued > expires, "failed", False, "critical", "INVERTED_VALIDITY"),
                (born >= issued, "failed", False, "critical", "DOB_AFTER_ISSUE"),
                (born >= expires, "failed", False, "critical", "DOB_AFTER_EXPIRY"),
                (issued.isNull() & expires.isNull(), "unknown", True),
            ],
            ("passed", True),
        ),
        check(
            "expiry_date",
            [
                (expires < ref, "failed", False, "critical", "LICENSE_EXPIRED"),
                (expires >= ref, "passed", True),
            ],
            ("unknown", True),
        ),
        check(
            "age_eligibility",
            [
                (born.isNull(), "unknown", False),
                (age > dims.MAX_PLAUSIBLE_AGE, "warning", False, "warning", "IMPLAUSIBLE_AGE"),
                (~no_class & unclear, "inconclusive", False),
                (~no_class & (age < needed), "failed", False, "critical", "AGE_ELIGIBILITY_FAILED"),
                (~no_class, "passed", True),
                (age >= dims.DEFAULT_MIN_AGE, "passed", True),
                (age < 16.0, "failed", False, "critical", "AGE_ELIGIBILITY_FAILED"),
            ],
            ("inconclusive", False),
        ),
        check(
            "vehicle_class_validation",
            [(~no_class & unknown, "warning", True, "warning", "UNKNOWN_COV")],
            ("passed", True),
        ),
        check(
            "transport_validity",
            [
                (until < ref, "failed", False, "critical", "TRANSPORT_VALIDITY_EXPIRED"),
                (until >= ref, "passed", True),
                (~is_blank(F.col("transport_validity")), "warning", False, "warning", "TRANSPORT_VALIDITY_INVALID"),
                (transport, "warning", False, "warning", "TRANSPORT_VALIDITY_MISSING"),
            ],
            ("passed", True),
        ),
    ]
    df = computed_once(df, KEYS, {"checks": F.array(*rules)})
    array = F.col("checks")
    broken = F.exists(array, lambda c: c["check_name"].isin("required_fields", "license_number_format") & ~c["valid"])
    overall = case_when(
        [
            (_any(array, "critical") | broken, "failed"),
            (_any(array, "warning", "info"), "warning"),
            (F.exists(array, lambda c: c["status"] == "inconclusive"), "insufficient_data"),
        ],
        "passed",
    )
    return df.select("verification_id", "document_type", "checks", overall.alias("overall"))


# ---------------------------------------------------------------------------------------
# Visa, permit, national id, tax and voter cards


def visa_checks(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    ref = F.lit(reference).cast("date")
    df = _dated(_typed(submissions, "visa"), dates.visa_date)
    born, issued, expires = F.col("born"), F.col("issued"), F.col("expires")
    number, passport = (F.upper(text.stripped(F.col(c))) for c in ("document_number", "passport_number"))
    missing = _missing("document_number", "name", "expiry_date")
    rules = [
        check(
            "required_fields",
            [
                (missing > 1, "failed", False, "critical", "REQUIRED_FIELDS_MISSING"),
                (missing == 1, "warning", False, "warning", "REQUIRED_FIELDS_MISSING"),
            ],
            ("passed", True),
        ),
        check(
            "visa_number_format",
            [
                (is_blank(F.col("document_number")), "failed", False),
                (number.rlike("^[A-Z0-9]{6,14}$"), "passed", True),
            ],
            ("warning", False, "warning", "NUMBER_FORMAT"),
        ),
        check(
            "date_chronology",
            [
                (born >= issued, "failed", False, "critical", "DOB_AFTER_ISSUE"),
                (issued > expires, "failed", False, "critical", "INVERTED_VALIDITY"),
                (issued <= expires, "passed", True),
                (F.coalesce(F.col("issue_date"), F.lit("")) == "", "passed", True),
            ],
            ("warning", False, "warning", "UNPARSEABLE_DATE"),
        ),
        check(
            "expiry_date",
            [(expires < ref, "failed", False, "critical", "EXPIRED"), (expires >= ref, "passed", True)],
            ("warning", False, "warning", "UNPARSEABLE_DATE"),
        ),
        check(
            "passport_reference",
            [
                (is_blank(F.col("passport_number")), "warning", True),
                (passport.rlike("^[A-Z0-9]{6,12}$"), "passed", True),
            ],
            ("warning", False, "warning", "REFERENCE_FORMAT"),
        ),
        check(
            "field_consistency", [(F.col("name").rlike("[0-9]"), "warning", False, "warning", "DIGIT_IN_NAME")], ("passed", True)
        ),
    ]
    df = computed_once(df, KEYS, {"checks": F.array(*rules)})
    overall = overall_status(F.col("checks"), ("critical",), ("warning",))
    return df.select("verification_id", "document_type", "checks", overall.alias("overall"))


def permit_checks(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    ref = F.lit(reference).cast("date")
    df = _dated(_typed(submissions, "border_permit"), dates.permit_date)
    start, end = F.col("issued"), F.col("expires")
    number = F.col("document_number")
    passport = F.upper(text.stripped(F.col("passport_number")))
    no_start, no_end = is_blank(F.col("issue_date")), is_blank(F.col("expiry_date"))
    rules = [
        check(
            "required_fields",
            [
                (
                    _missing("document_number", "name", "issue_date", "expiry_date") > 0,
                    "failed", False, "critical", "REQUIRED_FIELDS_MISSING",
                )
            ],
            ("passed", True),
        ),
        check(
            "identifier_format",
            [
                (is_blank(number), "failed", False),
                (text.permit_number_ambiguous(number), "warning", False, "warning", "AMBIGUOUS_IDENTIFIER"),
                (text.permit_number(number).rlike(r"^BP\d{6,12}$"), "passed", True),
            ],
            ("warning", False, "warning", "FORMAT_WARNING"),
        ),
        check(
            "validity_period",
            [
                (start > end, "failed", False, "high", "INVALID_RANGE"),
                (start.isNotNull() & (end < ref), "warning", False, "medium", "EXPIRED"),
                (end.isNotNull() & (start > ref), "warning", False, "medium", "NOT_YET_VALID"),
                (start.isNotNull() & end.isNotNull(), "passed", True, None, "ACTIVE"),
                (~no_start | ~no_end, "warning", False, "warning", "INCOMPLETE_DATES"),
            ],
            ("failed", False, None, "UNKNOWN"),
        ),
        check(
            "passport_binding",
            [
                (is_blank(F.col("passport_number")), "not_applicable", True),
                (passport.rlike("^[A-Z0-9]{6,9}$"), "passed", True),
            ],
            ("warning", False, "warning", "PASSPORT_SYNTAX_WARNING"),
        ),
    ]
    df = computed_once(df, KEYS, {"checks": F.array(*rules)})
    overall = overall_status(F.col("checks"), ("critical", "high"), ("warning", "medium"))
    return df.select("verification_id", "document_type", "checks", overall.alias("overall"))


def _birth_year(value: Column) -> Column:
    found = F.regexp_extract(value, r"\b(19\d{2}|20[0-2]\d)\b", 1)
    return F.when(found != "", found).cast("int")


def national_id_checks(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    df = _typed(submissions, "aadhaar").withColumns(
        {
            "number": text.national_id(F.col("document_number")),
            "error": text.national_id_error(F.col("document_number")),
            "year": dates.birth_year(F.col("date_of_birth")),
        }
    )
    missing, twelve = _missing("document_number", "name", "date_of_birth"), F.length("number") == 12
    rules = [
        check(
            "required_fields",
            [
                (missing > 1, "failed", False, "critical", "REQUIRED_FIELDS_MISSING"),
                (missing == 1, "warning", False, "warning", "REQUIRED_FIELDS_MISSING"),
            ],
            ("passed", True),
        ),
        check(
            "identifier_format",
            [
                (F.col("error") == "AMBIGUOUS_IDENTIFIER", "warning", False, "warning", "AMBIGUOUS_IDENTIFIER"),
                (twelve, "passed", True),
            ],
            ("failed", False, "critical", "INVALID_IDENTIFIER"),
        ),
        check(
            "identifier_checksum",
            [
                (~F.coalesce(twelve, F.lit(False)), "unknown", False, None, "INCONCLUSIVE"),
                (checks.verhoeff_status(F.col("number")) == "PASS", "passed", True, None, "PASS"),
            ],
            ("warning", False, "warning", "FAIL"),
        ),
        check(
            "date_validity",
            [
                (F.col("year").isNull(), "warning", False, "warning", "BIRTH_YEAR_MISSING"),
                (F.col("year") < 1900, "warning", False, "warning", "BIRTH_YEAR_EARLY"),
                (F.col("year") > int(reference[:4]), "failed", False, "critical", "BIRTH_YEAR_FUTURE"),
            ],
            ("passed", True),
        ),
    ]
    df = computed_once(df, KEYS, {"checks": F.array(*rules)})
    overall = overall_status(F.col("checks"), ("critical",), ("high", "warning"))
    return df.select("verification_id", "document_type", "checks", overall.alias("overall"))


def _card_checks(submissions, kind, number, no_date: tuple, no_year: tuple, reference) -> DataFrame:
    df = _typed(submissions, kind).withColumns(
        {"number": number(F.col("document_number")), "year": _birth_year(F.col("date_of_birth"))}
    )
    rules = [
        check(
            "required_fields",
            [(_missing("document_number", "name") > 0, "failed", False, "critical", "REQUIRED_FIELDS_MISSING")],
            ("passed", True),
        ),
        check(
            "identifier_format",
            [
                (F.col("number").isNotNull(), "passed", True),
                (~is_blank(F.col("document_number")), "failed", False, "critical", "INVALID_IDENTIFIER"),
            ],
            ("unknown", False),
        ),
        check(
            "date_validity",
            [
                (is_blank(F.col("date_of_birth")), *no_date),
                (F.col("year").isNull(), *no_year),
                (F.col("year") > int(reference[:4]), "failed", False, "critical", "BIRTH_YEAR_FUTURE"),
            ],
            ("passed", True),
        ),
    ]
    df = computed_once(df, KEYS, {"checks": F.array(*rules)})
    array = F.col("checks")
    broken = F.exists(array, lambda c: c["check_name"].isin("required_fields", "identifier_format") & ~c["valid"])
    overall = case_when(
        [(_any(array, "critical"), "failed"), (_any(array, "high", "warning"), "warning"), (broken, "failed")], "passed"
    )
    return df.select("verification_id", "document_type", "checks", overall.alias("overall"))


def pan_checks(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    return _card_checks(
        submissions, "pan_card", text.pan_number, ("not_applicable", True), ("warning", False), reference
    )


def voter_checks(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    unread = ("warning", False, "warning", "BIRTH_YEAR_UNREADABLE")
    return _card_checks(submissions, "voter_id", text.voter_number, ("warning", False), unread, reference)


def licence_rules(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    return _long(licence_checks(submissions, reference))


def visa_rules(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    return _long(visa_checks(submissions, reference))


def permit_rules(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    return _long(permit_checks(submissions, reference))


def identity_card_rules(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    cards = [national_id_checks, pan_checks, voter_checks]
    frames = [_long(job(submissions, reference)) for job in cards]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


# ---------------------------------------------------------------------------------------
# Machine readable zone


def mrz_line(value: Column) -> Column:
    return F.coalesce(F.replace(F.upper(text.stripped(value)), F.lit(" "), F.lit("<")), F.lit(""))


def mrz_structure(submissions: DataFrame) -> DataFrame:
    """Adds normalised lines, the structural ``issues`` and the structure status."""
    one, two = F.col("line1"), F.col("line2")
    df = submissions.withColumns({"line1": mrz_line(F.col("mrz_line1")), "line2": mrz_line(F.col("mrz_line2"))})
    dates_read, sex = F.length(two) >= 28, F.substring(two, 21, 1)
    nothing = (one == "") & (two == "")

    def issue(code: str, severity: str, condition: Column) -> Column:
        return F.when(condition & ~nothing, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    issues = F.array(
        F.when(nothing, F.struct(F.lit("NO_MRZ").alias("code"), F.lit("warning").alias("severity"))),
        issue("LINE1_MISSING", "critical", one == ""),
        issue("LINE2_MISSING", "critical", two == ""),
        issue("LINE1_LENGTH", "critical", (one != "") & (F.length(one) != 44)),
        issue("LINE2_LENGTH", "critical", (two != "") & (F.length(two) != 44)),
        issue("LINE1_CHARSET", "critical", (one != "") & ~one.rlike("^[A-Z0-9<]+$")),
        issue("LINE2_CHARSET", "critical", (two != "") & ~two.rlike("^[A-Z0-9<]+$")),
        issue("DOCUMENT_CODE", "warning", (F.length(one) >= 5) & ~one.startswith("P")),
        issue("BIRTH_DATE_DIGITS", "warning", dates_read & ~F.substring(two, 14, 6).rlike(r"^\d{6}$")),
        issue("SEX", "warning", dates_read & ~sex.isin("M", "F", "<", "X")),
        issue("EXPIRY_DATE_DIGITS", "warning", dates_read & ~F.substring(two, 22, 6).rlike(r"^\d{6}$")),
    )
    df = df.withColumn("issues", F.filter(issues, lambda i: i.isNotNull()))
    status = case_when([(nothing, "insufficient_data"), (F.size("issues") == 0, "passed")], "failed")
    return df.withColumn("structure_status", status)


def high_risk_correction(tags: Column) -> Column:
    """True when any ``line:operation`` tag of a comma list is not marked safe."""
    operations = F.transform(
        F.split(tags, ","), lambda t: F.coalesce(F.get(F.split(t, ":"), F.lit(1)), t)
    )
    return F.coalesce((tags != "") & F.exists(operations, lambda o: ~o.endswith("_safe")), F.lit(False))


def mrz_audit(submissions: DataFrame) -> DataFrame:
    """One row per structural issue, plus one per document whose lines were rewritten."""
    df = mrz_structure(submissions)
    risky = high_risk_correction(F.col("mrz_corrections"))
    corrected = F.when(
        F.coalesce(F.col("mrz_corrections"), F.lit("")) != "",
        F.array(
            F.struct(
                F.lit("AUTO_CORRECTED").alias("code"),
                F.when(risky, "critical").otherwise("warning").alias("severity"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<code:string,severity:string>>"))
    return df.select(
        "verification_id", "structure_status", F.explode(F.concat("issues", corrected)).alias("i")
    ).select("verification_id", "structure_status", "i.*")


# Zero-based slices of the second line and the place of their check digit.
CHECK_DIGITS = {
    "document_number": ([(0, 9)], 9),
    "date_of_birth": ([(13, 19)], 19),
    "expiry_date": ([(21, 27)], 27),
    "composite": ([(0, 10), (13, 20), (21, 43)], 43),
}


def check_digits(submissions: DataFrame) -> DataFrame:
    """Computed and printed check digits per field; wrong line length yields no rows."""
    df = submissions.withColumns({"line1": mrz_line(F.col("mrz_line1")), "line2": mrz_line(F.col("mrz_line2"))})
    whole = (F.length("line1") == 44) & (F.length("line2") == 44)
    line = F.col("line2")
    cells = []
    for field, (slices, place) in CHECK_DIGITS.items():
        data = F.concat(*[F.substring(line, a + 1, b - a) for a, b in slices])
        printed = F.substring(line, place + 1, 1)
        cells.append(
            F.struct(
                F.lit(field).alias("field"),
                checks.icao_digit(data).alias("computed"),
                F.when(printed.rlike(r"^\d$"), printed).try_cast("int").alias("actual"),
            )
        )
    # the outer generator keeps the length test above it, where the line is already built
    rows = df.select(
        "verification_id", F.substring("line1", 3, 3).alias("issuer"), F.explode_outer(F.when(whole, F.array(*cells))).alias("c")
    ).filter(F.col("c").isNotNull())
    valid = F.coalesce(F.col("c.computed") == F.col("c.actual"), F.lit(False))
    return rows.select("verification_id", "issuer", "c.*", valid.alias("valid"))


def check_digit_audit(submissions: DataFrame) -> DataFrame:
    """Failure rate per issuing state and field."""
    rows = check_digits(submissions).groupBy("issuer", "field")
    return rows.agg(
        F.count("*").alias("checked"), F.count_if(~F.col("valid")).alias("failed"),
        F.round(F.count_if(~F.col("valid")) / F.count("*"), 4).alias("failure_rate"),
    )


def verhoeff_audit(submissions: DataFrame) -> DataFrame:
    rows = _typed(submissions, "aadhaar")
    number = F.coalesce(text.national_id(F.col("document_number")), F.lit(""))
    return rows.select(
        "verification_id", text.masked(F.col("document_number")).alias("number"),
        checks.verhoeff_status(number).alias("checksum_status"),
    )


def validity_window(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    """Expiry against the reference date and length of the validity span."""
    rule = dates.licence_date
    issued, expires = rule(F.col("issue_date")).cast("date"), rule(F.col("expiry_date")).cast("date")
    born, mrz_expiry = F.substring("line2", 14, 6), F.substring("line2", 22, 6)
    df = submissions.withColumns({"issued": issued, "expires": expires, "line2": mrz_line(F.col("mrz_line2"))})
    years = F.round(F.datediff("expires", "issued") / 365.25, 2)
    expired = F.col("expires") < F.lit(reference).cast("date")
    inverted = F.col("expires") <= F.col("issued")
    return df.select(
        "verification_id",
        F.col("issued").cast("string").alias("issue_date"),
        F.col("expires").cast("string").alias("expiry_date"),
        dates.mrz_date(born, False, reference).cast("string").alias("mrz_birth_date"),
        dates.mrz_date(mrz_expiry, True, reference).cast("string").alias("mrz_expiry_date"),
        case_when([(expired, "failed"), (~expired, "passed")], "unknown").alias("expiry_status"),
        F.when(~inverted, years).alias("validity_years"),
        case_when([(inverted | (years > 10), "warning"), (~inverted, "passed")], "unknown").alias("validity_status"),
    )


# ---------------------------------------------------------------------------------------
# Routing, capture quality, forensic votes


def _says(value: Column, *words: str, pattern: str | None = None) -> Column:
    parts = [w.replace("/", r"\/") for w in words] + ([pattern] if pattern else [])
    return value.rlike("|".join(parts))


def detected_type(value: Column) -> Column:
    """Document type told by the wording of a text; visas and permits often cite a passport."""
    up = F.upper(value)
    visa = (
        _says(up, "ENTRY VISA", "VISA / VISA", "VISA NUMBER", "TYPE OF VISA", "VISA TYPE")
        | (up.rlike(r"\bVISA\b") & ~_says(up, "PASSPORT", "DRIVING LICENCE", "DRIVING LICENSE") & up.contains("CONSULAR"))
        | up.rlike(r"\bV[<A-Z0-9]{30,}")
    )
    permit = _says(
        up, "BORDER PERMIT", "ENTRY PERMIT", "CROSS-BORDER", "WORK PERMIT", "EMPLOYMENT PERMIT", "CROSSING PERMIT",
        "BORDER CONTROL", "REGIONAL BORDER", "BORDER MANAGEMENT", pattern=r"\bPERMIT\s*NO\b|\bBP[-0-9]{5,}\b",
    )
    header = _says(up, "REPUBLIC OF INDIA", "PASSEPORT", pattern=r"\bPASSPORT\b")
    licence = _says(
        up, "DRIVING LICENCE", "DRIVING LICENSE", "UNION OF INDIA DRIVING", "TRANSPORT DEPARTMENT", "MOTOR VEHICLES",
        "FORM 7", "COV", "MCWG", pattern=r"\bDL\s*NO\b",
    )
    national = _says(
        up, "AADHAAR", "UNIQUE IDENTIFICATION AUTHORITY OF INDIA", "MERA AADHAAR", "UIDAI", "ENROLMENT NO",
        "MERI PEHCHAN", pattern=r"\b\d{4}\s\d{4}\s\d{4}\b",
    )
    voter = _says(
        up, "ELECTION COMMISSION", "ELECTORS PHOTO IDENTITY", "EPIC", "ELECTORAL ROLL", "VOTER ID",
        pattern=r"\b[A-Z]{3}\d{7}\b",
    )
    tax = _says(
        up, "INCOME TAX DEPARTMENT", "PERMANENT ACCOUNT NUMBER", "INCOME TAX INDIA", "NSDL", "UTIITSL",
        pattern=r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    )
    return case_when(
        [
            (visa, "visa"),
            (permit, "border_permit"),
            (header | up.rlike(r"\bP<[A-Z]{3}"), "passport"),
            (licence, "driving_license"),
            (national, "aadhaar"),
            (voter, "voter_id"),
            (tax, "pan_card"),
        ]
    )


def text_routing(documents: DataFrame) -> DataFrame:
    """Declared and detected type per text with the mismatch flag."""
    df = documents.select(
        "doc_id", text.document_type(F.col("declared_type")).alias("declared_type"),
        detected_type(F.col("text")).alias("detected_type"),
    )
    mismatch = F.coalesce(F.col("detected_type") != F.col("declared_type"), F.lit(False))
    return df.select("*", mismatch.alias("is_mismatch"))


def text_routing_matrix(documents: DataFrame) -> DataFrame:
    rows = text_routing(documents).groupBy("declared_type", F.coalesce("detected_type", F.lit("none")).alias("detected_type"))
    return rows.agg(F.count("*").alias("row_count"), F.count_if("is_mismatch").alias("mismatches"))


def quality_score(metrics: DataFrame) -> DataFrame:
    """Sub-scores and status from measured width, height, blur, brightness, contrast and glare."""
    short, long = F.least("width", "height"), F.greatest("width", "height")
    blur, light, contrast, glare = (F.col(c) for c in ("blur", "brightness", "contrast", "glare_ratio"))

    def whole(value: Column) -> Column:
        return value.cast("int")  # truncates

    area = F.least(F.lit(1.0), F.col("width") * F.col("height") / (800 * 500))
    scores = {
        "resolution_score": F.when(
            (short < 320) | (long < 450), F.greatest(F.lit(10), whole(short / 320 * 45))
        ).otherwise(whole(75 + area * 25)),
        "sharpness_score": case_when(
            [
                (blur < 35.0, F.greatest(F.lit(10), whole(blur / 35.0 * 45))),
                (blur < 100.0, whole(60 + (blur - 35.0) / (100.0 - 35.0) * 30)),
            ],
            F.least(F.lit(100), whole(90 + F.least(F.lit(10.0), (blur - 100.0) / 20))),
        ),
        "brightness_score": case_when(
            [
                (light < 45.0, F.greatest(F.lit(15), whole(light / 45.0 * 40))),
                (light > 248.0, F.greatest(F.lit(15), whole(50 - (light - 248.0) * 2))),
                (light.between(80.0, 185.0), F.lit(95)),
            ],
            F.lit(80),
        ),
        "contrast_score": case_when(
            [
                (contrast < 22.0, F.greatest(F.lit(15), whole(contrast / 22.0 * 45))),
                (contrast < 45.0, whole(65 + (contrast - 22.0) / (45.0 - 22.0) * 25)),
            ],
            F.least(F.lit(100), whole(90 + F.least(F.lit(10.0), (contrast - 45.0) / 5))),
        ),
        "glare_score": case_when(
            [
                (
                    glare.between(0.015, 0.30) & (F.col("glare_cluster") | (glare > 0.035)),
                    F.greatest(F.lit(15), whole(45 - glare * 300)),
                ),
                ((glare > 0.01) & (glare <= 0.30), F.lit(75)),
            ],
            F.lit(98),
        ),
    }
    df = metrics.withColumns(scores)
    total = (
        F.col("sharpness_score") * 0.30 + F.col("resolution_score") * 0.25 + F.col("brightness_score") * 0.15
        + F.col("contrast_score") * 0.15 + F.col("glare_score") * 0.15
    )
    df = df.withColumn("overall_score", F.greatest(F.lit(0), F.least(F.lit(100), whole(total))))
    critical = (
        (F.col("sharpness_score") < 48) | (F.col("resolution_score") < 48) | (F.col("brightness_score") < 45)
        | (F.col("glare_score") < 45) | (F.col("contrast_score") < 45)
    )
    status = case_when(
        [(critical | (F.col("overall_score") < 55), "poor"), (F.col("overall_score") < 72, "warning")], "acceptable"
    )
    return df.select("capture_id", *scores, "overall_score", status.alias("status"))


def forensic_vote(votes: DataFrame) -> DataFrame:
    """Overall forensic assessment per document; techniques that did not run have no vote."""
    ran = ~F.col("status").isin("unavailable", "insufficient_data")
    suspicious = ran & (F.col("status") == "suspicious")
    counted = votes.groupBy("doc_id").agg(
        F.count_if(suspicious & (F.col("severity") == "high")).alias("strong"),
        F.count_if(suspicious & (F.col("severity") == "medium")).alias("weak"),
        F.count_if(ran).alias("votes"),
    )
    overall = case_when(
        [
            (F.col("strong") >= 2, "high_forensic_concern"),
            ((F.col("strong") == 1) | (F.col("weak") >= 2), "suspicious"),
        ],
        "no_significant_anomaly",
    )
    return counted.select("*", overall.alias("overall_assessment"))
