"""Passport validation: structure, check digits, dates, binding and consistency of both zones, with the roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import checks, dates
from attestry.functions.dates import REFERENCE_DATE
from attestry.functions.text import case_when
from attestry.operators import pairing, validate
from attestry.operators.validate import CHECK_DIGITS, KEYS, check

# check name per check digit and the severity of its failure
DIGIT_CHECKS = {
    "document_number": ("document_number_checksum", "failure"),
    "date_of_birth": ("dob_checksum", "failure"),
    "expiry_date": ("expiry_checksum", "failure"),
    "composite": ("composite_checksum", "critical"),
}
# fields of both zones that share one check
OTHER_FIELDS = ("nationality", "expiry_date", "gender")


def _digit_right(field: str) -> Column:
    slices, place = CHECK_DIGITS[field]
    data = F.concat(*[F.substring("line2", a + 1, b - a) for a, b in slices])
    printed = F.substring("line2", place + 1, 1)
    return F.coalesce(checks.icao_digit(data) == F.when(printed.rlike(r"^\d$"), printed).try_cast("int"), F.lit(False))


def _agrees(field: str) -> Column:
    return F.element_at(F.filter("cells", lambda c: c["field"] == field), 1)["match"]


def passport_checks(submissions: DataFrame, reference: str = REFERENCE_DATE) -> DataFrame:
    """One row per passport with its array of checks and the overall status.

    Without any machine readable line all checks are unknown and the status is ``insufficient_data``. A line that is
    not 44 characters long fails all check digits and leaves the other checks unknown, since no offset in it can be
    trusted.
    """
    df = validate.mrz_structure(validate._typed(submissions, "passport"))
    df, cells = pairing.viz_mrz_cells(df, reference)
    read = {c: F.col(c) for c in ("line1", "line2", "issues", "structure_status")} | {"cells": cells}
    read["issued"] = dates.licence_date(F.col("issue_date")).cast("date")
    read["tags"] = F.coalesce("mrz_corrections", F.lit(""))
    df = validate.computed_once(df, KEYS, read)
    facts = {c: F.col(c) for c in ("line1", "line2", "issues", "structure_status", "issued", "tags")}
    facts |= {f"right_{f}": _digit_right(f) for f in CHECK_DIGITS}
    facts |= {f"agrees_{f}": _agrees(f) for f in ("document_number", "name", "date_of_birth", *OTHER_FIELDS)}
    facts["expires"] = dates.mrz_date(F.substring("line2", 22, 6), True, reference).cast("date")
    df = validate.computed_once(df, KEYS, facts)
    nothing = F.col("structure_status") == "insufficient_data"
    unequal = (F.length("line1") != 44) | (F.length("line2") != 44)
    expires, issued = F.col("expires"), F.col("issued")
    critical = F.exists("issues", lambda i: i["severity"] == "critical")
    absent = (nothing, "unknown", False)
    length = (unequal, "unknown", False)
    years = F.datediff(expires, issued) / 365.25
    rules = [
        check(
            "mrz_structure",
            [
                (nothing, "insufficient_data", False),
                (F.size("issues") == 0, "passed", True),
                (critical, "failed", False, "critical", "MRZ_STRUCTURE"),
            ],
            ("failed", False, "warning", "MRZ_STRUCTURE"),
        ),
        check(
            "mrz_auto_correction",
            [
                (nothing | (F.col("tags") == ""), "passed", True),
                (validate.high_risk_correction(F.col("tags")), "failed", False, "critical", "HIGH_RISK_CORRECTION"),
            ],
            ("warning", True, "warning", "SAFE_CORRECTION"),
        ),
        check("mrz_length", [(nothing | ~unequal, "passed", True)], ("failed", False, "critical", "LENGTH_CRITICAL")),
        *[
            check(
                name,
                [absent, (unequal, "failed", False), (F.col(f"right_{field}"), "passed", True)],
                ("failed", False, severity, "CHECK_DIGIT"),
            )
            for field, (name, severity) in DIGIT_CHECKS.items()
        ],
        check(
            "expiry_date",
            [
                absent, length, (expires.isNull(), "unknown", False, "failure", "UNPARSEABLE_DATE"),
                (expires < F.lit(reference).cast("date"), "failed", False, "failure", "EXPIRED"),
            ],
            ("passed", True),
        ),
        check(
            "validity_period",
            [
                absent, length, (expires <= issued, "warning", False, "warning", "INVERTED_VALIDITY"),
                (F.round(years, 2) > 10, "warning", False, "warning", "EXCEEDS_STANDARD_TERM"), (expires > issued, "passed", True),
            ],
            ("unknown", True),
        ),
        check(
            "passport_number_binding",
            [
                absent, length, (F.col("agrees_document_number"), "passed", True),
                (~F.col("agrees_document_number"), "failed", False, "critical", "NUMBER_MISMATCH"),
            ],
            ("unknown", True),
        ),
        *[
            check(
                f"viz_mrz_{name}",
                [(nothing | unequal, "unknown", True), (~agrees, "mismatch", False, severity, "VIZ_MRZ_MISMATCH"), (agrees, "match", True)],
                ("unknown", True),
            )
            for name, agrees, severity in (
                # the number's mismatch is an issue of the binding check
                ("document_number", F.col("agrees_document_number"), None),
                ("name", F.col("agrees_name"), "warning"),
                ("date_of_birth", F.col("agrees_date_of_birth"), "warning"),
                ("other", _all([F.col(f"agrees_{f}") for f in OTHER_FIELDS]), "warning"),
            )
        ],
    ]
    df = validate.computed_once(df, KEYS, {"checks": F.array(*rules), "structure_status": F.col("structure_status")})
    overall = validate.overall_status(F.col("checks"), ("critical", "failure"), ("warning",))
    overall = F.when(F.col("structure_status") == "insufficient_data", "insufficient_data").otherwise(overall)
    return df.select("verification_id", "document_type", "checks", overall.alias("overall"))


def _all(columns: list[Column]) -> Column:
    """False if any is false, true if any is true and none false, else NULL."""
    false = [F.coalesce(~c, F.lit(False)) for c in columns]
    true = [F.coalesce(c, F.lit(False)) for c in columns]
    return case_when([(false[0] | false[1] | false[2], False), (true[0] | true[1] | true[2], True)])


def passport_rules(submissions: DataFrame) -> DataFrame:
    """One row per passport and check, with the overall status."""
    return validate._long(passport_checks(submissions))
