"""Standardising submissions: canonical columns, per-field status, profile, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import dims
from attestry.functions import dates, text
from attestry.functions.text import case_when

STATUS_FIELDS = ("document_number", "name", "date_of_birth", "nationality", "expiry_date", "issue_date", "blood_group")

# Other keys under which extractors deliver a canonical field.
FIELD_ALIASES = {
    "document_number": "document_number docNumber doc_number passport_number identity_number identityNumber "
    "permit_number permitNumber",
    "permit_number": "permit_number permitNumber docNumber doc_number",
    "passport_number": "passport_number passportNumber",
    "date_of_birth": "date_of_birth dob year_of_birth yearOfBirth",
    "year_of_birth": "year_of_birth yearOfBirth dob date_of_birth",
    "gender": "gender sex",
    "name": "name fullName full_name",
    "nationality": "nationality",
    "expiry_date": "expiry_date expiry expirationDate valid_to validTo",
    "issued_date": "issued_date issuedDate issueDate valid_from validFrom",
}


def canonical_field(values: Column, field: str) -> Column:
    """First non-blank value of a map column over the aliases of ``field``."""
    keys = FIELD_ALIASES.get(field, field).split()
    return F.coalesce(*[text.blank_to_null(text.stripped(values[k])) for k in keys])


def canonical_fields(df: DataFrame, values: str = "traveler_data") -> DataFrame:
    return df.select("*", *[canonical_field(F.col(values), f).alias(f) for f in FIELD_ALIASES])


def _by_type(kind: Column, rules: dict[str, Column], otherwise: Column) -> Column:
    return case_when([(kind == k, rule) for k, rule in rules.items()], otherwise)


def status_of(raw: Column, value: Column) -> Column:
    """UNKNOWN when nothing was read, INVALID when it was unusable, else whether it changed."""
    return case_when(
        [
            (text.is_blank(raw), "UNKNOWN"),
            (value.isNull(), "INVALID"),
            (value == raw, "UNCHANGED"),
        ],
        "NORMALIZED",
    )


def standardize_submissions(df: DataFrame) -> DataFrame:
    """Raw submissions -> canonical columns with a status per field. No shuffle.

    Values are computed in a projection of their own, so the statuses read finished columns
    instead of repeating the rules.
    """
    kind, number, born = F.col("kind"), F.col("document_number"), F.col("date_of_birth")
    typed = df.withColumn("kind", text.document_type(F.col("document_type")))
    numbers = {
        "driving_license": text.licence_number(number),
        "border_permit": text.permit_number(number),
        "aadhaar": text.national_id(number),
        "pan_card": text.pan_number(number),
        "voter_id": text.voter_number(number),
        "visa": text.visa_number(number),
    }
    names = {"border_permit": text.holder_name(F.col("name")), "visa": text.visa_text(F.col("name"))}

    def dated(value: Column, **more: Column) -> Column:
        rules = {
            "driving_license": dates.licence_date(value),
            "visa": dates.visa_date(value),
            "border_permit": dates.permit_date(value),
        }
        return _by_type(kind, {**rules, **more}, dates.lenient_date(value))

    values = {
        "document_number": _by_type(kind, numbers, text.document_number(number)),
        "name": _by_type(kind, names, text.person_name(F.col("name"))),
        "date_of_birth": dated(born, aadhaar=dates.full_birth_date(born)),
        "nationality": text.nationality(F.col("nationality")),
        "expiry_date": dated(F.col("expiry_date")),
        "issue_date": dated(F.col("issue_date")),
        "blood_group": text.blood_group(F.col("blood_group")),
    }
    staged = typed.withColumns(
        {
            **{f"std_{f}": value for f, value in values.items()},
            "id_error": F.when(kind == "aadhaar", text.national_id_error(number)),
            "classes": text.vehicle_class_items(F.col("vehicle_classes")),
        }
    )
    return staged.select(
        "verification_id",
        "case_id",
        kind.alias("document_type"),
        *[F.col(f"std_{f}").alias(f) for f in values],
        *[status_of(F.col(f), F.col(f"std_{f}")).alias(f"{f}_status") for f in values],
        text.masked(number).alias("document_number_masked"),
        dates.birth_year(born).alias("year_of_birth"),
        text.authority(F.col("issuing_authority")).alias("issuing_authority"),
        text.gender(F.col("gender")).alias("gender"),
        text.state_name(F.col("state")).alias("state_name"),
        text.state_status(F.col("state")).alias("state_status"),
        F.array_join(text.vehicle_classes(F.col("classes")), ",").alias("vehicle_classes"),
        F.array_join(text.unknown_vehicle_classes(F.col("classes")), ",").alias("unknown_vehicle_classes"),
        text.address(F.col("address")).alias("address"),
        text.permit_type(F.col("permit_type")).alias("permit_type"),
        text.entries(F.col("entries")).alias("entries"),
        text.visa_number(F.col("passport_number")).alias("passport_number"),
        case_when(
            [
                (kind == "border_permit", text.permit_number_ambiguous(number)),
                (kind == "aadhaar", F.coalesce(F.col("id_error") == "AMBIGUOUS_IDENTIFIER", F.lit(False))),
            ],
            False,
        ).alias("number_ambiguous"),
        F.col("id_error").alias("national_id_error"),
        F.when(kind == "pan_card", text.pan_category(F.col("std_document_number"))).alias("holder_category"),
    )


def standardization_profile(df: DataFrame) -> DataFrame:
    """Row count and invalid share per document type, field and status."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f"{f}_status").alias("status")) for f in STATUS_FIELDS]
        )
    )
    rows = standardize_submissions(df).select("document_type", pairs.alias("p")).select("document_type", "p.*")
    counts = rows.groupBy("document_type", "field", "status").count()
    totals = counts.groupBy("document_type", "field").agg(F.sum("count").alias("total"))
    # both sides hold one row per type, field and status: a bounded profile
    return counts.join(totals, ["document_type", "field"]).select(
        "document_type", "field", "status", F.col("count").alias("row_count"),
        F.round(F.col("count") / F.col("total"), 4).alias("share"),
    )


def identity_collisions(df: DataFrame, secret: str) -> DataFrame:
    """Numbers claimed under several names or birth dates, and people holding several numbers.

    The number or person leaves as a keyed hash under ``secret``.
    Repeated claims collapse before the shuffle; each distinct claim then counts once under
    its number and once under its person.
    """
    claims = (
        standardize_submissions(df)
        .select(
            "document_type", "document_number", "date_of_birth",
            F.array_join(text.name_tokens(F.col("name")), " ").alias("person"),
        )
        .distinct()
    )
    kind, number, person, born = (F.col(c) for c in ("document_type", "document_number", "person", "date_of_birth"))
    by_number = F.struct(
        F.lit("NUMBER").alias("kind"), F.concat(kind, F.lit(":"), number).alias("collision_key"),
        person.alias("name"), born.alias("birth"), F.lit("").alias("number"),
    )
    by_person = F.struct(
        F.lit("PERSON").alias("kind"), F.concat(kind, F.lit(":"), person, F.lit(":"), born).alias("collision_key"),
        F.lit("").alias("name"), F.lit("").alias("birth"), number.alias("number"),
    )
    return (
        claims.select(F.explode(F.array(by_number, by_person)).alias("c"))
        .select("c.*")
        .filter(F.col("collision_key").isNotNull())
        .groupBy("kind", "collision_key")
        .agg(
            F.countDistinct("name").alias("names"),
            F.countDistinct("birth").alias("birth_dates"),
            F.countDistinct("number").alias("numbers"),
        )
        .filter((F.col("names") > 1) | (F.col("birth_dates") > 1) | (F.col("numbers") > 1))
        .withColumn("collision_key", text.keyed_hash(F.col("collision_key"), secret))
    )


# a noncharacter, which texts for interchange never hold
APART = "\uffff"


def mask_document_text(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Masks every digit run of free text with twelve digits or more, keeping the last four digits.

    Single blanks or hyphens may stand between digits. Runs have no upper length; so that the pattern needs no
    repeated group over a whole run, doubled separators are kept apart by a character that no text has.
    """
    apart = F.regexp_replace(text_column, r"(?<=[ \-])(?=[ \-])", APART)
    masked = F.regexp_replace(apart, r"\d(?:[ \-]?\d){7}[\d \-]*(\d{4})\b", "XXXX XXXX $1")
    return df.select(
        id_column,
        F.regexp_count(apart, F.lit(r"\d(?:[ \-]?\d){11}(?:[\d \-]*\d)?\b")).alias("identifiers"),
        F.replace(masked, F.lit(APART), F.lit("")).alias("masked_text"),
    )


VOCABULARIES = {
    "status": dims.EVIDENCE_STATUSES,
    "severity": dims.SEVERITIES,
    "category": list(dims.CATEGORY_CAPS),
    "module": [*dims.MODULES, dims.OPTIONAL_MODULE],
    "signal": [signal for signal, _ in dims.signal_categories()],
}


def vocabulary_violations(evidence: DataFrame) -> DataFrame:
    """Counts of values outside the closed vocabularies of the evidence table."""
    checks = [
        F.when(~F.col(c).isin(*allowed), F.struct(F.lit(c).alias("field"), F.col(c).alias("value")))
        for c, allowed in VOCABULARIES.items()
    ]
    bad = F.filter(F.array(*checks), lambda v: v.isNotNull())
    return evidence.select(F.explode(bad).alias("v")).groupBy("v.field", "v.value").count()


def dedup_exact(documents: DataFrame, type_column: str, content_column: str, order_column: str) -> DataFrame:
    """First document per declared type and content hash, with the number of identical copies.

    Only ids and hashes are aggregated, and copies collapse before the shuffle.
    """
    key = F.concat_ws(":", F.lower(text.stripped(F.col(type_column))), F.sha2(content_column, 256))
    return documents.groupBy(key.alias("content_key")).agg(
        F.min(order_column).alias("first_id"), F.count("*").alias("copies")
    )
