"""Module results -> evidence rows. Every module is one array expression, so the whole
normalisation is a projection and an explode: no join and no shuffle.

``module_results`` has one row per document: ``has_m1`` ... ``has_m7`` tell which module ran, the
other columns carry its result. Lists arrive as text, entries split by ``;`` and parts by ``:``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.functions.text import case_when
from attestry.operators import passport, registry, validate

SANDBOX_FACTOR = 0.70  # confidence of registry findings from a sandbox source


def item(
    module, signal, category, status, severity, confidence, group=None, available=True, positive=False, field=None
) -> Column:
    """One evidence row as a struct; plain values become literals."""

    def col(value, kind):
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return F.struct(
        col(module, "string").alias("module"), col(signal, "string").alias("signal"),
        col(category, "string").alias("category"), col(status, "string").alias("status"),
        col(severity, "string").alias("severity"), col(confidence, "double").alias("confidence"),
        F.lit(1.0).alias("quality"), col(available, "boolean").alias("available"),
        col(group, "string").alias("correlation_group"), col(positive, "boolean").alias("is_positive"),
        col(field, "string").alias("field"),
    )


def items(*pairs) -> Column:
    """Array of the structs whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, struct) for condition, struct in pairs]))


def entries(column: str) -> Column:
    """Entries of a list column as arrays of parts; NULL and blank give an empty list."""
    listed = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), ";"), lambda e: e != "")
    return F.transform(listed, lambda e: F.split(e, ":"))


def not_run(module: str, signal: str) -> Column:
    return F.array(item(module, signal, "VERIFICATION_UNCERTAINTY", "UNAVAILABLE", "LOW", 1.0, available=False))


def extraction_items() -> Column:
    confidence = F.coalesce("m1_confidence", F.lit(0.0))
    failed = F.coalesce(F.col("m1_status") == "failed", F.lit(False))
    missing = F.transform(
        entries("m1_missing"),
        lambda e: item(
            "M1", "critical_field_unavailable", "DOCUMENT_STRUCTURE", "FAIL", "MEDIUM", 0.90, "OCR_FIELD_AVAILABILITY",
            field=e[0],
        ),
    )
    found = items(
        (
            F.col("m1_low_regions") | (confidence < 0.65),
            item(
                "M1", "ocr_low_confidence", "VERIFICATION_UNCERTAINTY", "WARNING",
                F.when(confidence < 0.50, "MEDIUM").otherwise("LOW"), 0.95,
            ),
        ),
        (
            ~F.col("m1_mrz_detected") & F.col("m1_mrz_applicable"),
            item("M1", "mrz_unavailable", "DOCUMENT_STRUCTURE", "FAIL", "HIGH", 0.95),
        ),
    )
    error = F.array(item("M1", "ocr_unavailable", "VERIFICATION_UNCERTAINTY", "ERROR", "MEDIUM", 1.0, available=False))
    return (
        F.when(~F.col("has_m1"), not_run("M1", "ocr_unavailable")).when(failed, error).otherwise(F.concat(found, missing))
    )


# Check, condition, signal, category, status, severity, confidence, group.
CHECK_SIGNALS = [
    ("mrz_structure", "invalid", "mrz_structure_invalid", "DOCUMENT_STRUCTURE", "FAIL", "HIGH", 0.95, None),
    ("document_number_checksum", "invalid", "document_number_checksum_fail", "DOCUMENT_INTEGRITY", "FAIL", "HIGH", 0.90, None),
    ("dob_checksum", "invalid", "dob_checksum_fail", "DOCUMENT_INTEGRITY", "FAIL", "HIGH", 0.90, None),
    ("expiry_checksum", "invalid", "expiry_checksum_fail", "DOCUMENT_INTEGRITY", "FAIL", "MEDIUM", 0.90, None),
    ("composite_checksum", "invalid", "composite_checksum_fail", "DOCUMENT_INTEGRITY", "FAIL", "HIGH", 0.90, None),
    ("identifier_checksum", "failed", "identifier_checksum_fail", "DOCUMENT_INTEGRITY", "FAIL", "HIGH", 0.90, None),
    ("identifier_format", "known", "identifier_format_invalid", "DOCUMENT_STRUCTURE", "FAIL", "MEDIUM", 0.85, None),
    ("qr_consistency", "invalid", "qr_consistency_failed", "DOCUMENT_CONSISTENCY", "MISMATCH", "HIGH", 0.90, None),
    ("license_number_format", "invalid", "document_format_invalid", "DOCUMENT_STRUCTURE", "WARNING", "MEDIUM", 0.90, None),
    ("age_eligibility", "invalid", "date_range_invalid", "DOCUMENT_INTEGRITY", "FAIL", "HIGH", 0.90, None),
    ("validity_period", "invalid", "date_range_invalid", "DOCUMENT_INTEGRITY", "FAIL", "MEDIUM", 0.90, None),
    ("passport_binding", "invalid", "document_number_binding_mismatch", "DOCUMENT_CONSISTENCY", "MISMATCH", "HIGH", 0.90, "DOCUMENT_NUMBER_BINDING"),
    ("expiry_date", "expired", "document_expired", "DOCUMENT_CONSISTENCY", "EXPIRED", "HIGH", 0.99, None),
    ("passport_number_binding", "invalid", "document_number_binding_mismatch", "DOCUMENT_CONSISTENCY", "MISMATCH", "CRITICAL", 0.99, "DOCUMENT_NUMBER_BINDING"),
    ("viz_mrz_document_number", "invalid", "viz_mrz_document_number_mismatch", "DOCUMENT_CONSISTENCY", "MISMATCH", "HIGH", 0.95, "DOCUMENT_NUMBER_BINDING"),
    ("viz_mrz_date_of_birth", "invalid", "viz_mrz_dob_mismatch", "DOCUMENT_CONSISTENCY", "MISMATCH", "HIGH", 0.95, None),
    ("viz_mrz_name", "invalid", "viz_mrz_name_mismatch", "DOCUMENT_CONSISTENCY", "MISMATCH", "MEDIUM", 0.95, None),
    ("viz_mrz_other", "invalid", "viz_mrz_consistency_failed", "DOCUMENT_CONSISTENCY", "MISMATCH", "MEDIUM", 0.95, None),
    ("required_fields", "invalid", "critical_field_unavailable", "DOCUMENT_STRUCTURE", "FAIL", "HIGH", 0.95, None),
    ("date_chronology", "invalid", "date_range_invalid", "DOCUMENT_INTEGRITY", "FAIL", "HIGH", 0.95, None),
    ("visa_number_format", "invalid", "document_format_invalid", "DOCUMENT_STRUCTURE", "WARNING", "MEDIUM", 0.90, None),
    ("passport_reference", "invalid", "passport_reference_invalid", "DOCUMENT_STRUCTURE", "WARNING", "MEDIUM", 0.85, None),
    ("cross_document_passport", "invalid", "cross_document_mismatch", "DOCUMENT_CONSISTENCY", "MISMATCH", "CRITICAL", 0.98, None),
]


def validation_items(checks: Column) -> Column:
    """Evidence of failed checks in rule order. ``valid = false`` includes checks left unknown."""

    def fires(name: str, condition: str) -> Column:
        test = {
            "invalid": lambda c: ~c["valid"],
            "failed": lambda c: ~c["valid"] & (c["reason"] == "FAIL"),
            "known": lambda c: ~c["valid"] & (c["status"] != "unknown"),
            "expired": lambda c: c["reason"].isin("LICENSE_EXPIRED", "EXPIRED"),
        }[condition]
        return F.exists(checks, lambda c: F.coalesce((c["check_name"] == name) & test(c), F.lit(False)))

    return items(*[(fires(name, condition), item("M2", *rest)) for name, condition, *rest in CHECK_SIGNALS])


FORENSIC_SIGNALS = {
    "ela": "forensic_ela_anomaly",
    "compression": "forensic_compression_anomaly",
    "photo_boundary": "forensic_photo_boundary_anomaly",
    "metadata": "forensic_metadata_anomaly",
}


def forensic_items() -> Column:
    overall = F.col("m3_overall")

    def signal(e: Column) -> Column:
        kind, severity = e[0], F.get(e, F.lit(2))
        level = F.coalesce(text.lookup({"low": "LOW", "medium": "MEDIUM", "high": "HIGH"}, severity), F.lit("MEDIUM"))
        return item(
            "M3", F.coalesce(text.lookup(FORENSIC_SIGNALS, kind), F.lit("forensic_suspicious")), "FORENSIC_ANOMALY",
            "SUSPICIOUS", level, F.coalesce(F.get(e, F.lit(3)).try_cast("double"), F.lit(0.7)),
            F.when(kind.isin("ela", "compression", "metadata"), "FORENSIC_IMAGE_SIGNALS"),
        )

    signals = F.transform(F.filter(entries("m3_signals"), lambda e: F.get(e, F.lit(1)) == "suspicious"), signal)
    whole = items(
        (overall == "high_forensic_concern", item("M3", "forensic_high_concern", "FORENSIC_ANOMALY", "SUSPICIOUS", "HIGH", 0.80)),
        (overall == "suspicious", item("M3", "forensic_suspicious", "FORENSIC_ANOMALY", "SUSPICIOUS", "MEDIUM", 0.75)),
        (
            overall.isin("no_significant_anomaly", "clean", "passed"),
            item("M3", "forensic_clean", "FORENSIC_ANOMALY", "PASS", "NONE", 0.90, positive=True),
        ),
        (
            F.col("m3_model_hit"),
            item(
                "M3", "neural_tampering_detected", "FORENSIC_ANOMALY", "SUSPICIOUS", "CRITICAL",
                F.coalesce("m3_model_confidence", F.lit(0.85)), "FORENSIC_IMAGE_SIGNALS",
            ),
        ),
    )
    unclear = F.array(item("M3", "module_not_run", "VERIFICATION_UNCERTAINTY", "INCONCLUSIVE", "LOW", 1.0, available=False))
    return (
        F.when(~F.col("has_m3"), not_run("M3", "module_not_run"))
        .when(F.coalesce(overall, F.lit("insufficient_data")) == "insufficient_data", unclear)
        .otherwise(F.concat(signals, whole))
    )


def biometric_items() -> Column:
    good = (F.col("m4_document_quality") == "acceptable") & (F.col("m4_live_quality") == "acceptable")
    pad, score = F.col("m4_pad_status"), F.coalesce("m4_pad_score", F.lit(0.75))
    match, similarity = F.coalesce("m4_match", F.lit("unavailable")), F.coalesce("m4_similarity", F.lit(0.60))
    no_face = item("M4", "face_detection_failed", "BIOMETRIC_CONSISTENCY", "FAIL", "MEDIUM", 0.95, "BIOMETRIC_QUALITY")
    attack = "PRESENTATION_ATTACK"
    found = items(
        (~F.col("m4_document_face"), no_face),
        (~F.col("m4_live_face"), no_face),
        (
            pad == "suspected_spoof",
            item("M4", "presentation_attack_detected", attack, "SUSPICIOUS", "CRITICAL", score, "PRESENTATION_ATTACK_SIGNALS"),
        ),
        (pad.isin("pass", "live"), item("M4", "pad_pass", attack, "PASS", "NONE", score, positive=True)),
        (pad == "inconclusive", item("M4", "pad_inconclusive", attack, "INCONCLUSIVE", "LOW", 0.60)),
        (
            F.size(entries("m4_secondary_flags")) > 0,
            item("M4", "secondary_pad_anomaly", attack, "SUSPICIOUS", "MEDIUM", 0.70, "PRESENTATION_ATTACK_SIGNALS"),
        ),
        (
            match == "match",
            item(
                "M4", "face_match_pass", "BIOMETRIC_CONSISTENCY", "MATCH", "NONE",
                F.greatest(F.lit(0.70), F.least(F.lit(1.0), similarity)), positive=True,
            ),
        ),
        (
            match == "no_match",
            item(
                "M4", F.when(good, "face_mismatch_high_quality").otherwise("face_mismatch_poor_quality"),
                "BIOMETRIC_CONSISTENCY", "MISMATCH", F.when(good, "HIGH").otherwise("MEDIUM"), similarity,
                "FACE_IDENTITY_CONSISTENCY",
            ),
        ),
        (
            match.isin("inconclusive", "unavailable"),
            item("M4", "face_inconclusive", "BIOMETRIC_CONSISTENCY", "INCONCLUSIVE", "LOW", 0.70),
        ),
    )
    return F.when(~F.col("has_m4"), not_run("M4", "module_not_run")).otherwise(found)


# Provider outages and the signal each becomes; they are never fraud evidence.
OUTAGES = {
    "UNAVAILABLE": "registry_provider_unavailable", "TIMEOUT": "module_timeout", "AUTHENTICATION_ERROR": "module_error",
    "PROVIDER_ERROR": "module_error", "LIVE_PROVIDER_NOT_CONFIGURED": "registry_provider_unavailable",
    "UNCONFIGURED": "registry_provider_unavailable", "NOT_CONFIGURED": "registry_provider_unavailable",
}


def registry_items(status: Column, sandbox: Column, mismatched: Column) -> Column:
    """Evidence of one registry outcome; ``mismatched`` lists critical fields that differ, one row each.

    An outcome that is not known counts as an unavailable source.
    """
    status = F.coalesce(status, F.lit("UNAVAILABLE"))
    factor = F.when(sandbox, SANDBOX_FACTOR).otherwise(1.0)
    place = "REGISTRY_STATUS"
    outage = F.array(
        item(
            "M5", text.lookup(OUTAGES, status), "VERIFICATION_UNCERTAINTY",
            F.when(status == "TIMEOUT", "TIMEOUT").otherwise("UNAVAILABLE"),
            F.when(status.contains("NOT_CONFIGURED") | status.contains("UNCONFIGURED"), "NONE").otherwise("LOW"),
            1.0, available=False,
        )
    )
    fields = F.transform(
        mismatched,
        lambda f: item("M5", "registry_field_mismatch", place, "MISMATCH", "HIGH", 0.95 * factor, "REGISTRY_FIELD_MISMATCHES", field=f),
    )
    overall = items(
        (status == "MATCHED", item("M5", "registry_matched", place, "MATCH", "NONE", factor, positive=True)),
        (status == "REVOKED", item("M5", "registry_revoked", place, "REVOKED", "CRITICAL", 0.97, "REGISTRY_STATUS_SIGNALS")),
        (status == "SUSPENDED", item("M5", "registry_suspended", place, "SUSPENDED", "CRITICAL", 0.97, "REGISTRY_STATUS_SIGNALS")),
        (status == "INVALID", item("M5", "registry_invalid", place, "FAIL", "CRITICAL", 0.97 * factor)),
        (status == "MISMATCH", item("M5", "registry_mismatch", place, "MISMATCH", "HIGH", 0.95 * factor)),
        (status == "EXPIRED", item("M5", "registry_expired", place, "EXPIRED", "HIGH", 0.97 * factor)),
        (status == "NOT_FOUND", item("M5", "registry_not_found", place, "NOT_FOUND", "MEDIUM", 0.80 * factor)),
        (
            status.isin("AMBIGUOUS", "INCONCLUSIVE"),
            item("M5", "registry_ambiguous", place, "INCONCLUSIVE", "MEDIUM", 0.75 * factor),
        ),
    )
    return (
        F.when(status.isin(*OUTAGES), outage)
        .when(status == "MISMATCH", F.concat(overall, fields))
        .otherwise(overall)
    )


def payload_items() -> Column:
    place, crypto = "MACHINE_READABLE", F.col("m7_crypto_status")
    signature = items(
        (crypto == "CRYPTO_VERIFICATION_PASSED", item("M7", "qr_crypto_verified", place, "PASS", "NONE", 1.0, positive=True)),
        (
            crypto == "CRYPTO_VERIFICATION_FAILED",
            item("M7", "qr_crypto_invalid", place, "FAIL", "CRITICAL", 0.95, "MACHINE_READABLE_SIGNALS"),
        ),
        (
            crypto.isin(
                "CRYPTO_VERIFICATION_NOT_CONFIGURED", "CRYPTO_VERIFICATION_UNAVAILABLE", "CRYPTO_VERIFICATION_NOT_APPLICABLE"
            ),
            item("M7", "qr_crypto_unavailable", "VERIFICATION_UNCERTAINTY", "UNAVAILABLE", "NONE", 1.0, available=False),
        ),
    )

    def checked(e: Column) -> Column:
        name = F.lower(e[0])
        number = name.isin("docnumber", "document_number", "license_number")
        birth = name.isin("dob", "date_of_birth")
        mismatch = item(
            "M7", case_when([(number, "qr_ocr_docnumber_mismatch"), (birth, "qr_ocr_dob_mismatch")], "qr_ocr_mismatch"),
            place, "MISMATCH", F.when(number, "CRITICAL").otherwise("HIGH"), 0.92,
            F.when(birth, "DOB_CONSISTENCY").otherwise("MACHINE_READABLE_SIGNALS"), field=e[0],
        )
        match = item("M7", "qr_ocr_matched", place, "MATCH", "NONE", 0.95, positive=True, field=e[0])
        said = F.get(e, F.lit(1))
        return F.when(said == "QR_FIELD_MATCH", match).when(said == "QR_FIELD_MISMATCH", mismatch)

    fields = F.array_compact(F.transform(entries("m7_checks"), checked))
    found = F.coalesce("m7_detection", F.lit("NOT_DETECTED"))
    none = F.array().cast(
        "array<struct<module:string,signal:string,category:string,status:string,severity:string,confidence:double,"
        "quality:double,available:boolean,correlation_group:string,is_positive:boolean,field:string>>"
    )
    return (
        F.when(~F.col("has_m7"), none)
        .when(~F.coalesce("m7_applicable", F.lit(True)), none)
        .when(found == "NOT_DETECTED", F.array(item("M7", "qr_not_detected", place, "NOT_FOUND", "NONE", 0.90, available=False)))
        .when(
            found == "DETECTED_NOT_DECODABLE",
            F.array(item("M7", "qr_undecodable", place, "FAIL", "LOW", 0.85, "MACHINE_READABLE_SIGNALS")),
        )
        .otherwise(F.concat(signature, fields))
    )


def evidence_union(results: DataFrame) -> DataFrame:
    """All modules of every document in module order; ``item_seq`` is the order of emission."""
    mismatched = F.transform(entries("m5_mismatched"), lambda e: e[0])
    registry_part = F.when(~F.col("has_m5"), not_run("M5", "registry_provider_unavailable")).otherwise(
        registry_items(F.col("m5_status"), F.col("m5_sandbox"), mismatched)
    )
    checks = F.transform(
        entries("m2_failed"),
        lambda e: F.struct(
            e[0].alias("check_name"), F.get(e, F.lit(1)).alias("status"), F.lit(False).alias("valid"),
            F.get(e, F.lit(2)).alias("reason"),
        ),
    )
    validation_part = F.when(~F.col("has_m2"), not_run("M2", "module_not_run")).otherwise(validation_items(checks))
    everything = F.concat(
        extraction_items(), validation_part, forensic_items(), biometric_items(), registry_part, payload_items()
    )
    rows = results.select("case_id", F.posexplode(everything).alias("item_seq", "i"))
    return rows.select("case_id", F.col("item_seq").cast("long").alias("item_seq"), "i.*")


def evidence_from_registry(submissions: DataFrame, official: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Looks every submission up and emits its registry evidence (sandbox source)."""
    rows = registry.registry_outcomes(submissions, official, watchlist)
    differing = F.transform(
        F.filter("field_results", lambda f: f["is_critical"] & (f["status"] == "MISMATCH")), lambda f: f["field"]
    )
    emitted = registry_items(F.col("registry_status"), F.lit(True), differing)
    # a plain explode adds a filter that repeats the whole array expression; rows without an item drop out afterwards
    found = rows.select("verification_id", F.explode_outer(emitted).alias("i")).filter("i IS NOT NULL")
    return found.select("verification_id", "i.*").drop("quality")


def evidence_from_validation(submissions: DataFrame) -> DataFrame:
    """Evidence of the validation jobs of all document types."""
    jobs = [
        passport.passport_checks, validate.licence_checks, validate.visa_checks, validate.permit_checks, validate.national_id_checks,
        validate.pan_checks, validate.voter_checks,
    ]
    frames = [job(submissions) for job in jobs]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    # the outer form repeats no expression in a filter; documents without an item drop out afterwards
    emitted = rows.select("verification_id", F.explode_outer(validation_items(F.col("checks"))).alias("i")).filter("i IS NOT NULL")
    return emitted.select("verification_id", "i.*").drop("quality", "field")


# ---------------------------------------------------------------------------------------
# Ledger vocabulary

REGISTRY_PACKAGE = {
    "MATCHED": "VALID:INFO", "NOT_FOUND": "WARNING:MEDIUM", "EXPIRED": "WARNING:MEDIUM", "REVOKED": "SUSPICIOUS:CRITICAL",
    "SUSPENDED": "SUSPICIOUS:HIGH", "MISMATCH": "MISMATCH:HIGH", "TIMEOUT": "UNAVAILABLE:LOW", "UNAVAILABLE": "UNAVAILABLE:LOW",
}
RELATION_PACKAGE = {
    "MATCHED": "VALID:INFO", "PARTIAL_MATCH": "WARNING:MEDIUM", "MISMATCH": "MISMATCH:HIGH", "NOT_APPLICABLE": "INFO:INFO",
}
FORENSIC_PACKAGE = {
    "pass": "VALID:INFO", "clean": "VALID:INFO", "suspicious": "SUSPICIOUS:HIGH", "warning": "WARNING:MEDIUM",
    "tampered": "SUSPICIOUS:HIGH", "insufficient": "UNAVAILABLE:INFO",
}


def package_status(mapping: dict[str, str], value: Column, default: str = "INFO:INFO") -> Column:
    """struct<status, severity> of the coarser vocabulary the ledger stores."""
    pair = F.split(F.coalesce(text.lookup(mapping, value), F.lit(default)), ":")
    return F.struct(pair[0].alias("status"), pair[1].alias("severity"))


def module_package(results: DataFrame) -> DataFrame:
    """One ledger item per module that ran, in the coarser vocabulary."""
    read = F.col("m1_status") != "failed"
    matched = F.coalesce("m4_match", F.lit("pass")).isin("pass", "match", "matched")
    forensic = package_status(FORENSIC_PACKAGE, F.col("m3_overall"))
    official = package_status(REGISTRY_PACKAGE, F.col("m5_status"))

    def entry(module, signal, status, severity, confidence):
        return F.struct(
            F.lit(module).alias("module"), signal.alias("signal_type"), status.alias("status"), severity.alias("severity"),
            confidence.cast("double").alias("confidence"),
        )

    rows = items(
        (
            F.col("has_m1"),
            entry(
                "OCR", F.lit("ocr_text_extraction"), F.when(read, "VALID").otherwise("WARNING"),
                F.when(read, "INFO").otherwise("LOW"), F.coalesce("m1_confidence", F.lit(0.95)),
            ),
        ),
        (
            F.col("has_m3"),
            entry("FORENSICS", F.lit("forensic_tampering_analysis"), forensic["status"], forensic["severity"], F.lit(0.90)),
        ),
        (
            F.col("has_m4"),
            entry(
                "BIOMETRICS", F.lit("face_verification"), F.when(matched, "VALID").otherwise("MISMATCH"),
                F.when(matched, "INFO").otherwise("CRITICAL"), F.coalesce("m4_similarity", F.lit(0.92)),
            ),
        ),
        (
            F.col("has_m5"),
            entry(
                "REGISTRY", F.concat(F.lit("registry_"), F.lower("m5_status")), official["status"], official["severity"], F.lit(1.0)
            ),
        ),
    )
    return results.select("case_id", F.explode(rows).alias("i")).select("case_id", "i.*")


def case_package_items(documents: DataFrame, relations: DataFrame) -> DataFrame:
    """Ledger items of a case: one intake row per active document, one row per relationship."""
    intake = documents.select(
        "case_id", "document_id", "document_type", F.lit("CASE").alias("module"),
        F.lit("document_intake").alias("signal_type"), F.lit("VALID").alias("status"), F.lit("INFO").alias("severity"),
        F.lit(1.0).alias("confidence"), F.concat_ws("-", F.lit("INT"), "document_id").alias("evidence_id"),
    )
    pair = package_status(RELATION_PACKAGE, F.col("status"))
    number = F.lpad(F.col("position").cast("string"), 3, "0")
    related = relations.select(
        "case_id", F.col("source_id").alias("document_id"), F.col("source_type").alias("document_type"),
        F.lit("CROSS_DOCUMENT").alias("module"), F.lit("cross_doc_consistency").alias("signal_type"),
        pair["status"].alias("status"), pair["severity"].alias("severity"), "confidence",
        F.concat_ws("-", F.lit("XDC"), "source_id", "target_id", number).alias("evidence_id"),
    )
    return intake.unionByName(related)
