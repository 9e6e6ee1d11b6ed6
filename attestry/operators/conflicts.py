"""Conflicting evidence per case. Conflicts are reported and never change a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import case_when

NUMBER_FAILURES = (
    "document_number_binding_mismatch", "viz_mrz_document_number_mismatch", "document_number_checksum_fail",
)
ADVERSE_REGISTRY = "REVOKED SUSPENDED MISMATCH NOT_FOUND EXPIRED INVALID AMBIGUOUS INCONCLUSIVE".split()


def _seen(condition: Column) -> Column:
    return F.coalesce(F.bool_or(F.col("available") & condition), F.lit(False))


def _qr_mismatch() -> Column:
    return (F.col("module") == "M7") & (F.col("signal").contains("mismatch") | (F.col("status") == "MISMATCH"))


def _qr_field() -> Column:
    signal = F.col("signal")
    return case_when([(signal.contains("dob"), "dob"), (signal.contains("docnumber"), "document_number")], "data_field")


def facts() -> dict[str, Column]:
    """Aggregates of one case's evidence that the conflict patterns are made of."""
    module, signal, status = F.col("module"), F.col("signal"), F.col("status")

    def sig(m: str, *signals: str) -> Column:
        return _seen((module == m) & signal.isin(*signals))

    def st(m: str, *statuses: str) -> Column:
        return _seen((module == m) & status.isin(*statuses))

    return {
        "m2": _seen(module == "M2"),
        "m4": _seen(module == "M4"),
        "m5": _seen(module == "M5"),
        "match_pass": sig("M4", "face_match_pass"),
        "face_adverse": sig("M4", "face_mismatch_high_quality", "face_mismatch_poor_quality", "presentation_attack_detected"),
        "attack": sig("M4", "presentation_attack_detected"),
        "blocked": st("M5", "REVOKED", "SUSPENDED", "MISMATCH"),
        "blocked_or_unknown": st("M5", "REVOKED", "MISMATCH", "SUSPENDED", "NOT_FOUND"),
        "registry_adverse": st("M5", *ADVERSE_REGISTRY),
        "registry_match": _seen((module == "M5") & ((status == "MATCHED") | (signal == "registry_matched"))),
        "registry_mismatch": sig("M5", "registry_field_mismatch", "registry_mismatch"),
        "number_failure": sig("M2", *NUMBER_FAILURES),
        "number_adverse": sig("M2", "document_number_checksum_fail", "document_number_binding_mismatch"),
        "high_concern": sig("M3", "forensic_high_concern"),
        "forensic": sig("M3", "forensic_high_concern", "forensic_suspicious"),
        "qr": _seen(_qr_mismatch()),
        "qr_items": F.count(F.when(F.col("available") & _qr_mismatch(), 1)),
        "qr_dob": _seen(_qr_mismatch() & (_qr_field() == "dob")),
        "dob_item": F.min(F.when(F.col("available") & signal.contains("dob_mismatch"), F.col("item_seq"))),
    }


def with_patterns(rows: DataFrame) -> DataFrame:
    """Adds the patterns c01-c06 to rows that hold ``facts``."""
    names = (
        "m2 m4 m5 match_pass face_adverse attack blocked blocked_or_unknown registry_adverse registry_match "
        "registry_mismatch number_failure number_adverse high_concern forensic qr"
    ).split()
    f = {n: F.col(n) for n in names}
    adverse = f["number_adverse"].cast("int") + f["forensic"].cast("int") + f["blocked_or_unknown"].cast("int")
    return rows.withColumns(
        {
            "c01": (f["match_pass"] | (~f["face_adverse"] & f["m4"])) & f["blocked"],
            "c02": ~f["number_failure"] & f["high_concern"] & f["m2"],
            "c03": ~f["number_failure"] & f["registry_mismatch"],
            "c04": f["attack"] & (f["registry_match"] | (f["m5"] & ~f["registry_adverse"])),
            "c05": adverse >= 2,
            "c06": f["qr"],
        }
    )


def case_flags(evidence: DataFrame) -> DataFrame:
    """One row per case with the facts and the patterns."""
    return with_patterns(evidence.groupBy("case_id").agg(*[c.alias(n) for n, c in facts().items()]))


def conflict_count() -> Column:
    return sum((F.col(f"c0{i}").cast("int") for i in range(1, 7)), F.lit(0))


def contradiction_count() -> Column:
    """Payload mismatches, the mirrored patterns and the birth date row."""
    dob = F.col("dob_item").isNotNull() & ~F.col("qr_dob")
    return F.col("qr_items") + sum((c.cast("long") for c in (F.col("c01"), F.col("c03"), F.col("c04"), dob)), F.lit(0))


def conflicts(evidence: DataFrame) -> DataFrame:
    """One row per active pattern with its severity and the modules involved."""
    involved = F.concat_ws(
        ",", F.when(F.col("number_adverse"), "M2"), F.when(F.col("forensic"), "M3"), F.when(F.col("blocked_or_unknown"), "M5")
    )
    patterns = [
        ("C-01", "c01", "high", F.lit("M4,M5")), ("C-02", "c02", "warning", F.lit("M2,M3")),
        ("C-03", "c03", "warning", F.lit("M2,M5")), ("C-04", "c04", "high", F.lit("M4,M5")),
        ("C-05", "c05", "high", involved), ("C-06", "c06", "high", F.lit("M1,M7")),
    ]
    cells = [
        F.when(
            F.col(flag),
            F.struct(F.lit(i).alias("conflict_id"), F.lit(severity).alias("severity"), modules.alias("modules_involved")),
        )
        for i, flag, severity, modules in patterns
    ]
    rows = case_flags(evidence).select("case_id", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return rows.select("case_id", "c.*")


def contradictions(evidence: DataFrame) -> DataFrame:
    """Field-level contradictions: one per payload mismatch, mirrors of C-01, C-03 and C-04, one birth date row."""
    field = _qr_field()
    payload = evidence.filter(F.col("available") & _qr_mismatch()).select(
        "case_id", field.alias("field"), F.lit("ocr,m7_qr").alias("sources"),
        F.when(field.isin("dob", "document_number"), "CRITICAL").otherwise("HIGH").alias("severity"), "item_seq",
    )
    rules = [
        ("c01", "identity_status", "m4_biometrics,m5_registry", "CRITICAL"),
        ("c03", "document_number", "m2_validation,m5_registry", "HIGH"),
        ("c04", "liveness_vs_registry", "m4_biometrics,m5_registry", "HIGH"),
        ("dob", "dob", "ocr_viz,ocr_mrz_or_secondary", "HIGH"),
    ]
    flags = case_flags(evidence).withColumn("dob", F.col("dob_item").isNotNull() & ~F.col("qr_dob"))
    cells = [
        F.when(
            F.col(flag),
            F.struct(
                F.lit(name).alias("field"), F.lit(sources).alias("sources"), F.lit(severity).alias("severity"),
                F.when(F.lit(flag == "dob"), F.col("dob_item")).alias("item_seq"),
            ),
        )
        for flag, name, sources, severity in rules
    ]
    mirrored = flags.select("case_id", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("case_id", "c.*")
    return payload.unionByName(mirrored)
