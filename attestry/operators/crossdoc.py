"""Documents of one case: active revisions, pairwise comparison, case risk.

A case holds at most one active document per type. The latest revision of every type is
picked by one pre-aggregated grouping of the case, giving one row with a slot per type; all
pairs are then formed inside that row, so a case with very many revisions costs one
partial aggregate and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import dims
from attestry.dims import DEFAULT_RISK, RiskConfig
from attestry.functions import dates, text
from attestry.functions.text import case_when
from attestry.operators import risk
from attestry.operators.conflicts import case_flags, conflict_count
from attestry.operators.evidence import case_package_items
from attestry.operators.ranking import first_row
from attestry.operators.validate import computed_once
from attestry.session import checkpointed

IDENTITY = ["document_number", "passport_number", "name", "date_of_birth", "nationality"]
INACTIVE = ("REMOVED", "SUPERSEDED")


def active_documents(documents: DataFrame) -> DataFrame:
    """Latest active document per case and type with its revision number.

    The stored ``document_revision`` counts where the table has one; else superseded documents of the case and type
    count as earlier revisions, removed ones do not. NULL status is active.
    """
    kept = documents.withColumn("status", F.coalesce("status", F.lit("ACTIVE"))).filter("status <> 'REMOVED'")
    kept = kept.withColumn("document_type", text.document_type(F.col("document_type")))
    active = F.col("status") != "SUPERSEDED"
    stored = F.col("document_revision") if "document_revision" in documents.columns else F.lit(None)
    document = F.struct("document_id", "uploaded_at", *IDENTITY, stored.cast("long").alias("stored"))
    order = F.when(active, F.struct("uploaded_at", "document_id"))
    latest = kept.groupBy("case_id", "document_type").agg(
        F.max_by(F.when(active, document), order).alias("d"), F.count("*").alias("revisions")
    )
    return latest.filter("d IS NOT NULL").select(
        "case_id", "document_type", F.coalesce("d.stored", "revisions").alias("document_revision"),
        "d.document_id", "d.uploaded_at", *[f"d.{c}" for c in IDENTITY],
    )


def active_revisions(documents: DataFrame) -> DataFrame:
    return active_documents(documents).select("case_id", "document_type", "document_id", "document_revision")


def case_slots(documents: DataFrame, fields: list[str] = IDENTITY) -> DataFrame:
    """One row per case with the active document of each type as a struct, NULL when absent."""
    kind = text.document_type(F.col("document_type"))
    rows = documents.filter(~F.col("status").isin(*INACTIVE)).select(
        "case_id", kind.alias("kind"), F.struct("document_id", *fields).alias("d"),
        F.struct("uploaded_at", "document_id").alias("order"),
    )
    return rows.groupBy("case_id").agg(
        *[
            F.max_by(F.when(F.col("kind") == k, F.col("d")), F.when(F.col("kind") == k, F.col("order"))).alias(k)
            for k in dims.CASE_TYPES
        ]
    )


def _form(field: str, mode: str) -> str:
    return f"{field}_{mode.lower()}"


def with_forms(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """Documents with the comparable forms of their values, made once per document and not per pair, and the names of these."""
    wanted = sorted({(field, rule[4]) for rule in dims.relationships() for field in rule[2:4]})
    forms = {_form(field, mode): comparable(F.col(field), mode) for field, mode in wanted}
    return computed_once(documents, ["case_id", "document_id", "document_type", "status", "uploaded_at"], forms), list(forms)


def comparable(value: Column, mode: str) -> Column:
    """What a comparison mode makes of one value: ``=`` and its normal form, empty for a blank value, NULL where it has no form.

    Dates are marked ``y`` for a year alone and ``d`` for a day.
    """
    given = F.coalesce(text.stripped(value), F.lit(""))
    forms = {
        "STRICT": lambda v: text.letters_and_digits(v),
        "NORMALIZED_DATE": lambda v: F.when(v.rlike(r"^\d{4}$"), F.concat(F.lit("y"), v)).otherwise(F.concat(F.lit("d"), dates.lenient_date(v))),
        "NORMALIZED_TOKEN_SET": lambda v: F.array_join(text.name_tokens(v), " "),
        "NORMALIZED_CODE": lambda v: text.nationality(v),
    }
    return F.when(given == "", "").otherwise(F.concat(F.lit("="), forms.get(mode, F.upper)(given)))


def compare_forms(left: Column, right: Column, mode: Column) -> Column:
    """Status of one source/target pair of comparable forms under a comparison mode."""
    equal = F.when(F.coalesce(left == right, F.lit(False)), "MATCHED").otherwise("MISMATCH")
    unknown = left.isNull() | right.isNull()
    year_only = F.coalesce(left.startswith("=y"), F.lit(False)) | F.coalesce(right.startswith("=y"), F.lit(False))
    year = lambda form: F.when(form.startswith("=y"), F.substring(form, 3, 1 << 30)).otherwise(F.substring(form, 3, 4))
    left_names, right_names = (F.split(F.substring(form, 2, 1 << 30), " ") for form in (left, right))
    subset = (F.size(F.array_except(left_names, right_names)) == 0) | (
        F.size(F.array_except(right_names, left_names)) == 0
    )
    dated = case_when(
        [(unknown, "INCONCLUSIVE"), (year_only & (year(left) == year(right)), "CONSISTENT_YEAR"), (year_only, "MISMATCH")], equal
    )
    named = case_when([(unknown, "INCONCLUSIVE"), (left == right, "MATCHED"), (subset, "PARTIAL_MATCH")], "MISMATCH")
    return case_when(
        [
            ((left == "") & (right == ""), "UNAVAILABLE"),
            (left == "", "MISSING_SOURCE_FIELD"),
            (right == "", "MISSING_TARGET_FIELD"),
            (mode == "NORMALIZED_DATE", dated),
            (mode == "NORMALIZED_TOKEN_SET", named),
        ],
        equal,
    )


def status_severity(status: Column) -> Column:
    return case_when([(status == "MISMATCH", "HIGH"), (status.isin("PARTIAL_MATCH", "INCONCLUSIVE"), "LOW")], "NONE")


def relationships(documents: DataFrame) -> DataFrame:
    """One row per definition of every active document pair of a case."""
    pairs = []
    for source, target, left, right, mode, kind, confidence, group, position in dims.relationships():
        both = F.col(source).isNotNull() & F.col(target).isNotNull()
        pairs.append(
            F.when(
                both,
                F.struct(
                    F.lit(source).alias("source_type"), F.lit(target).alias("target_type"),
                    F.col(f"{source}.document_id").alias("source_id"), F.col(f"{target}.document_id").alias("target_id"),
                    F.lit(left).alias("source_field"), F.lit(right).alias("target_field"),
                    F.col(f"{source}.{_form(left, mode)}").alias("source_value"),
                    F.col(f"{target}.{_form(right, mode)}").alias("target_value"),
                    F.lit(mode).alias("mode"), F.lit(kind).alias("relationship_type"),
                    F.lit(confidence).alias("confidence"), F.lit(group).cast("string").alias("correlation_group"),
                    F.lit(position).alias("position"),
                ),
            )
        )
    # the outer form repeats no expression in a filter; cases without a pair drop out afterwards
    rows = case_slots(*with_forms(documents)).select("case_id", F.explode_outer(F.array_compact(F.array(*pairs))).alias("r"))
    rows = rows.filter("r IS NOT NULL").select("case_id", "r.*")
    rows = rows.withColumn("status", compare_forms(F.col("source_value"), F.col("target_value"), F.col("mode")))
    return rows.withColumn("severity", status_severity(F.col("status"))).drop("source_value", "target_value")


def cross_document(documents: DataFrame) -> DataFrame:
    """Relationship results without raw values."""
    rows = relationships(documents)
    number = F.lpad(F.col("position").cast("string"), 3, "0")
    return rows.select(
        "case_id", F.concat_ws("-", F.lit("XDC"), "source_id", "target_id", number).alias("evidence_id"),
        "source_type", "target_type", "source_field", "target_field", "relationship_type", "status", "severity", "confidence",
    )


def reference_check(documents: DataFrame, source: str = "visa", target: str = "passport") -> DataFrame:
    """Whether the passport number a document cites is that of the case's passport."""
    slots = case_slots(documents).filter(F.col(source).isNotNull())
    cited = text.letters_and_digits(F.col(f"{source}.passport_number"))
    actual = text.letters_and_digits(F.col(f"{target}.document_number"))
    status = case_when(
        [(F.coalesce(cited, F.lit("")) == "", "UNAVAILABLE"), (F.coalesce(actual, F.lit("")) == "", "UNAVAILABLE"), (cited == actual, "MATCHED")],
        "MISMATCHED",
    )
    return slots.select("case_id", F.col(f"{source}.document_id").alias("document_id"), status.alias("status"))


def removed_evidence_purge(documents: DataFrame) -> DataFrame:
    """Relationship rows of earlier pairings that still stand after removals and replacements.

    ``documents`` may carry stale rows: every document is paired with its case's latest
    passport ever uploaded, and pairs that touch an inactive document drop out.
    """
    every = documents.withColumn("status", F.lit("ACTIVE"))
    stale = relationships(every).select("case_id", "source_id", "target_id", "relationship_type", "status")
    gone = documents.filter(F.col("status").isin(*INACTIVE)).select("case_id", "document_id")
    return stale.join(gone.withColumnRenamed("document_id", "source_id"), ["case_id", "source_id"], "left_anti").join(
        gone.withColumnRenamed("document_id", "target_id"), ["case_id", "target_id"], "left_anti"
    )


def cross_document_evidence(relations: DataFrame) -> DataFrame:
    """Evidence rows for mismatches and partial matches."""
    rows = relations.filter(F.col("status").isin("MISMATCH", "PARTIAL_MATCH"))
    return rows.select(
        "case_id",
        F.struct(
            F.lit(1).alias("source"), F.concat_ws("-", "source_id", "target_id").alias("document"),
            F.col("position").cast("long").alias("seq"),
        ).alias("item_seq"),
        F.lit("CROSS_DOCUMENT").alias("module"),
        F.lower(F.concat_ws("_", F.lit("cross_doc"), "relationship_type", "status")).alias("signal"),
        F.lit("DOCUMENT_CONSISTENCY").alias("category"),
        F.when(F.col("status") == "MISMATCH", "MISMATCH").otherwise("WARNING").alias("status"),
        "severity", "confidence", F.lit(1.0).alias("quality"), F.lit(True).alias("available"), "correlation_group",
        F.lit(False).alias("is_positive"),
    )


def dedup_binding(evidence: DataFrame) -> DataFrame:
    """Keeps the first DOCUMENT_NUMBER_BINDING item per case and category, all else untouched."""
    bound = F.coalesce(F.col("correlation_group") == "DOCUMENT_NUMBER_BINDING", F.lit(False))
    first = first_row(evidence.filter(bound), ["case_id", "category"], [F.asc("item_seq")])
    return evidence.filter(~bound).unionByName(first)


def case_evidence(documents: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """Evidence of every active document plus the cross-document rows, keyed by case.

    ``evidence`` names the document it was raised for in ``document_id``.
    """
    active = active_documents(documents).select("case_id", "document_id")
    own = evidence.join(active, "document_id").withColumn(
        "item_seq", F.struct(F.lit(0).alias("source"), F.col("document_id").alias("document"), F.col("item_seq").alias("seq"))
    )
    columns = (
        "case_id item_seq module signal category status severity confidence quality available correlation_group is_positive"
    ).split()
    return own.select(*columns).unionByName(cross_document_evidence(relations).select(*columns))


def case_completeness(documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Mean completeness of the active documents of a case, 1.0 when none is active."""
    counts = risk.case_counts(evidence.withColumnRenamed("document_id", "case_id"))
    known = counts.select(F.col("case_id").alias("document_id"), risk.completeness().alias("part"))
    active = active_documents(documents).select("case_id", "document_id").join(known, "document_id", "left")
    means = active.groupBy("case_id").agg(
        risk.rounded(F.avg(F.coalesce("part", F.lit(0.0))), 2).alias("mean"), F.count("*").alias("documents_considered")
    )
    cases = documents.select("case_id").distinct()
    return cases.join(means, "case_id", "left").select(
        "case_id", F.coalesce("mean", F.lit(1.0)).alias("verification_completeness"),
        F.coalesce("documents_considered", F.lit(0)).alias("documents_considered"),
    )


def case_risk(documents: DataFrame, evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """Unified risk per case: no overrides and never INCONCLUSIVE.

    The relationships and the evidence of the cases feed several aggregations each, so both are
    written once instead of being joined anew for every use.
    """
    relations = checkpointed(relationships(documents))
    whole = checkpointed(case_evidence(documents, evidence, relations))
    merged = dedup_binding(whole)
    # evidence of inactive documents counts for no case, so that of the active ones is enough
    own = whole.filter("item_seq.source = 0").withColumn("document_id", F.col("item_seq.document")).drop("case_id")
    scores = risk.risk_score(merged, config).select("case_id", "risk_score")
    conflicts = case_flags(merged).select("case_id", conflict_count().alias("conflicts"))
    adverse = relations.groupBy("case_id").agg(
        F.count_if((F.col("status") == "MISMATCH") & F.col("severity").isin("HIGH", "CRITICAL")).alias("mismatches")
    )
    rows = (
        case_completeness(documents, own)
        .join(scores, "case_id", "left")
        .join(conflicts, "case_id", "left")
        .join(adverse, "case_id", "left")
        .withColumn("risk_score", F.coalesce("risk_score", F.lit(0)))
        .withColumn("risk_level", risk.risk_level(F.col("risk_score"), config))
    )
    found = F.coalesce("conflicts", F.lit(0)) + F.coalesce("mismatches", F.lit(0))
    return rows.select(
        "case_id", "risk_score", "risk_level", risk.recommendation(F.col("risk_level")).alias("officer_recommendation"),
        "documents_considered", "verification_completeness", (found > 0).alias("conflict_detected"),
    )


def case_package(documents: DataFrame) -> DataFrame:
    """Ledger items of every case: document intake and relationships."""
    return case_package_items(active_documents(documents), relationships(documents))
