"""Named queries: each takes (spark, folder of given tables) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import dims
from attestry.operators import (
    card_payloads,
    conflicts,
    crossdoc,
    evidence,
    faces,
    freshness,
    gallery,
    ledger,
    pairing,
    passport,
    payloads,
    profiles,
    registry,
    risk,
    standardize,
    telemetry,
    validate,
)
from attestry.plans.fixtures import stream, table
from attestry.session import checkpointed
from attestry.sources import stores, tables
from attestry.streaming import cases, jobs, watermarks


def over(build, *inputs, **options):
    """A query that applies ``build`` to derived or given tables."""

    def query(spark, sf_dir):
        return build(*[table(spark, sf_dir, name) for name in inputs], **options)

    return query


def streamed(run, name, **options):
    """A streaming job over all available input: closed, open and late results."""

    def query(spark, sf_dir):
        return run(stream(spark, sf_dir, name), jobs.new_folder(spark, run.__name__), **options)

    return query


def registry_stream(spark, sf_dir):
    static = [table(spark, sf_dir, n) for n in ("registry", "watchlist")]
    return jobs.registry_stream(stream(spark, sf_dir, "submissions"), *static, jobs.new_folder(spark, "registry"))


def ledger_stream(spark, sf_dir):
    return jobs.ledger_stream(stream(spark, sf_dir, "ledger_events"), jobs.new_folder(spark, "ledger"))


def label_value_nearest(spark, sf_dir):
    # a field whose values are written V0 or V2
    return pairing.label_value_nearest(table(spark, sf_dir, "page_tokens"), F.col("text").rlike("^V[02]$"))


def case_stream(spark, sf_dir, expiry=None):
    arriving, evidence_rows = stream(spark, sf_dir, "case_documents"), table(spark, sf_dir, "document_evidence")
    found = cases.case_stream(arriving, evidence_rows, jobs.new_folder(spark, "cases"), expiry)
    return found if expiry else found.drop("state")


def case_stream_expiring(spark, sf_dir):
    return case_stream(spark, sf_dir, cases.EXPIRY_SECONDS)


def case_documents_reader(spark, sf_dir):
    """Case documents stored as JSON and read with the given schema."""
    path = jobs.new_folder(spark, "case-documents")
    table(spark, sf_dir, "case_documents").write.json(path)
    return tables.load_case_documents(spark, path, "json").select("case_id", "document_id", "document_type", "status")


def ledger_store(spark, sf_dir):
    """The ledger appended in two parts and read as a whole."""
    path, blocks = jobs.new_folder(spark, "ledger-store"), checkpointed(ledger.ledger_build(table(spark, sf_dir, "ledger_events")))
    for part in ("block_index <= 2", "block_index > 2"):
        stores.append_ledger(blocks.filter(part), path)
    return stores.read_ledger(spark, path).select("target_id", "block_index", "event_id", "block_hash")


def _stored_registry(spark, sf_dir):
    path = jobs.new_folder(spark, "registry-store")
    stores.write_registry(table(spark, sf_dir, "registry"), path, SAMPLE_SECRET, SAMPLE_CIPHER_KEY)
    return path


def registry_type_scan(spark, sf_dir):
    """Passport records of the protected store, decrypted."""
    found = stores.scan_registry_by_type(spark, _stored_registry(spark, sf_dir), "passport", SAMPLE_CIPHER_KEY)
    return found.select("record_id", "document_number", "name", "date_of_birth")


def registry_purge(spark, sf_dir):
    """What the protected store holds once all passports are purged."""
    path = _stored_registry(spark, sf_dir)
    stores.purge_registry_type(spark, [path], "passport")
    return spark.read.parquet(path).groupBy("document_type").agg(F.count("*").alias("records"))


REGISTRY_INPUTS = ("submissions", "registry", "watchlist")
# keys of the sample queries only; a deployment passes its own
SAMPLE_SECRET, SAMPLE_CIPHER_KEY = b"sample lookup secret", bytes(range(32))

QUERIES = {
    "standardize": over(standardize.standardize_submissions, "submissions"),
    "standardization_profile": over(standardize.standardization_profile, "submissions"),
    "identity_collisions": over(standardize.identity_collisions, "submissions", secret=SAMPLE_SECRET.decode()),
    "registry_lookup": over(registry.registry_lookup, *REGISTRY_INPUTS),
    "registry_not_found": over(registry.registry_not_found, *REGISTRY_INPUTS),
    "registry_ambiguous": over(registry.registry_ambiguous, *REGISTRY_INPUTS),
    "field_comparison": over(registry.field_comparison, *REGISTRY_INPUTS, secret=SAMPLE_SECRET.decode()),
    "registry_outcome": over(registry.registry_outcome, *REGISTRY_INPUTS),
    "protected_registry": over(
        registry.protected_roundtrip, "registry", secret=SAMPLE_SECRET, cipher_key=SAMPLE_CIPHER_KEY
    ),
    "licence_rules": over(validate.licence_rules, "submissions"),
    "passport_rules": over(passport.passport_rules, "submissions"),
    "visa_rules": over(validate.visa_rules, "submissions"),
    "permit_rules": over(validate.permit_rules, "submissions"),
    "identity_card_rules": over(validate.identity_card_rules, "submissions"),
    "mrz_audit": over(validate.mrz_audit, "submissions"),
    "check_digit_audit": over(validate.check_digit_audit, "submissions"),
    "verhoeff_audit": over(validate.verhoeff_audit, "submissions"),
    "validity_window": over(validate.validity_window, "submissions"),
    "text_routing_matrix": over(validate.text_routing_matrix, "text_routing"),
    "quality_score": over(validate.quality_score, "quality_metrics"),
    "forensic_vote": over(validate.forensic_vote, "forensic_votes"),
    "active_revisions": over(crossdoc.active_revisions, "case_documents"),
    "cross_document": over(crossdoc.cross_document, "case_documents"),
    "reference_check": over(crossdoc.reference_check, "case_documents"),
    "removed_evidence_purge": over(crossdoc.removed_evidence_purge, "case_documents"),
    "case_risk": over(crossdoc.case_risk, "case_documents", "document_evidence"),
    "conflicts": over(conflicts.conflicts, "evidence"),
    "contradictions": over(conflicts.contradictions, "evidence"),
    "evidence_union": over(evidence.evidence_union, "module_results"),
    "module_package": over(evidence.module_package, "module_results"),
    "case_package": over(crossdoc.case_package, "case_documents"),
    "evidence_from_registry": over(evidence.evidence_from_registry, *REGISTRY_INPUTS),
    "evidence_from_validation": over(evidence.evidence_from_validation, "submissions"),
    "ledger_build": over(ledger.ledger_build, "ledger_events"),
    "ledger_heads": over(ledger.ledger_head_report, "ledger_events"),
    "ledger_verify": over(ledger.ledger_verify_tampered, "ledger_events"),
    "integrity_report": over(ledger.integrity_of_events, "ledger_events"),
    "evidence_package_hash": over(ledger.evidence_package_hash, "evidence"),
    "risk_snapshot": over(ledger.risk_snapshot, "evidence"),
    "officer_decisions": over(ledger.officer_decisions, "ledger_events"),
    "viz_mrz_crosscheck": over(pairing.viz_mrz_crosscheck, "submissions"),
    "payload_fields": over(payloads.payload_fields, "payloads"),
    "payload_crosscheck": over(payloads.payload_crosscheck, "payloads", "printed_fields"),
    "card_payload_fields": over(card_payloads.card_payload_fields, "card_documents"),
    "card_payload_crosscheck": over(card_payloads.card_payload_crosscheck, "card_documents"),
    "payload_consistency": over(card_payloads.payload_consistency, "card_documents"),
    "label_value_pairs": over(pairing.label_value_pairs, "ocr_tokens"),
    "label_value_nearest": label_value_nearest,
    "field_candidates": over(pairing.field_candidates, "ocr_tokens"),
    "profile_checks": over(profiles.profile_checks, "submissions", rules=dims.PROFILE_RULES),
    "profile_signals": over(profiles.profile_signals, "page_texts", rules=dims.PROFILE_RULES),
    "pattern_signals": over(pairing.pattern_signals, "text_routing"),
    "face_verify": over(faces.face_verify, "face_pairs", "embeddings"),
    "face_verify_elevated": over(faces.face_verify_elevated, "face_pairs", "embeddings", "evidence"),
    "face_verify_fused": over(faces.face_verify_fused, "face_pairs", "embeddings"),
    "gallery_topk": over(gallery.gallery_topk, "embeddings"),
    "stage_latency": over(telemetry.stage_latency, "stage_events"),
    "stage_order": over(telemetry.stage_order, "stage_events"),
    "exact_dedup": over(
        standardize.dedup_exact, "documents", type_column="source", content_column="text", order_column="doc_id"
    ),
    "mask_identifiers": over(standardize.mask_document_text, "documents"),
    "vocabulary_violations": over(standardize.vocabulary_violations, "foreign_evidence"),
    "session_assembly": over(jobs.assemble_sessions, "module_updates"),
    "session_stream": streamed(watermarks.session_stream, "module_updates"),
    "registry_dedup": over(jobs.fresh_lookups, "lookups"),
    "registry_fresh": over(freshness.fresh_lookups, "lookups"),
    "registry_dedup_stream": streamed(watermarks.lookup_stream, "lookups"),
    "latency_stream": streamed(watermarks.latency_stream, "stage_events"),
    "latency_sliding": over(telemetry.sliding_latency, "stage_events"),
    "stage_order_stream": streamed(watermarks.stage_order_stream, "stage_events"),
    "registry_stream": registry_stream,
    "ledger_stream": ledger_stream,
    "case_documents_reader": case_documents_reader,
    "ledger_store": ledger_store,
    "registry_type_scan": registry_type_scan,
    "registry_purge": registry_purge,
    "case_stream": case_stream,
    "case_stream_expiring": case_stream_expiring,
    "risk_score": over(risk.risk_score, "evidence"),
    "risk_category_breakdown": over(risk.category_breakdown, "evidence"),
    "risk_override": over(risk.risk_override, "evidence"),
    "risk_top_contributors": over(risk.top_contributors, "evidence"),
    "risk_reasons": over(risk.risk_reasons, "evidence"),
    "risk_uncertainties": over(risk.uncertainties, "evidence"),
    "evidence_first_per_signal": over(risk.first_per_signal, "evidence"),
    "evidence_summary": over(risk.evidence_summary, "evidence"),
    "module_completeness": over(risk.module_completeness, "evidence"),
}
