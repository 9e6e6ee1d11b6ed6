"""Fixed lookup values: risk points, caps, thresholds, field policies, taxonomies.

Everything here is a small constant table. The ``*_frame`` helpers turn them into
DataFrames whose size is bounded by this file, which is why callers may broadcast them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Signal, the category of its evidence, and the points it adds at CRITICAL, HIGH, MEDIUM, LOW
# (None: not listed).
SIGNAL_POINTS = (
    ("mrz_unavailable", "DOCUMENT_STRUCTURE", 10.0, 8.0, 5.0, 2.0),
    ("mrz_structure_invalid", "DOCUMENT_STRUCTURE", None, 9.0, 5.0, 2.0),
    ("critical_field_unavailable", "DOCUMENT_STRUCTURE", None, 6.0, 3.0, 1.5),
    ("viz_mrz_document_number_mismatch", "DOCUMENT_CONSISTENCY", 20.0, 18.0, 10.0, None),
    ("viz_mrz_dob_mismatch", "DOCUMENT_CONSISTENCY", None, 15.0, 8.0, None),
    ("viz_mrz_name_mismatch", "DOCUMENT_CONSISTENCY", None, 10.0, 5.0, None),
    ("viz_mrz_consistency_failed", "DOCUMENT_CONSISTENCY", None, 12.0, 6.0, 2.0),
    ("document_number_binding_mismatch", "DOCUMENT_CONSISTENCY", 20.0, 18.0, 10.0, None),
    ("document_expired", "DOCUMENT_CONSISTENCY", None, 8.0, 4.0, None),
    ("visa_expired", "DOCUMENT_CONSISTENCY", None, 8.0, 4.0, None),
    ("license_expired", "DOCUMENT_CONSISTENCY", None, 8.0, 4.0, None),
    ("license_format_warning", "DOCUMENT_CONSISTENCY", None, None, 5.0, 2.0),
    ("license_registry_revoked", "DOCUMENT_CONSISTENCY", 22.0, None, None, None),
    ("driving_license_passport_dob_mismatch", "DOCUMENT_CONSISTENCY", None, 20.0, 10.0, None),
    ("driving_license_passport_name_mismatch", "DOCUMENT_CONSISTENCY", None, 15.0, 8.0, None),
    ("national_id_identifier_invalid", "DOCUMENT_CONSISTENCY", None, 12.0, 6.0, 2.0),
    ("national_id_identifier_warning", "DOCUMENT_CONSISTENCY", None, None, 5.0, 2.0),
    ("national_id_registry_revoked", "DOCUMENT_CONSISTENCY", 22.0, None, None, None),
    ("national_id_passport_dob_mismatch", "DOCUMENT_CONSISTENCY", None, 20.0, 10.0, None),
    ("national_id_passport_name_mismatch", "DOCUMENT_CONSISTENCY", None, 15.0, 8.0, None),
    ("national_id_dl_dob_mismatch", "DOCUMENT_CONSISTENCY", None, 20.0, 10.0, None),
    ("national_id_dl_name_mismatch", "DOCUMENT_CONSISTENCY", None, 15.0, 8.0, None),
    ("cross_document_mismatch", "DOCUMENT_CONSISTENCY", 20.0, 18.0, 10.0, None),
    ("visa_passport_number_mismatch", "DOCUMENT_CONSISTENCY", 20.0, 18.0, 10.0, None),
    ("cross_doc_identifier_binding_mismatch", "DOCUMENT_CONSISTENCY", 35.0, 32.0, 16.0, None),
    ("passport_visa_identifier_mismatch", "DOCUMENT_CONSISTENCY", 35.0, 32.0, 16.0, None),
    ("cross_doc_person_attribute_consistency_mismatch", "DOCUMENT_CONSISTENCY", 25.0, 20.0, 10.0, 4.0),
    ("cross_doc_person_name_consistency_mismatch", "DOCUMENT_CONSISTENCY", None, 15.0, 8.0, 3.0),
    ("cross_doc_person_name_consistency_partial_match", "DOCUMENT_CONSISTENCY", None, None, None, 2.0),
    ("cross_doc_nationality_field_consistency_mismatch", "DOCUMENT_CONSISTENCY", None, 12.0, 6.0, None),
    ("date_range_invalid", "DOCUMENT_INTEGRITY", 18.0, 14.0, 8.0, 3.0),
    ("passport_reference_invalid", "DOCUMENT_STRUCTURE", None, 10.0, 5.0, None),
    ("document_format_invalid", "DOCUMENT_STRUCTURE", None, 10.0, 5.0, None),
    ("visa_registry_revoked", "DOCUMENT_CONSISTENCY", 22.0, None, None, None),
    ("border_permit_expired", "DOCUMENT_CONSISTENCY", None, 10.0, 5.0, None),
    ("border_permit_not_yet_valid", "DOCUMENT_CONSISTENCY", None, None, 6.0, 2.0),
    ("border_permit_registry_revoked", "DOCUMENT_CONSISTENCY", 22.0, None, None, None),
    ("border_permit_registry_suspended", "DOCUMENT_CONSISTENCY", 18.0, 16.0, None, None),
    ("border_permit_registry_mismatch", "DOCUMENT_CONSISTENCY", 20.0, 18.0, None, None),
    ("border_permit_passport_number_mismatch", "DOCUMENT_CONSISTENCY", 35.0, 32.0, 16.0, None),
    ("border_permit_identifier_invalid", "DOCUMENT_CONSISTENCY", None, 10.0, 5.0, None),
    ("border_permit_date_invalid", "DOCUMENT_CONSISTENCY", None, 12.0, 6.0, None),
    ("document_number_checksum_fail", "DOCUMENT_INTEGRITY", None, 14.0, 8.0, 3.0),
    ("dob_checksum_fail", "DOCUMENT_INTEGRITY", None, 12.0, 6.0, 2.0),
    ("expiry_checksum_fail", "DOCUMENT_INTEGRITY", None, 10.0, 5.0, 2.0),
    ("composite_checksum_fail", "DOCUMENT_INTEGRITY", None, 14.0, 8.0, 3.0),
    ("identifier_checksum_fail", "DOCUMENT_INTEGRITY", None, 14.0, 8.0, 3.0),
    ("identifier_format_invalid", "DOCUMENT_STRUCTURE", None, None, 6.0, 2.0),
    ("qr_consistency_failed", "DOCUMENT_CONSISTENCY", None, 12.0, 6.0, None),
    ("forensic_high_concern", "FORENSIC_ANOMALY", 20.0, 16.0, 8.0, None),
    ("forensic_suspicious", "FORENSIC_ANOMALY", None, 12.0, 7.0, 3.0),
    ("forensic_ela_anomaly", "FORENSIC_ANOMALY", None, 10.0, 6.0, 2.0),
    ("forensic_compression_anomaly", "FORENSIC_ANOMALY", None, 8.0, 4.0, 1.5),
    ("forensic_photo_boundary_anomaly", "FORENSIC_ANOMALY", None, 10.0, 6.0, 2.0),
    ("forensic_metadata_anomaly", "FORENSIC_ANOMALY", None, 8.0, 4.0, 1.5),
    ("face_match_pass", "BIOMETRIC_CONSISTENCY", None, None, None, None),
    ("face_mismatch_high_quality", "BIOMETRIC_CONSISTENCY", 20.0, 17.0, 9.0, None),
    ("face_mismatch_poor_quality", "BIOMETRIC_CONSISTENCY", None, 10.0, 6.0, 3.0),
    ("face_detection_failed", "BIOMETRIC_CONSISTENCY", None, None, 6.0, 3.0),
    ("face_inconclusive", "BIOMETRIC_CONSISTENCY", None, None, 5.0, 2.0),
    ("presentation_attack_detected", "PRESENTATION_ATTACK", 20.0, 17.0, None, None),
    ("pad_inconclusive", "PRESENTATION_ATTACK", None, None, 5.0, 2.0),
    ("secondary_pad_anomaly", "PRESENTATION_ATTACK", None, 8.0, 4.0, 1.5),
    ("registry_matched", "REGISTRY_STATUS", None, None, None, None),
    ("registry_revoked", "REGISTRY_STATUS", 55.0, None, None, None),
    ("registry_mismatch", "REGISTRY_STATUS", 20.0, 18.0, None, None),
    ("registry_not_found", "REGISTRY_STATUS", None, 10.0, 6.0, 3.0),
    ("registry_expired", "REGISTRY_STATUS", None, 10.0, 5.0, None),
    ("registry_suspended", "REGISTRY_STATUS", 50.0, 16.0, None, None),
    ("registry_invalid", "REGISTRY_STATUS", 20.0, None, None, None),
    ("registry_ambiguous", "REGISTRY_STATUS", None, 8.0, 4.0, None),
    ("registry_field_mismatch", "REGISTRY_STATUS", None, 12.0, 6.0, None),
    ("qr_ocr_mismatch", "MACHINE_READABLE", 20.0, 18.0, 10.0, None),
    ("qr_ocr_docnumber_mismatch", "MACHINE_READABLE", 20.0, 18.0, 10.0, None),
    ("qr_ocr_dob_mismatch", "MACHINE_READABLE", None, 18.0, 10.0, None),
    ("qr_ocr_name_mismatch", "MACHINE_READABLE", None, 12.0, 6.0, None),
    ("qr_crypto_invalid", "MACHINE_READABLE", 25.0, 20.0, None, None),
    ("qr_crypto_verified", "MACHINE_READABLE", None, None, None, None),
    ("qr_crypto_unavailable", "MACHINE_READABLE", None, None, None, 0.0),
    ("qr_undecodable", "MACHINE_READABLE", None, None, 5.0, 2.0),
    ("qr_not_detected", "MACHINE_READABLE", None, None, None, 0.0),
    ("qr_payload_corrupted", "MACHINE_READABLE", None, 12.0, 6.0, None),
    ("qr_ocr_matched", "MACHINE_READABLE", None, None, None, None),
    ("machine_readable_unavailable", "MACHINE_READABLE", None, None, None, 0.0),
    ("cross_source_contradiction", "MACHINE_READABLE", 20.0, 15.0, 8.0, None),
    ("neural_tampering_detected", "FORENSIC_ANOMALY", 25.0, 20.0, 10.0, None),
    ("face_anti_spoof_failed", "PRESENTATION_ATTACK", 30.0, 25.0, None, None),
    ("face_mismatch", "BIOMETRIC_CONSISTENCY", None, 20.0, 10.0, None),
    ("module_not_run", "VERIFICATION_UNCERTAINTY", None, None, None, 3.0),
    ("module_unavailable", "VERIFICATION_UNCERTAINTY", None, None, None, 3.0),
    ("module_timeout", "VERIFICATION_UNCERTAINTY", None, None, None, 2.0),
    ("module_error", "VERIFICATION_UNCERTAINTY", None, None, 4.0, 2.0),
    ("ocr_low_confidence", "VERIFICATION_UNCERTAINTY", None, None, 5.0, 2.5),
    ("registry_provider_unavailable", "VERIFICATION_UNCERTAINTY", None, None, None, 2.0),
)

# Points for a signal or severity that has no cell above.
DEFAULT_POINTS = {"CRITICAL": 10.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 1.5}

# Most points one category may add, in reporting order.
CATEGORY_CAPS = {
    "DOCUMENT_STRUCTURE": 10.0,
    "DOCUMENT_CONSISTENCY": 20.0,
    "DOCUMENT_INTEGRITY": 20.0,
    "FORENSIC_ANOMALY": 20.0,
    "BIOMETRIC_CONSISTENCY": 20.0,
    "PRESENTATION_ATTACK": 20.0,
    "REGISTRY_STATUS": 55.0,
    "VERIFICATION_UNCERTAINTY": 10.0,
    "MACHINE_READABLE": 20.0,
}

# Advice text per level.
RECOMMENDATIONS = {
    "LOW": "STANDARD OFFICER REVIEW",
    "MEDIUM": "REVIEW REQUIRED",
    "HIGH": "HIGH PRIORITY REVIEW",
    "CRITICAL": "CRITICAL REVIEW REQUIRED",
    "INCONCLUSIVE": "INCONCLUSIVE - MANUAL REVIEW REQUIRED",
}

# Closed vocabularies, used by the data-quality assertions.
EVIDENCE_STATUSES = (
    "PASS FAIL WARNING SUSPICIOUS MATCH MISMATCH NOT_FOUND EXPIRED REVOKED SUSPENDED "
    "UNAVAILABLE TIMEOUT ERROR INCONCLUSIVE NOT_RUN"
).split()
SEVERITIES = "NONE LOW MEDIUM HIGH CRITICAL".split()
MODULES = "M1 M2 M3 M4 M5".split()  # M7 is expected only where it reported
OPTIONAL_MODULE = "M7"


def signal_points() -> list[tuple[str, str, str, float]]:
    """(signal, category, severity, points) for every listed cell."""
    cells = []
    for signal, category, *points in SIGNAL_POINTS:
        cells += [(signal, category, s, v) for s, v in zip(("CRITICAL", "HIGH", "MEDIUM", "LOW"), points, strict=True) if v is not None]
    return cells


def signal_categories() -> list[tuple[str, str]]:
    """(signal, category) in alphabetical order of the signal."""
    return sorted((signal, category) for signal, category, *_ in SIGNAL_POINTS)


@dataclass(frozen=True)
class RiskConfig:
    """Versioned scoring parameters; pass another instance to re-tune a run."""

    version: str = "0.6.0"
    caps: dict = field(default_factory=lambda: dict(CATEGORY_CAPS))
    # factor of the 1st, 2nd, 3rd strongest item of a correlation group; then the tail
    rank_factors: tuple = (1.0, 0.5, 0.25)
    tail_factor: float = 0.10
    confidence_steps: tuple = ((0.80, 1.0), (0.50, 0.85))
    confidence_floor: float = 0.60
    uncertain_below: float = 0.50
    levels: tuple = ((75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"))
    revoked_target: int = 85
    spoof_target: int = 80
    signature_target: int = 80


DEFAULT_RISK = RiskConfig()


def points_frame(spark: SparkSession) -> DataFrame:
    """The listed cells as an in-memory relation, whose size the planner knows."""
    cells = ", ".join(f"('{signal}', '{severity}', {points}D)" for signal, _, severity, points in signal_points())
    return spark.sql(f"SELECT * FROM VALUES {cells} AS p(signal, severity, points)")


# ---------------------------------------------------------------------------------------
# Identity vocabularies

# Accepted spellings of each document type, after trimming and lower-casing.
TYPE_ALIASES = {
    "passport": "passport", "visa": "visa",
    "drivinglicense": "driving_license", "driving_license": "driving_license",
    "aadhaar": "aadhaar", "aadhaarcard": "aadhaar", "uid": "aadhaar",
    "voter_id": "voter_id", "voterid": "voter_id", "epic": "voter_id", "voter": "voter_id",
    "pan_card": "pan_card", "pancard": "pan_card", "pan": "pan_card",
    "borderpermit": "border_permit", "border_permit": "border_permit",
    "national_id": "aadhaar", "nationalid": "aadhaar", "nid": "aadhaar",
}

# State codes and names; LEGACY_STATES are no longer issued.
STATE_NAMES = {
    "AN": "Andaman and Nicobar Islands",
    "AP": "Andhra Pradesh",
    "AR": "Arunachal Pradesh",
    "AS": "Assam",
    "BR": "Bihar",
    "CH": "Chandigarh",
    "CG": "Chhattisgarh",
    "DD": "Daman and Diu",
    "DH": "Dadra and Nagar Haveli and Daman and Diu",
    "DL": "Delhi",
    "DN": "Dadra and Nagar Haveli",
    "GA": "Goa",
    "GJ": "Gujarat",
    "HR": "Haryana",
    "HP": "Himachal Pradesh",
    "JK": "Jammu and Kashmir",
    "JH": "Jharkhand",
    "KA": "Karnataka",
    "KL": "Kerala",
    "LA": "Ladakh",
    "LD": "Lakshadweep",
    "MP": "Madhya Pradesh",
    "MH": "Maharashtra",
    "MN": "Manipur",
    "ML": "Meghalaya",
    "MZ": "Mizoram",
    "NL": "Nagaland",
    "OD": "Odisha",
    "OR": "Odisha",
    "PY": "Puducherry",
    "PB": "Punjab",
    "RJ": "Rajasthan",
    "SK": "Sikkim",
    "TN": "Tamil Nadu",
    "TS": "Telangana",
    "TG": "Telangana",
    "TR": "Tripura",
    "UP": "Uttar Pradesh",
    "UK": "Uttarakhand",
    "UA": "Uttarakhand",
    "WB": "West Bengal",
}
LEGACY_STATES = ("DD", "DN", "OR", "UA")
# Codes that stand for each other when two documents are compared.
STATE_PAIRS = ("OR=OD", "UA=UK", "TG=TS", "DD=DH", "DN=DH")

# Spelling of a vehicle class -> canonical class.
VEHICLE_CLASSES = {
    "MCWG": "MCWG", "M/CYCL.WG": "MCWG", "MC WITH GEAR": "MCWG",
    "MCWOG": "MCWOG", "M/CYCL.WOG": "MCWOG", "MC WITHOUT GEAR": "MCWOG",
    "LMV": "LMV", "LMV-NT": "LMV-NT", "LMVNT": "LMV-NT", "LMV-TR": "LMV-TR", "LMVTR": "LMV-TR",
    "TRANS": "TRANS", "HGMV": "HGMV", "HPMV": "HPMV", "HTV": "HTV", "HPV": "HPV", "HGV": "HGV",
    "MGV": "MGV", "MMV": "MMV", "MPV": "MPV",
    "3W-CAB": "3W-CAB", "3WCAB": "3W-CAB", "3W-NT": "3W-NT", "3WNT": "3W-NT",
    "3W-TR": "3W-TR", "3WTR": "3W-TR", "3W-GV": "3W-GV",
    "TRAILR": "TRAILR", "TRLR": "TRAILR",
    "E-RICKSHAW": "E-RICKSHAW", "E-CART": "E-CART", "ERICK": "E-RICKSHAW", "ECART": "E-CART",
    "PSV": "PSV", "INVCRG": "INVCRG", "LDRXCV": "LDRXCV", "TRACTOR": "TRACTOR",
}
VEHICLE_STOPWORDS = (
    "COV CLASS CLASSES VEHICLE VEHICLES AUTHORISATION AUTHORIZATION DRIVE OF TO VALID FROM DATE ISSUE"
).split()
TRANSPORT_CLASSES = "TRANS HGMV HPMV HTV HPV HGV MGV MMV MPV LMV-TR 3W-TR PSV".split()
# Minimum age per class; other recognised classes need DEFAULT_MIN_AGE.
CLASS_MIN_AGE = {
    "MCWOG": 16,
    "TRANS": 20, "HGMV": 20, "HPMV": 20, "HTV": 20, "HPV": 20, "HGV": 20, "MGV": 20, "MMV": 20, "MPV": 20,
    "LMV-TR": 20, "3W-TR": 20, "PSV": 20,
}
DEFAULT_MIN_AGE = 18
MAX_PLAUSIBLE_AGE = 110

BLOOD_GROUPS = "A+ A- B+ B- AB+ AB- O+ O- A1+ A1- A1B+ A1B- A2+ A2- A2B+ A2B-".split()

# Permit wording -> permit type.
PERMIT_TYPES = {
    "entry": "ENTRY", "entry permit": "ENTRY", "visitor": "ENTRY",
    "transit": "TRANSIT", "transit permit": "TRANSIT",
    "local": "LOCAL_BORDER", "local border": "LOCAL_BORDER", "local_border": "LOCAL_BORDER",
    "border crossing": "LOCAL_BORDER",
    "commercial": "COMMERCIAL", "crew": "COMMERCIAL",
    "special": "SPECIAL_ACCESS", "special access": "SPECIAL_ACCESS", "diplomatic": "SPECIAL_ACCESS",
}

# Holder category by the fourth character of a tax number.
PAN_CATEGORIES = {
    "P": "Individual / Person", "C": "Company", "H": "Hindu Undivided Family", "F": "Firm",
    "A": "Association of Persons", "T": "Trust", "B": "Body of Individuals", "L": "Local Authority",
    "J": "Artificial Juridical Person", "G": "Government",
}

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# ---------------------------------------------------------------------------------------
# Registry comparison

# Critical and secondary fields per document type; other types use passport.
CRITICAL_FIELDS = {
    "passport": "document_number date_of_birth name nationality",
    "visa": "document_number name nationality",
    "driving_license": "document_number date_of_birth name",
    "aadhaar": "document_number date_of_birth name",
    "voter_id": "document_number name",
    "pan_card": "document_number name",
    "national_id": "document_number date_of_birth name",
    "border_permit": "document_number name",
}
SECONDARY_FIELDS = {
    "passport": "expiry_date issuing_authority",
    "visa": "expiry_date issuing_authority",
    "driving_license": "expiry_date valid_from vehicle_classes issuing_authority state blood_group",
    "aadhaar": "issuing_authority",
    "voter_id": "date_of_birth issuing_authority",
    "pan_card": "date_of_birth issuing_authority",
    "national_id": "issuing_authority",
    "border_permit": "expiry_date issuing_authority",
}
# How each field is compared.
COMPARISON_METHODS = {
    "document_number": "normalized_identifier",
    "date_of_birth": "iso_date_equality",
    "expiry_date": "iso_date_equality",
    "valid_from": "iso_date_equality",
    "name": "token_normalized",
    "nationality": "iso_alpha3_equality",
    "vehicle_classes": "cov_taxonomy",
    "state": "state_code_registry",
    "issuing_authority": "case_insensitive",
    "blood_group": "case_insensitive",
}

# ---------------------------------------------------------------------------------------
# Relationships between the documents of one case

# Source type, target type, source field, target field, comparison, relationship, confidence,
# correlation group.
RELATIONSHIPS = (
    ("visa", "passport", "passport_number", "document_number", "STRICT", "IDENTIFIER_BINDING", 0.99, "DOCUMENT_NUMBER_BINDING"),
    ("visa", "passport", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, None),
    ("visa", "passport", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, None),
    ("visa", "passport", "nationality", "nationality", "NORMALIZED_CODE", "NATIONALITY_FIELD_CONSISTENCY", 0.98, None),
    ("driving_license", "passport", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, None),
    ("driving_license", "passport", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "DOB_CONSISTENCY"),
    ("national_id", "passport", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, "NID_PASSPORT_NAME_CONSISTENCY"),
    ("aadhaar", "passport", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, "NID_PASSPORT_NAME_CONSISTENCY"),
    ("voter_id", "passport", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, "NID_PASSPORT_NAME_CONSISTENCY"),
    ("pan_card", "passport", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, "NID_PASSPORT_NAME_CONSISTENCY"),
    ("national_id", "passport", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "NID_PASSPORT_DOB_CONSISTENCY"),
    ("aadhaar", "passport", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "NID_PASSPORT_DOB_CONSISTENCY"),
    ("voter_id", "passport", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "NID_PASSPORT_DOB_CONSISTENCY"),
    ("pan_card", "passport", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "NID_PASSPORT_DOB_CONSISTENCY"),
    ("national_id", "driving_license", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, None),
    ("aadhaar", "driving_license", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, None),
    ("voter_id", "driving_license", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, None),
    ("pan_card", "driving_license", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, None),
    ("national_id", "driving_license", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "NID_DL_DOB_CONSISTENCY"),
    ("aadhaar", "driving_license", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "NID_DL_DOB_CONSISTENCY"),
    ("voter_id", "driving_license", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "NID_DL_DOB_CONSISTENCY"),
    ("pan_card", "driving_license", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "NID_DL_DOB_CONSISTENCY"),
    ("border_permit", "passport", "passport_number", "document_number", "STRICT", "IDENTIFIER_BINDING", 0.99, "BORDER_PERMIT_PASSPORT_BINDING"),
    ("border_permit", "passport", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, "BORDER_PERMIT_PASSPORT_BINDING"),
    ("border_permit", "passport", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "BORDER_PERMIT_DOB_CONSISTENCY"),
    ("national_id", "border_permit", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, "BORDER_PERMIT_PASSPORT_BINDING"),
    ("aadhaar", "border_permit", "name", "name", "NORMALIZED_TOKEN_SET", "PERSON_NAME_CONSISTENCY", 0.95, "BORDER_PERMIT_PASSPORT_BINDING"),
    ("national_id", "border_permit", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "BORDER_PERMIT_DOB_CONSISTENCY"),
    ("aadhaar", "border_permit", "date_of_birth", "date_of_birth", "NORMALIZED_DATE", "PERSON_ATTRIBUTE_CONSISTENCY", 0.98, "BORDER_PERMIT_DOB_CONSISTENCY"),
)
CASE_TYPES = "passport visa driving_license national_id aadhaar voter_id pan_card border_permit".split()


def relationships() -> list[tuple]:
    """The rows of RELATIONSHIPS, each with its position among those of its pair of types."""
    rows, positions = [], {}
    for source, target, *rule in RELATIONSHIPS:
        position = positions[source, target] = positions.get((source, target), 0) + 1
        rows.append((source, target, *rule, position))
    return rows

# Registry outcomes that must be asked again and are never served from an earlier answer.
TRANSIENT_OUTCOMES = ("UNAVAILABLE", "TIMEOUT", "PROVIDER_ERROR", "RATE_LIMITED", "ERROR")

# Rules of the document profiles (type, rule, field, argument, severity).
PROFILE_RULES = (
    ("aadhaar", "required", "document_number", None, "critical"),
    ("aadhaar", "required", "name", None, "critical"),
    ("aadhaar", "pattern", "document_number", "[2-9][0-9]{11}", "critical"),
    ("aadhaar", "anchor", None, r"\bAADHAAR\b", None),
    ("aadhaar", "identifier", None, r"\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b", None),
    ("border_permit", "required", "document_number", None, "critical"),
    ("border_permit", "required", "name", None, "critical"),
    ("border_permit", "after", "expiry_date", "issue_date", "critical"),
    ("border_permit", "identifier", None, r"\bBP-?[0-9]{4}\b", None),
    ("driving_license", "required", "document_number", None, "critical"),
    ("driving_license", "required", "name", None, "critical"),
    ("driving_license", "required", "date_of_birth", None, "critical"),
    ("driving_license", "pattern", "document_number", "[A-Z]{2}[0-9]{2}(?:19|20)[0-9]{2}[0-9]{7}", "critical"),
    ("driving_license", "min_age", "date_of_birth", "18", "warning"),
    ("driving_license", "max_age", "date_of_birth", "110", "warning"),
    ("driving_license", "after", "expiry_date", "issue_date", "critical"),
    ("driving_license", "anchor", None, r"\bDRIVING\s+LICEN[CS]E\b", None),
    ("driving_license", "anchor", None, r"\bUNION\s+OF\s+INDIA\b", None),
    ("driving_license", "anchor", None, r"\bDL\s*NO\b", None),
    ("driving_license", "identifier", None, r"\b[A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{7}\b", None),
    ("driving_license", "statutory", None, "SARATHI", None),
    ("driving_license", "statutory", None, "TRANSPORT DEPARTMENT", None),
    ("driving_license", "token", None, "COV", None),
    ("driving_license", "token", None, "LMV", None),
    ("driving_license", "token", None, "MCWG", None),
    ("driving_license", "token", None, "VALIDITY", None),
    ("driving_license", "aspect", None, "1.58~0.25", None),
    ("pan_card", "required", "document_number", None, "critical"),
    ("pan_card", "pattern", "document_number", "[A-Z]{5}[0-9]{4}[A-Z]", "critical"),
    ("pan_card", "anchor", None, "INCOME TAX DEPARTMENT", None),
    ("passport", "required", "document_number", None, "critical"),
    ("passport", "required", "name", None, "critical"),
    ("passport", "pattern", "document_number", "[A-Z][0-9]{7}", "critical"),
    ("passport", "after", "expiry_date", "issue_date", "critical"),
    ("passport", "not_future", "date_of_birth", None, "critical"),
    ("passport", "anchor", None, "REPUBLIC OF INDIA", None),
    ("passport", "identifier", None, r"\bP<[A-Z]{3}", None),
    ("visa", "required", "document_number", None, "critical"),
    ("visa", "required", "name", None, "critical"),
    ("visa", "anchor", None, "ENTRY VISA", None),
    ("visa", "anchor", None, "CONSULAR", None),
    ("visa", "token", None, "VISA", None),
    ("visa", "token", None, "ENTRY", None),
    ("voter_id", "required", "document_number", None, "critical"),
    ("voter_id", "pattern", "document_number", "[A-Z]{3}[0-9]{7}", "critical"),
    ("voter_id", "anchor", None, "ELECTION COMMISSION", None),
    ("voter_id", "identifier", None, r"\b[A-Z]{3}[0-9]{7}\b", None),
)
