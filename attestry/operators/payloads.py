"""Machine-readable payloads: layout detection, canonical fields, cross-check with printed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.functions.text import case_when

# Keys under which issuers encode a field.
PAYLOAD_ALIASES = {
    "license_number": "license_number lic_no lic_num dl_number dl_no dlno dlnum dl docnumber doc_no id_number dlnumber "
    "licensenumber lic_number license_no licenseno",
    "name": "name holder_name applicant_name licensee_name full_name fname customer_name holder licensee",
    "dob": "dob date_of_birth birth_date birthdate d_o_b birth dateofbirth",
    "valid_from": "valid_from issue_date issued_date issuedate doi from_date validfrom issue issued",
    "valid_to": "valid_to valid_till valid_upto expiry expiry_date validto validupto doe expirydate valid_until exp_date",
    "cov": "cov covs vehicle_classes vehicle_class class_of_vehicle cov_details classes vehicleclasses",
    "blood_group": "blood_group bg blood_grp bloodgroup",
    "address": "address addr permanent_address perm_addr residence",
    "issuing_authority": "issuing_authority authority rto rto_code issue_auth",
    "father_name": "father_name swd_name care_of co relation_name father_or_husband_name sdw_name",
}
SIGNATURE_KEYS = "signature sig digital_signature signed_hash".split()
CHECKED_FIELDS = "license_number name dob valid_from valid_to cov".split()
PAIR = "array<struct<key:string,value:string>>"


def _none() -> Column:
    return F.array().cast(PAIR)


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.cast("string").alias("key"), value.cast("string").alias("value"))


def _json_pairs(value: Column) -> Column:
    parsed = F.from_json(value, "map<string,string>")
    return F.transform(F.map_entries(parsed), lambda e: _pair(e["key"], e["value"]))


def _xml_pairs(value: Column) -> Column:
    """Root attributes, then child elements with text; a namespace prefix is dropped."""
    root = F.regexp_extract(value, r"^<([^>]*)>", 1)
    attribute, child = r'([\w.-]+)\s*=\s*"([^"]*)"', r"<(?:\w+:)?([\w.-]+)[^<>]*>([^<]+)</"

    def found(source: Column, pattern: str) -> Column:
        keys, values = (F.regexp_extract_all(source, F.lit(pattern), F.lit(g)) for g in (1, 2))
        return F.zip_with(keys, values, lambda k, v: _pair(k, text.stripped(v)))

    return F.concat(found(root, attribute), F.filter(found(value, child), lambda p: p["value"] != ""))


def _key_value_pairs(value: Column) -> Column:
    separator = case_when([(value.contains("|"), r"\|"), (value.contains(";"), ";")], "\n")
    tokens = F.split(value, separator)

    def pair(token: Column) -> Column:
        at = F.when(F.instr(token, ":") > 0, F.instr(token, ":")).otherwise(F.instr(token, "="))
        key = text.stripped(token.substr(F.lit(1), at - 1))
        rest = text.stripped(token.substr(at + 1, F.length(token)))
        return F.when((at > 0) & (key != ""), _pair(key, rest))

    return F.array_compact(F.transform(tokens, pair))


def _positional_pairs(value: Column) -> Column:
    """Number, name, then dates in the order birth, from, to; classes and a long text as address."""
    separator = F.when(value.contains("|"), r"\|").otherwise(";")
    slots = F.transform(F.split(value, separator), text.stripped)
    number = text.without(F.upper(F.get(slots, F.lit(0))), text.SPACES + "-_/")
    rest = F.slice(slots, 3, F.greatest(F.size(slots), F.lit(1)))
    date = r"^\d{2}[-/.]\d{2}[-/.]\d{4}$|^\d{4}[-/.]\d{2}[-/.]\d{2}$"
    dates = F.filter(rest, lambda t: t.rlike(date))
    others = F.filter(rest, lambda t: ~t.rlike(date))
    classes = F.filter(others, lambda t: F.upper(t).rlike("LMV|MCWG|MCWOG|TRANS|HGMV|3W"))
    places = F.filter(others, lambda t: ~F.upper(t).rlike("LMV|MCWG|MCWOG|TRANS|HGMV|3W") & (F.length(t) > 10))
    values = {
        "license_number": F.get(slots, F.lit(0)),
        "name": text.blank_to_null(F.get(slots, F.lit(1))),
        "dob": F.get(dates, F.lit(0)),
        "valid_from": F.get(dates, F.lit(1)),
        "valid_to": F.get(dates, F.lit(2)),
        "cov": F.get(classes, F.size(classes) - 1),
        "address": F.get(places, F.lit(0)),
    }
    pairs = F.array_compact(F.array(*[F.when(v.isNotNull(), _pair(F.lit(k), v)) for k, v in values.items()]))
    return F.when((F.size(slots) >= 3) & number.rlike(r"^[A-Z]{2}\d{11,16}$"), pairs)


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Adds ``payload_type``, ``signed`` and one column per canonical field (first non-empty alias wins)."""
    value = text.stripped(F.coalesce("payload", F.lit("")))
    staged = payloads.withColumn("_v", value)
    v = F.col("_v")
    kv_shape = v.rlike("[:=]") & v.rlike(r"[|;\n]")
    staged = staged.withColumns(
        {
            "_json": F.when(v.startswith("{") & v.endswith("}"), _json_pairs(v)),
            "_xml": F.when(v.rlike(r"(?s)^<([\w:.-]+)[^>]*>.*</\1>$"), _xml_pairs(v)),
            "_kv": F.when(v.rlike("[:=]"), _key_value_pairs(v)),
            "_pos": F.when(v.rlike("[|;]"), _positional_pairs(v)),
        }
    )

    def unsigned(pairs: Column) -> Column:
        return F.filter(pairs, lambda p: ~F.lower(p["key"]).isin(*SIGNATURE_KEYS))

    several = F.coalesce(kv_shape & (F.size(unsigned(F.col("_kv"))) > 1), F.lit(False))
    layouts = [
        (v == "", "CORRUPTED", _none()),
        (F.col("_json").isNotNull(), "JSON", F.col("_json")),
        (F.col("_xml").isNotNull(), "XML", F.col("_xml")),
        (several, "DELIMITED_KEY_VALUE", F.col("_kv")),
        (F.col("_pos").isNotNull(), "POSITIONAL_DELIMITED", F.col("_pos")),
        (F.coalesce(F.size(unsigned(F.col("_kv"))) > 0, F.lit(False)), "DELIMITED_KEY_VALUE", F.col("_kv")),
    ]
    staged = staged.withColumns(
        {
            "payload_type": case_when([(c, name) for c, name, _ in layouts], "PLAIN_TEXT"),
            "_pairs": case_when([(c, pairs) for c, _, pairs in layouts], _none()),
        }
    )
    aliases = {alias: field for field, names in PAYLOAD_ALIASES.items() for alias in names.split()}

    def canonical(p: Column) -> Column:
        key = F.translate(F.lower(text.stripped(p["key"])), "- ", "__")
        return _pair(text.lookup(aliases, key), p["value"])

    staged = staged.withColumn("_fields", F.transform(unsigned(F.col("_pairs")), canonical))

    def field(name: str) -> Column:
        named = F.filter("_fields", lambda p: p["key"] == name)
        filled = F.filter(named, lambda p: p["value"] != "")
        return F.coalesce(F.get(filled, F.lit(0))["value"], F.get(named, F.lit(0))["value"])

    signed = F.exists("_pairs", lambda p: F.lower(p["key"]).isin(*SIGNATURE_KEYS))
    return staged.select(
        *payloads.columns, "payload_type", signed.alias("signed"), *[field(f).alias(f) for f in PAYLOAD_ALIASES]
    )


def payload_fields(payloads: DataFrame) -> DataFrame:
    """Long form: one row per payload and canonical field."""
    cells = [
        F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f in PAYLOAD_ALIASES
    ]
    rows = parse_payloads(payloads).select(
        "doc_id", "payload_type", "signed", F.explode(F.array_compact(F.array(*cells))).alias("c")
    )
    return rows.select("doc_id", "payload_type", "signed", "c.*")


def flexible_date(value: Column) -> Column:
    """The eight numeric layouts accepted when payload and print are compared."""
    s = text.stripped(value)
    for pattern, target in (
        (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "$1-$2-$3"),
        (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "$3-$2-$1"),
    ):
        s = F.regexp_replace(s, pattern, target)
    compact = F.coalesce(F.try_to_date(s, "ddMMyyyy"), F.try_to_date(s, "yyyyMMdd"))
    return F.coalesce(F.try_to_date(s, "yyyy-M-d"), F.when(s.rlike(r"^\d{8}$"), compact))


def _class_set(value: Column) -> Column:
    tokens = F.transform(F.split(F.upper(value), "[,;/]+"), text.stripped)
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t != "")))


def payload_crosscheck(payloads: DataFrame, printed: DataFrame) -> DataFrame:
    """Per field status and overall status of every document that has a payload or printed fields.

    Both sides hold one row per document, so a full outer join on the document pairs all
    fields at once. A document without any payload field is NO_QR_DATA.
    """
    qr = parse_payloads(payloads).select(
        "doc_id", *[F.col(f).alias(f"qr_{f}") for f in CHECKED_FIELDS],
        F.coalesce(*[F.col(f) for f in PAYLOAD_ALIASES]).isNotNull().alias("has_qr"),
    )
    ocr = printed.select("doc_id", *[F.col(f).alias(f"ocr_{f}") for f in CHECKED_FIELDS])
    both = qr.join(ocr, "doc_id", "full_outer").withColumn("has_qr", F.coalesce("has_qr", F.lit(False)))

    def equal(field: str, a: Column, b: Column) -> Column:
        if field == "license_number":
            left, right = (text.without(F.upper(x), text.SPACES + "-_/") for x in (a, b))
            return (left != "") & (left == right)
        if field in ("dob", "valid_from", "valid_to"):
            left, right = flexible_date(a), flexible_date(b)
            return F.when(left.isNotNull() & right.isNotNull(), left == right).otherwise(text.stripped(a) == text.stripped(b))
        if field == "name":
            return F.upper(text.collapsed(a)) == F.upper(text.collapsed(b))
        left, right = _class_set(a), _class_set(b)
        return (F.size(left) > 0) & (left == right)

    cells = []
    for f in CHECKED_FIELDS:
        a, b = F.col(f"qr_{f}"), F.col(f"ocr_{f}")
        status = case_when(
            [
                (a.isNull() & b.isNull(), "QR_FIELD_UNAVAILABLE"),
                (a.isNull() | b.isNull(), "QR_FIELD_MISSING"),
                (F.coalesce(equal(f, a, b), F.lit(False)), "QR_FIELD_MATCH"),
            ],
            "QR_FIELD_MISMATCH",
        )
        cells.append(F.struct(F.lit(f).alias("field"), status.alias("status")))
    both = both.withColumn("results", F.array(*cells))

    def any_status(name: str) -> Column:
        return F.exists("results", lambda r: r["status"] == name)

    overall = case_when(
        [
            (~F.col("has_qr"), "NO_QR_DATA"),
            (any_status("QR_FIELD_MISMATCH"), "MISMATCH_DETECTED"),
            (any_status("QR_FIELD_MISSING"), "PARTIAL_MATCH"),
            (any_status("QR_FIELD_MATCH"), "ALL_MATCHED"),
        ],
        "NO_QR_DATA",
    )
    rows = both.withColumn("overall_status", overall).select("doc_id", "overall_status", F.explode("results").alias("r"))
    return rows.select("doc_id", "overall_status", "r.*")
