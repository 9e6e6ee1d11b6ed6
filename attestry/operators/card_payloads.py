"""Payloads of border permits and national identity cards: layouts, fields, comparison with the print.

A payload is read into key/value pairs by the first layout that fits it, then every field takes the first of its keys
that holds a value (of a repeated key the last one). A decoded payload says nothing about authenticity. Defined
results: no or blank payload -> no fields and the family's status for it; unreadable payloads keep one row and no
field; documents of other types are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import dates, text
from attestry.functions.text import case_when
from attestry.operators.payloads import PAIR
from attestry.operators.validate import computed_once

# Keys of each field in order; "=" marks keys of delimited text and "@" attributes of the card's own element.
PERMIT_KEYS = {
    "number": ("permit_number", "permitNo", "docNumber", "=BP", "=PERMIT", "=DOCNUMBER"),
    "name": ("name", "holder_name", "=NAME", "=HOLDER"),
    "date_of_birth": ("dob", "date_of_birth", "=DOB"),
    "passport_number": ("passport_number", "passportNo", "passportNumber", "=PPT", "=PASSPORT", "=PASSPORTNUMBER"),
    "valid_from": ("valid_from", "validFrom", "=FROM", "=VALIDFROM"),
    "valid_to": ("valid_to", "validTo", "expiry", "=TO", "=VALIDTO", "=EXPIRY"),
    "permit_type": ("permit_type", "type"),
}
CARD_KEYS = {
    "number": ("uid", "identity_number", "id", "@uid", "=UID", "=ID", "=AADHAAR"),
    "name": ("name", "@name", "=NAME"),
    "date_of_birth": ("dob", "@dob", "=DOB"),
    "year_of_birth": ("@yob",),
    "gender": ("gender", "@gender", "=GENDER"),
    "address": ("address",),
}
ADDRESS_PARTS = ("@co", "@house", "@loc", "@vtc", "@dist", "@state", "@pc")
FIELDS = tuple(dict.fromkeys([*PERMIT_KEYS, *CARD_KEYS]))
COMPARED = ("number", "name", "passport_number")
DECODED = "PAYLOAD_DECODED"
# keys start where their run of letters starts, so a very long run is read once
ATTRIBUTE = r"""(?<![\w.-])([\w.-]++)\s*+=\s*(?:"([^"]*)"|'([^']*)')"""
# one element whose start tag holds attributes only, closed by itself or by its own end tag
ELEMENT = r"""(?s)^<([\w:.-]+)(?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*(?:/>|>.*</\1\s*>)$"""
DELIMITED = r"(?i)(?<![A-Z_])([A-Z_]++)\s*+[:=]\s*([^|;\n\r]+)"


def _zipped(keys: Column, values: Column) -> Column:
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), text.stripped(v).alias("value")))


def _all(source: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(group))


def _object(value: Column) -> Column:
    return F.transform(
        F.map_entries(F.from_json(value, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    )


def _attributes(source: Column, mark: str = "") -> Column:
    values = F.zip_with(_all(source, ATTRIBUTE, 2), _all(source, ATTRIBUTE, 3), lambda a, b: F.concat(a, b))
    keys = _all(source, ATTRIBUTE, 1)
    return _zipped(F.transform(keys, lambda k: F.concat(F.lit(mark), F.lower(k))) if mark else keys, values)


def _delimited(value: Column) -> Column:
    return _zipped(F.transform(_all(value, DELIMITED, 1), lambda k: F.concat(F.lit("="), F.upper(k))), _all(value, DELIMITED, 2))


def _coloned(value: Column) -> Column:
    """Parts between bars, cut at their first colon."""
    parts = F.filter(F.split(value, r"\|"), lambda p: p.contains(":"))
    keys = F.transform(parts, lambda p: F.concat(F.lit("="), F.upper(text.stripped(F.substring_index(p, ":", 1)))))
    return _zipped(keys, F.transform(parts, lambda p: p.substr(F.instr(p, ":") + 1, F.length(p))))


def _pairs(kind: Column, value: Column) -> tuple[Column, Column]:
    """Layout and pairs of a payload; layout NULL when none fits."""
    permit, v = kind == "border_permit", value
    braced = v.startswith("{") & v.endswith("}")
    known = F.lit([k for keys in CARD_KEYS.values() for k in keys if k.startswith("=")])
    keyed = F.exists(_coloned(v), lambda p: F.array_contains(known, p["key"]))
    layouts = [
        (v == "", None, None),
        (permit & braced & _object(v).isNotNull(), "JSON", _object(v)),
        (permit & v.rlike(ELEMENT), "XML", _attributes(F.regexp_extract(v, "^<[^>]*>", 0))),
        (permit & v.rlike(DELIMITED), "DELIMITED", _delimited(v)),
        (permit, None, None),
        (v.contains("<PrintLetterBarcodeData") | v.contains("uid="), "XML", _attributes(v, "@")),
        (_object(v).isNotNull(), "JSON", _object(v)),
        (keyed, "DELIMITED", _coloned(v)),
    ]
    layout = case_when([(c, name) for c, name, _ in layouts], F.lit(None).cast("string"))
    none = F.array().cast(PAIR)
    return layout, case_when([(c, none if pairs is None else pairs) for c, _, pairs in layouts], none)


def _first_of(keys: tuple) -> Column:
    def last(key: str) -> Column:
        return F.try_element_at(F.filter("_pairs", lambda p: p["key"] == key), F.lit(-1))["value"]

    return F.coalesce(*[text.blank_to_null(text.stripped(last(k))) for k in keys])


def parse_card_payloads(documents: DataFrame) -> DataFrame:
    """Permits and national ids with ``document_type``, ``layout``, ``payload_status`` and a struct ``fields``."""
    kind = text.document_type(F.col("document_type"))
    typed = documents.withColumn("document_type", kind).filter(F.col("document_type").isin("border_permit", "aadhaar"))
    value = text.stripped(F.coalesce("payload", F.lit("")))
    rows = computed_once(typed, typed.columns, {"_value": value})
    layout, pairs = _pairs(F.col("document_type"), F.col("_value"))
    rows = computed_once(rows, [*typed.columns, "_value"], {"layout": layout, "_pairs": pairs})
    permit = F.col("document_type") == "border_permit"

    def field(name: str) -> Column:
        found = {}
        for family, keys in (("border_permit", PERMIT_KEYS), ("aadhaar", CARD_KEYS)):
            found[family] = _first_of(keys[name]) if name in keys else F.lit(None).cast("string")
        p, c = found["border_permit"], found["aadhaar"]
        if name == "number":
            p, c = text.permit_number(p), text.national_id(c)
        elif name == "name":
            p, c = text.holder_name(p), F.upper(c)
        elif name in ("date_of_birth", "valid_from", "valid_to"):
            p = dates.permit_date(p)
        elif name == "year_of_birth":
            c = F.when(c.rlike(r"^\d{1,9}$"), c.cast("int").cast("string"))
        elif name == "gender":
            said = F.upper(c)
            c = case_when([(said.isin("M", "MALE"), "MALE"), (said.isin("F", "FEMALE"), "FEMALE")], said)
        elif name == "address":
            parts = text.blank_to_null(F.array_join(F.array_compact(F.array(*[_first_of((k,)) for k in ADDRESS_PARTS])), ", "))
            c = F.when(F.col("layout") == "XML", parts).otherwise(c)
        return F.when(permit, p).otherwise(c).alias(name)

    status = case_when(
        [
            (F.col("layout").isNotNull(), DECODED),
            (F.col("_value") == "", F.when(permit, "absent").otherwise("NOT_FOUND")),
            (permit, "MALFORMED_PAYLOAD"),
        ],
        "PAYLOAD_MALFORMED",
    )
    return computed_once(rows, [*typed.columns, "layout"], {"payload_status": status, "fields": F.struct(*[field(f) for f in FIELDS])})


def card_payload_fields(documents: DataFrame) -> DataFrame:
    """Long form: one row per document and field; documents without any field keep one row with none."""
    cells = [F.when(F.col(f"fields.{f}").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"fields.{f}").alias("value"))) for f in FIELDS]
    rows = parse_card_payloads(documents).select(
        "verification_id", "document_type", "layout", "payload_status", F.explode_outer(F.array_compact(F.array(*cells))).alias("c")
    )
    return rows.select("verification_id", "document_type", "layout", "payload_status", "c.*")


def _tokens(value: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(_all(value, pattern, 0)))


def compare_card_payloads(documents: DataFrame) -> DataFrame:
    """Adds ``compared`` (array of field and status) and ``overall`` to the parsed payloads.

    A field is compared where both sides hold it. Permit names may contain one another, card names may hold
    further words.
    """
    permit = F.col("document_type") == "border_permit"
    printed = {
        "number": F.when(permit, text.permit_number(F.col("document_number"))).otherwise(text.national_id(F.col("document_number"))),
        "name": F.when(permit, text.holder_name(F.col("name"))).otherwise(F.upper(text.blank_to_null(text.stripped(F.col("name"))))),
        "passport_number": text.blank_to_null(F.upper(text.stripped(F.col("passport_number")))),
    }
    parsed = parse_card_payloads(documents)
    rows = computed_once(parsed, parsed.columns, {"printed": F.struct(*[c.alias(f) for f, c in printed.items()])})
    a, b = F.col("printed.name"), F.col("fields.name")
    held = (_tokens(a, r"\S+") == _tokens(b, r"\S+")) | a.contains(b) | b.contains(a)
    left, right = _tokens(a, r"\w+"), _tokens(b, r"\w+")
    within = (F.size(left) > 0) & (F.size(right) > 0) & ((F.size(F.array_except(left, right)) == 0) | (F.size(F.array_except(right, left)) == 0))
    same = {
        "number": F.col("printed.number") == F.col("fields.number"),
        "name": F.when(permit, held).otherwise(within),
        "passport_number": F.col("printed.passport_number") == F.upper(F.col("fields.passport_number")),
    }
    entries = [
        F.when(
            F.col(f"printed.{f}").isNotNull() & F.col(f"fields.{f}").isNotNull(),
            F.struct(F.lit(f).alias("field"), F.when(same[f], "MATCHED").otherwise("MISMATCH").alias("status")),
        )
        for f in COMPARED
    ]
    rows = computed_once(rows, parsed.columns, {"compared": F.array_compact(F.array(*entries))})
    overall = case_when(
        [
            (F.col("layout").isNull(), F.when(permit, "NOT_AVAILABLE").otherwise("NOT_APPLICABLE")),
            (F.exists("compared", lambda e: e["status"] == "MISMATCH"), "MISMATCH"),
            (permit | (F.size("compared") > 0), "MATCHED"),
        ],
        "INCONCLUSIVE",
    )
    return rows.withColumn("overall", overall)


def card_payload_crosscheck(documents: DataFrame) -> DataFrame:
    """One row per compared field with the document's overall result; documents without one keep one row."""
    rows = compare_card_payloads(documents).select("verification_id", "document_type", "overall", F.explode_outer("compared").alias("c"))
    return rows.select("verification_id", "document_type", "c.*", "overall")


def payload_consistency(documents: DataFrame) -> DataFrame:
    """The payload check of the permit and card rules, in the form of their other checks."""
    permit, overall = F.col("document_type") == "border_permit", F.col("overall")
    absent = F.coalesce(F.col("payload"), F.lit("")) == ""
    status = case_when(
        [
            (absent, "not_applicable"),
            (overall == "MATCHED", "passed"),
            (overall == "MISMATCH", "failed"),
            (permit, "warning"),
        ],
        "inconclusive",
    )
    rows = compare_card_payloads(documents).select("verification_id", "document_type", status.alias("status"), permit.alias("_permit"))
    failed = F.col("status") == "failed"
    return rows.select(
        "verification_id", "document_type", F.lit("qr_consistency").alias("check_name"), "status",
        (~F.col("status").isin("failed", "warning")).alias("valid"),
        F.when(failed, "high").alias("severity"), F.when(failed, "QR_OCR_MISMATCH").alias("reason"),
    )


def with_payload_check(checked: DataFrame, documents: DataFrame) -> DataFrame:
    """Checks of permits or national ids (one array per document) with the payload check and the roll-up that includes it."""
    extra = payload_consistency(documents).select(
        "verification_id", F.struct("check_name", "status", "valid", "severity", "reason").alias("_extra")
    )
    rows = checked.join(extra, "verification_id", "left")
    conflict = F.coalesce(F.col("_extra.severity") == "high", F.lit(False))
    # a conflict fails a permit; for a card it counts as a warning unless something else failed it
    raised = case_when(
        [(conflict & (F.col("document_type") == "border_permit"), "failed"), (conflict & (F.col("overall") == "passed"), "warning")], F.col("overall")
    )
    return rows.withColumns({"overall": raised, "checks": F.concat("checks", F.array_compact(F.array("_extra")))}).drop("_extra")
