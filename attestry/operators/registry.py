"""Registry lookup: candidate keys, watchlist precedence, field comparison, outcome.

``submissions`` are raw documents (verification_id, document_type, document_number, name, ...);
``registry`` and ``watchlist`` hold one row per record (record_id, document_type, ...).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import dims
from attestry.functions import dates, text
from attestry.functions.text import case_when

RECORD_FIELDS = (
    "record_id document_number name date_of_birth nationality expiry_date issuing_authority state vehicle_classes "
    "blood_group registry_document_status watchlist_reason"
).split()


def load_registry(official: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Both sources side by side; ``origin`` and ``source_rank`` keep them apart."""
    listed = watchlist.select("*", F.lit("watchlist").alias("origin"), F.lit(0).alias("source_rank"))
    known = official.select("*", F.lit("official").alias("origin"), F.lit(1).alias("source_rank"))
    return listed.unionByName(known, allowMissingColumns=True)


def _record_keys(records: DataFrame) -> DataFrame:
    """One best record per lookup key.

    A nine character passport also answers to its first eight characters, which replaces
    ten probes per eight character submission by one key. Copies of a number collapse
    before the shuffle, so the lookup side is unique per key.
    """
    number = text.index_number(F.col("document_number"))
    with_digit = (F.col("document_type") == "passport") & number.rlike(r"^.{8}[0-9]$")
    empty = F.lit(None).cast("string")
    keys = F.array(
        F.struct(F.lit("=").alias("form"), number.alias("key"), F.lit("").alias("digit")),
        F.struct(
            F.lit("8").alias("form"),
            F.when(with_digit, F.substring(number, 1, 8)).otherwise(empty).alias("key"),
            F.substring(number, 9, 1).alias("digit"),
        ),
    )
    record = F.struct(*[F.col(c) for c in RECORD_FIELDS], "origin", "source_rank").alias("record")
    rows = records.select(F.col("document_type").alias("kind"), F.explode(keys).alias("k"), record)
    rank = F.struct("record.source_rank", "k.digit", "record.record_id")
    return (
        rows.filter(F.col("k.key").isNotNull() & (F.col("k.key") != ""))
        .groupBy("kind", "k.form", "k.key")
        .agg(
            F.min_by("record", rank).alias("record"),
            F.min(rank).alias("rank"),
            F.count_if(F.col("record.source_rank") == 0).alias("listed"),
            F.count_if(F.col("record.source_rank") == 1).alias("known"),
        )
    )


def _probes(submissions: DataFrame) -> DataFrame:
    """Submissions with their candidate keys in order of preference."""
    # read several times below, so it is a column of its own
    submissions = submissions.withColumn("_number", text.index_number(F.col("document_number")))
    number = F.col("_number")
    passport = F.col("kind") == "passport"

    def probe(form: str, key: Column, order: int, condition: Column) -> Column:
        return F.when(condition, F.struct(F.lit(form).alias("form"), key.alias("key"), F.lit(order).alias("order")))

    candidates = F.array(
        probe("=", number, 0, F.coalesce(number != "", F.lit(False))),
        probe("=", F.substring(number, 1, 8), 1, passport & (F.length(number) == 9)),
        probe("8", number, 1, passport & (F.length(number) == 8)),
    )
    return submissions.withColumn("kind", text.document_type(F.col("document_type"))).withColumn(
        "probes", F.filter(candidates, lambda c: c.isNotNull())
    ).drop("_number")


def _keyed(probed: DataFrame) -> DataFrame:
    """One row per candidate key; the outer form repeats no expression in a filter, submissions without a key drop out afterwards."""
    rows = probed.select("verification_id", "kind", F.explode_outer("probes").alias("p")).filter("p IS NOT NULL")
    return rows.select("verification_id", "kind", "p.*")


def registry_matches(submissions: DataFrame, registry: DataFrame, watchlist: DataFrame, prepared=None) -> DataFrame:
    """Every submission with its winning ``record`` (NULL when not found).

    The watchlist wins over the official source whatever the candidate. A submission has at
    most two candidates, so the final pick groups at most two rows per submission.
    ``prepared`` may rewrite ``record`` in the lookup side, once per key and not per submission.
    """
    keys = _record_keys(load_registry(registry, watchlist))
    keys = keys if prepared is None else prepared(keys)
    probed = _probes(submissions)
    hits = _keyed(probed).join(keys, ["kind", "form", "key"])
    order = F.struct("rank.source_rank", "order", "rank.digit", "rank.record_id")
    best = hits.groupBy("verification_id").agg(
        F.min_by(F.struct("record", "order", "listed", "known"), order).alias("hit")
    )
    return (
        probed.drop("probes", "document_type")
        .withColumnRenamed("kind", "document_type")
        .join(best, "verification_id", "left")
        .select(
            submissions.drop("document_type")["*"],
            "document_type",
            F.col("hit.record").alias("record"),
            F.col("hit.order").alias("candidate"),
            F.when(F.col("hit.record.source_rank") == 0, F.col("hit.listed"))
            .otherwise(F.col("hit.known"))
            .alias("match_count"),
        )
    )


def registry_lookup(submissions: DataFrame, registry: DataFrame, watchlist: DataFrame) -> DataFrame:
    found = registry_matches(submissions, registry, watchlist).filter(F.col("record").isNotNull())
    return found.select(
        "verification_id", "document_type", F.col("record.origin").alias("origin"),
        F.col("record.record_id").alias("record_id"), "candidate",
        F.col("record.registry_document_status").alias("registry_document_status"),
        F.col("record.watchlist_reason").alias("watchlist_reason"),
    )


def registry_not_found(submissions: DataFrame, registry: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Submissions without a record in either source; not the same as INVALID."""
    probed = _probes(submissions)
    keyed = _keyed(probed).drop("order")
    keys = _record_keys(load_registry(registry, watchlist)).select("kind", "form", "key")
    found = keyed.join(keys, ["kind", "form", "key"], "left_semi").select("verification_id").distinct()
    return probed.join(found, "verification_id", "left_anti").select(
        "verification_id", F.col("kind").alias("document_type"), text.masked(F.col("document_number")).alias("number")
    )


def registry_ambiguous(submissions: DataFrame, registry: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Hits whose winning key stands for more than one record of the winning source."""
    found = registry_matches(submissions, registry, watchlist).filter(F.col("match_count") > 1)
    return found.select(
        "verification_id", "document_type", F.col("record.origin").alias("origin"), "match_count"
    )


def _presence(doc: Column, reg: Column, compared: Column) -> Column:
    return case_when(
        [
            (doc.isNull() & reg.isNull(), "NOT_COMPARED"),
            (doc.isNull(), "MISSING_IN_DOCUMENT"),
            (reg.isNull(), "MISSING_IN_REGISTRY"),
        ],
        compared,
    )


def _match(equal: Column) -> Column:
    return F.when(F.coalesce(equal, F.lit(False)), "MATCH").otherwise("MISMATCH")


def _critical(field: str, kind: Column) -> Column:
    """true / false by policy of the document type, NULL when the field is not compared."""
    known = list(dims.CRITICAL_FIELDS)
    listed = {True: [], False: []}
    for flag, policy in ((True, dims.CRITICAL_FIELDS), (False, dims.SECONDARY_FIELDS)):
        listed[flag] = [k for k, fields in policy.items() if field in fields.split()]
    default = [flag for flag in (True, False) if "passport" in listed[flag]]
    other = F.lit(default[0]) if default else F.lit(None).cast("boolean")
    return case_when([(kind.isin(*kinds), F.lit(flag)) for flag, kinds in listed.items() if kinds], F.when(~kind.isin(*known), other))


def with_forms(df: DataFrame, given: dict[str, Column], kind: Column, values: bool) -> DataFrame:
    """Adds ``form_<field>``, all that a comparison needs of a field, made once per row; NULL for a missing value.

    ``key`` is what is compared, ``normal`` what is shown. Without ``values`` what is only shown is left out. Fields
    outside the policy of ``kind`` have no forms.
    """
    upper = {f: F.upper(text.stripped(v)) for f, v in given.items()}
    licence = kind == "driving_license"
    # read more than once below, so they are columns of their own; a column that is read once is written out where it is read
    rules = dict.fromkeys(("date_of_birth", "expiry_date", "valid_from"), dates.lenient_date)
    rules |= {"document_number": lambda v: F.upper(text.without(v, text.SPACES)), "name": text.spaced_name}
    read = {f"_norm_{f}": rules[f](v) for f, v in given.items() if f in rules}
    folded = F.when(licence, text.stripped(text.compatibility_folded(given["document_number"])))
    df = df.withColumns(read | {"_licence": folded})
    forms = {}
    for field, value in given.items():
        norm = F.col(f"_norm_{field}")
        if field == "document_number":
            # licence numbers ignore separators; all other numbers only whitespace and case
            bare = F.when(licence, text.without(F.upper(value), text.SPACES + "-_"))
            parts = {"normal": text.blank_to_null(norm), "bare": bare, "licence": text.clean_licence_number(F.col("_licence"))}
        elif field == "name":
            parts = {"key": text.name_letters(text.blank_to_null(norm)), "normal": text.blank_to_null(norm)}
        elif field in rules:
            # a date that cannot be read is shown as it is
            parts = {"key": norm, "other": F.when(norm.isNull(), upper[field])}
        elif field == "issuing_authority":
            parts = {"key": upper[field], "normal": text.authority(value)}
        elif field == "vehicle_classes":
            parts = {"key": text.vehicle_class_set(value), "normal": upper[field]}
        else:
            parts = {"key": text.nationality(value) if field == "nationality" else upper[field]}
        if not values and len(parts) == 2:
            parts = {"key": parts["key"]}
        wanted = value.isNotNull() & _critical(field, kind).isNotNull()
        forms[f"form_{field}"] = F.when(wanted, F.struct(*[c.alias(n) for n, c in parts.items()]))
    return df.withColumns(forms).drop(*read, "_licence")


def _shown(field: str, form: Column) -> Column:
    if field in ("date_of_birth", "expiry_date", "valid_from"):
        return F.coalesce(form["key"], form["other"])
    return form["key" if field in ("nationality", "state", "blood_group") else "normal"]


def _same_number(doc: Column, reg: Column) -> Column:
    licence = (doc["bare"] == reg["bare"]) | (doc["licence"] == reg["licence"])
    return F.when(F.col("document_type") == "driving_license", licence).otherwise(doc["normal"] == reg["normal"])


def field_entries(values: bool = True) -> Column:
    """array<struct> with one entry per policy field of the row's document type.

    Without ``values`` the entries leave the compared values out; a struct inside an array is never pruned, so they would
    be made even where no one reads them.
    """
    compare = {
        "document_number": lambda d, r: _match(_same_number(d, r)),
        "vehicle_classes": lambda d, r: text.class_set_relation(d["key"], r["key"]),
        "state": lambda d, r: _match(text.state_codes_equal(d["key"], r["key"])),
    }
    entries = []
    for field, method in dims.COMPARISON_METHODS.items():
        d = F.col(f"form_{field}")
        # no record has the field
        r = F.lit(None).cast("struct<key:string,other:string>") if field == "valid_from" else F.col(f"record.form_{field}")
        is_critical = _critical(field, F.col("document_type"))
        entries.append(
            F.when(
                is_critical.isNotNull(),
                F.struct(
                    F.lit(field).alias("field"),
                    is_critical.alias("is_critical"),
                    F.when(d.isNull() | r.isNull(), "none").otherwise(method).alias("comparison_method"),
                    *([_shown(field, d).alias("document_value"), _shown(field, r).alias("registry_value")] if values else []),
                    _presence(d, r, compare.get(field, lambda d, r: _match(d["key"] == r["key"]))(d, r)).alias("status"),
                ),
            )
        )
    # fields outside the policy of the row's type are never compared
    return F.array_compact(F.array(*entries))


def compared(submissions: DataFrame, registry: DataFrame, watchlist: DataFrame, values: bool = True) -> DataFrame:
    """Submissions with the comparable forms of their fields and of their winning ``record``.

    The forms of a record are made once per lookup key, those of a submission once it has a record.
    """
    fields = [f for f in dims.COMPARISON_METHODS if f != "valid_from"]

    def prepared(keys: DataFrame) -> DataFrame:
        kept = [F.col(f"record.{c}") for c in ("record_id", "origin", "source_rank", "registry_document_status", "watchlist_reason")]
        keys = with_forms(keys, {f: F.col(f"record.{f}") for f in fields}, F.col("kind"), values)
        forms = [f"form_{f}" for f in fields]
        return keys.withColumn("record", F.struct(*kept, *forms)).drop(*forms)

    found = registry_matches(submissions, registry, watchlist, prepared)
    has_record = F.col("record").isNotNull()
    given = {f: F.col("issue_date" if f == "valid_from" else f) for f in dims.COMPARISON_METHODS}
    return with_forms(found, {f: F.when(has_record, v) for f, v in given.items()}, F.col("document_type"), values)


def field_comparison(submissions: DataFrame, registry: DataFrame, watchlist: DataFrame, secret: str) -> DataFrame:
    """One row per compared field; the compared values leave as keyed hashes under ``secret``."""
    rows = compared(submissions, registry, watchlist).filter("record IS NOT NULL")
    # the outer form repeats no expression in a filter; the entries are a column, so the code of the explosion stays small
    rows = rows.withColumn("_entries", field_entries()).select("verification_id", "document_type", F.explode_outer("_entries").alias("f"))
    rows = rows.filter("f IS NOT NULL").select("verification_id", "document_type", "f.*")
    hashes = [text.keyed_hash(F.col(f"{side}_value"), secret).alias(f"{side}_hash") for side in ("document", "registry")]
    return rows.select("*", *hashes).drop("document_value", "registry_value")


def outcome(results: Column, record: Column, kind: Column) -> Column:
    """Ordered decision over one submission's field results; needs no shuffle."""
    critical = F.filter(results, lambda e: e["is_critical"])

    def count(*statuses: str) -> Column:
        return F.size(F.filter(critical, lambda e: e["status"].isin(*statuses)))

    status = F.upper(text.stripped(F.coalesce(record["registry_document_status"], F.lit(""))))
    policy = {k: str(len(fields.split()) // 2) for k, fields in dims.CRITICAL_FIELDS.items()}
    half = F.coalesce(text.lookup(policy, kind), F.lit(policy["passport"])).cast("int")
    comparable = F.size(critical) - count("NOT_COMPARED")
    decided = case_when(
        [
            (status == "REVOKED", "REVOKED"),
            (status == "SUSPENDED", "SUSPENDED"),
            (status == "INVALID", "INVALID"),
            (status == "EXPIRED", "EXPIRED"),
            (count("MISMATCH") > 0, "MISMATCH"),
            (comparable == 0, "INCONCLUSIVE"),
            (count("MISSING_IN_REGISTRY", "MISSING_IN_DOCUMENT") >= half, "INCONCLUSIVE"),
            ((count("MATCH") == comparable) & (count("MATCH") > 0), "MATCHED"),
        ],
        "INCONCLUSIVE",
    )
    listed = (record["origin"] == "watchlist") & (status != "SUSPENDED")
    return case_when([(record.isNull(), "NOT_FOUND"), (listed, "REVOKED")], decided)


def registry_outcomes(submissions: DataFrame, registry: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Submissions with ``record``, ``field_results`` without values and ``registry_status``."""
    rows = compared(submissions, registry, watchlist, values=False)
    results = F.when(F.col("record").isNotNull(), field_entries(values=False))
    rows = rows.withColumn("field_results", results).drop(*[f"form_{f}" for f in dims.COMPARISON_METHODS])
    return rows.withColumn(
        "registry_status", outcome(F.col("field_results"), F.col("record"), F.col("document_type"))
    )


def registry_outcome(submissions: DataFrame, registry: DataFrame, watchlist: DataFrame) -> DataFrame:
    return registry_outcomes(submissions, registry, watchlist).select(
        "verification_id", "document_type", "registry_status", F.col("record.origin").alias("origin")
    )


# ---------------------------------------------------------------------------------------
# Protection at rest

PROTECTED_FIELDS = (
    "document_number name date_of_birth registry_document_status issuing_authority expiry_date metadata"
).split()


def blind_index_pads(secret: bytes, kinds) -> dict[str, tuple[str, str]]:
    """HMAC key pads per document type; the only part of the keyed hash that depends on the key."""
    pads = {}
    for kind in kinds:
        key = secret + kind.strip().lower().encode()
        key = hashlib.sha256(key).digest() if len(key) > 64 else key
        key = key.ljust(64, b"\0")
        pads[kind] = tuple(bytes(b ^ mask for b in key).hex() for mask in (0x36, 0x5C))
    return pads


def blind_index(kind: Column, number: Column, pads: dict[str, tuple[str, str]]) -> Column:
    """HMAC-SHA256 of the normalised number under the key of its document type."""
    inner = F.unhex(text.lookup({k: p[0] for k, p in pads.items()}, kind))
    outer = F.unhex(text.lookup({k: p[1] for k, p in pads.items()}, kind))
    message = text.index_number(number).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def protect_registry(records: DataFrame, secret: bytes, cipher_key: bytes) -> DataFrame:
    """Replaces identity fields by AES-GCM ciphertext and adds the blind index used for lookups."""
    pads = blind_index_pads(secret, dims.CRITICAL_FIELDS)
    key = F.unhex(F.lit(cipher_key.hex()))
    fields = [f for f in PROTECTED_FIELDS if f in records.columns]
    hidden = [F.base64(F.aes_encrypt(F.col(f).cast("string"), key, F.lit("GCM"))).alias(f) for f in fields]
    rest = [c for c in records.columns if c not in fields]
    return records.select(
        *rest, blind_index(F.col("document_type"), F.col("document_number"), pads).alias("blind_index"), *hidden
    )


def reveal_registry(protected: DataFrame, cipher_key: bytes) -> DataFrame:
    """Decrypts the protected fields; unreadable ciphertext becomes NULL."""
    key = F.unhex(F.lit(cipher_key.hex()))
    fields = [f for f in PROTECTED_FIELDS if f in protected.columns]
    return protected.withColumns(
        {f: F.try_aes_decrypt(F.unbase64(F.col(f)), key, F.lit("GCM")).cast("string") for f in fields}
    )


def protected_roundtrip(records: DataFrame, secret: bytes, cipher_key: bytes) -> DataFrame:
    """Records protected and revealed again: blind index, masked number and which fields can be read."""
    revealed = reveal_registry(protect_registry(records, secret, cipher_key), cipher_key)
    readable = [F.col(c).isNotNull().alias(f"has_{c}") for c in ("name", "date_of_birth")]
    return revealed.select("record_id", "document_type", "blind_index", text.masked(F.col("document_number")).alias("number"), *readable)
