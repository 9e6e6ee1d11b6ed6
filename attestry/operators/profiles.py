"""Document profiles as rows: a rule table is compiled into column expressions.

A rule is a row (document_type, rule, field, argument, severity). A new document type is a few more rows, not code. The rules
that a deployment has are few and bounded (MOST_RULES); they are read once and become one projection over the
scanned rows, so no join of documents and rules is made and each row meets the rules of its own type only.

Rules over fields: ``required`` (not blank), ``pattern`` (the whole bare value, upper-cased letters and digits, matches),
``min_age`` and ``max_age`` (years at the reference date), ``after`` (a date lies after that of the field named in the argument),
``not_future``. A blank value passes all rules but ``required``; an unreadable date is inconclusive. Dates are ISO texts.

Rules over texts: ``anchor``, ``identifier`` and ``statutory`` (any of the type's patterns), ``token`` (two different ones), ``aspect``
(``ratio~tolerance`` of the longer to the shorter side). Each kind counts once as a signal.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import dates, text
from attestry.functions.text import case_when

Rule = tuple[str, str, str | None, str | None, str | None]
COLUMNS = ("document_type", "rule", "field", "argument", "severity")
MOST_RULES = 10_000
FIELD_RULES = ("required", "pattern", "min_age", "max_age", "after", "not_future")
TEXT_KINDS = ("anchor", "identifier", "statutory", "token", "aspect")


def read_rules(table: DataFrame) -> list[Rule]:
    """The rules of a table, which may hold MOST_RULES at most."""
    rows = table.select(*COLUMNS).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return check_rules(map(tuple, rows))


def check_rules(rules: Iterable[Rule]) -> list[Rule]:
    """The rules in a fixed order; an unknown one is an error, not a rule that never speaks."""
    rules = sorted(set(rules), key=lambda r: tuple(x or "" for x in r))
    for kind, rule, field, argument, _ in rules:
        known = (rule in FIELD_RULES and field) or rule in TEXT_KINDS
        if not kind or not known or (argument is None and rule not in ("required", "not_future")):
            raise ValueError(f"not a rule: {kind}, {rule}, {field}, {argument}")
    return rules


def _day(field: str) -> Column:
    stripped = text.stripped(F.col(field))
    return F.when(stripped.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(stripped, "yyyy-MM-dd"))


def _verdict(rule: str, field: str, argument: str | None, reference: str) -> Column:
    """passed, failed or inconclusive."""
    value, day, today = text.stripped(F.col(field)), _day(field), F.lit(reference).cast("date")
    blank = F.coalesce(value, F.lit("")) == ""
    ok = {
        "required": lambda: ~blank,
        "pattern": lambda: F.regexp_replace(F.upper(value), "[^A-Z0-9]", "").rlike(f"^(?:{argument})$"),
        "min_age": lambda: F.add_months(day, 12 * int(argument)) <= today,
        "max_age": lambda: F.add_months(day, 12 * (int(argument) + 1)) > today,
        "after": lambda: day > _day(argument),
        "not_future": lambda: day <= today,
    }[rule]()
    if rule == "required":
        return F.when(ok, "passed").otherwise("failed")
    unread = F.when(ok.isNull(), "inconclusive").when(ok, "passed").otherwise("failed")
    return F.when(blank, "passed").otherwise(unread)


def profile_checks(documents: DataFrame, rules: Iterable[Rule], key: str = "verification_id", reference: str = dates.REFERENCE_DATE) -> DataFrame:
    """One row per document and field rule of its type; severity only where a rule has failed."""
    chosen = [r for r in check_rules(rules) if r[1] in FIELD_RULES]
    by_type: dict[str, list[Column]] = {}
    for kind, rule, field, argument, severity in chosen:
        status = _verdict(rule, field, argument, reference)
        by_type.setdefault(kind, []).append(F.struct(
            F.lit(rule).alias("rule"), F.lit(field).alias("field"), F.lit(argument).cast("string").alias("argument"), status.alias("status"),
            F.when(status == "failed", F.lit(severity)).cast("string").alias("severity"),
        ))
    kind = text.document_type(F.col("document_type"))
    none = F.array().cast("array<struct<rule:string,field:string,argument:string,status:string,severity:string>>")
    checks = reduce(lambda rest, k: F.when(F.col("_kind") == k, F.array(*by_type[k])).otherwise(rest), by_type, none)
    rows = documents.withColumn("_kind", kind).select(key, F.col("_kind").alias("document_type"), F.explode(checks).alias("c"))
    return rows.select(key, "document_type", "c.*")


def _kinds(rules: list[Rule], kind: str) -> dict[str, Column]:
    """Per kind of signal whether the text (column ``_up``) or the shape of its image gives it."""
    of = {k: [r[3] for r in rules if r[0] == kind and r[1] == k] for k in TEXT_KINDS}
    found = {k: F.col("_up").rlike("|".join(f"(?:{p})" for p in of[k])) for k in ("anchor", "identifier", "statutory") if of[k]}
    if of["token"]:
        found["token"] = sum((F.col("_up").rlike(rf"\b(?:{p})\b").cast("int") for p in of["token"]), F.lit(0)) >= 2
    if of["aspect"]:
        ratio = F.greatest("width", "height") / F.greatest(F.least("width", "height"), F.lit(1))
        near = [F.abs(ratio - float(a.split("~")[0])) <= float(a.split("~")[1]) for a in of["aspect"]]
        found["aspect"] = F.coalesce(reduce(lambda a, b: a | b, near), F.lit(False))
    return found


def profile_signals(documents: DataFrame, rules: Iterable[Rule], needed: int = 2) -> DataFrame:
    """How many kinds of signals say that a text (doc_id, declared_type, text, width, height) is of its declared type.

    All patterns of a type are sought as one alternation first; only texts that hold any are searched kind by kind.
    """
    chosen = check_rules(rules)
    types = sorted({r[0] for r in chosen if r[1] in TEXT_KINDS})
    none = F.array().cast("array<string>")
    rows = documents.withColumn("_kind", text.document_type(F.col("declared_type"))).withColumn("_up", F.upper(F.coalesce("text", F.lit(""))))
    signals = none
    for kind in types:
        kinds = _kinds(chosen, kind)
        patterns = [r[3] for r in chosen if r[0] == kind and r[1] in TEXT_KINDS and r[1] != "aspect"]
        named = lambda names, kinds=kinds: F.array_compact(F.array(*[F.when(kinds[k], F.lit(k)) for k in names]))
        textual = named([k for k in kinds if k != "aspect"]) if len(kinds) > ("aspect" in kinds) else none
        if patterns:
            textual = F.when(F.col("_up").rlike("|".join(f"(?:{p})" for p in patterns)), textual).otherwise(none)
        every = F.concat(textual, named(["aspect"])) if "aspect" in kinds else textual
        signals = F.when(F.col("_kind") == kind, every).otherwise(signals)
    n = F.size("_signals")
    known = F.col("_kind").isin(*types) if types else F.lit(False)
    decision = case_when([(~known, "NO_PROFILE"), (n >= needed, "SUPPORTED"), (n == 1, "LOW_CONFIDENCE")], "UNKNOWN")
    confidence = case_when([(~known, F.lit(0.0)), (n >= needed, F.least(F.lit(0.97), F.round(0.70 + 0.07 * (n - 1), 2))), (n == 1, F.lit(0.42))], F.lit(0.10))
    return rows.withColumn("_signals", signals).select(
        "doc_id", F.col("_kind").alias("document_type"), n.alias("signals"), F.array_join("_signals", ",").alias("kinds"), decision.alias("decision"), confidence.alias("confidence")
    )
