"""SQL twins of the jobs that read document profiles: one SELECT per rule, written from the same rows."""

from __future__ import annotations

from attestry import dims
from attestry.functions.dates import REFERENCE_DATE
from attestry.operators.profiles import FIELD_RULES, TEXT_KINDS, check_rules

_RULES = check_rules(dims.PROFILE_RULES)
_ALIASES = " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in dims.TYPE_ALIASES.items())


def _kind(column: str) -> str:
    return f"CASE lower(trim({column})) {_ALIASES} ELSE lower(trim({column})) END"


def _text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _day(field: str) -> str:
    return f"CASE WHEN regexp_matches(trim({field}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST(trim({field}) AS DATE) END"


def _ok(rule: str, field: str, argument: str | None) -> str:
    day, today = _day(field), f"DATE '{REFERENCE_DATE}'"
    if rule == "pattern":
        return f"regexp_full_match(regexp_replace(upper(trim({field})), '[^A-Z0-9]', '', 'g'), '{argument}')"
    if rule == "min_age":
        return f"{day} + INTERVAL {argument} YEAR <= {today}"
    if rule == "max_age":
        return f"{day} + INTERVAL {int(argument) + 1} YEAR > {today}"
    return f"{day} > {_day(argument)}" if rule == "after" else f"{day} <= {today}"


def _check(kind: str, rule: str, field: str, argument: str | None, severity: str | None) -> str:
    blank = f"coalesce(trim({field}), '') = ''"
    ok = _ok(rule, field, argument) if rule != "required" else ""
    status = (
        f"CASE WHEN {blank} THEN 'failed' ELSE 'passed' END" if rule == "required"
        else f"CASE WHEN {blank} THEN 'passed' WHEN ({ok}) IS NULL THEN 'inconclusive' WHEN {ok} THEN 'passed' ELSE 'failed' END"
    )
    return (
        f"SELECT verification_id, kind AS document_type, '{rule}' AS rule, '{field}' AS field, {_text(argument)} AS argument, {status} AS status, {_text(severity)} AS s FROM d WHERE kind = '{kind}'"
    )


def _signal(kind: str, name: str) -> str:
    arguments = [r[3] for r in _RULES if r[0] == kind and r[1] == name]
    if name == "token":
        test = " + ".join(f"CAST(regexp_matches(up, '\\b(?:{a})\\b') AS INT)" for a in arguments) + " >= 2"
    elif name == "aspect":
        test = " OR ".join("abs(greatest(width, height) / greatest(least(width, height), 1) - {}) <= {}".format(*a.split("~")) for a in arguments)
    else:
        test = " OR ".join(f"regexp_matches(up, '{a}')" for a in arguments)
    return f"SELECT doc_id, '{name}' AS k, {TEXT_KINDS.index(name)} AS place FROM d WHERE kind = '{kind}' AND ({test})"


_SIGNALS = sorted({(r[0], r[1]) for r in _RULES if r[1] in TEXT_KINDS})
_TYPES = ", ".join(f"'{k}'" for k in sorted({k for k, _ in _SIGNALS}))

SQL = {
    "profile_checks": f"WITH d AS (SELECT *, {_kind('document_type')} AS kind FROM {{submissions}} AS s0), c AS ("
    + " UNION ALL ".join(_check(*r) for r in _RULES if r[1] in FIELD_RULES)
    + ") SELECT verification_id, document_type, rule, field, argument, status, CASE WHEN status = 'failed' THEN s END AS severity FROM c",
    "profile_signals": f"WITH d AS (SELECT *, {_kind('declared_type')} AS kind, upper(coalesce(text, '')) AS up FROM {{page_texts}} AS t0), k AS ("
    + " UNION ALL ".join(_signal(*s) for s in _SIGNALS)
    + f"""), n AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY place) AS kinds FROM k GROUP BY doc_id)
SELECT d.doc_id, kind AS document_type, CAST(coalesce(n, 0) AS INTEGER) AS signals, coalesce(kinds, '') AS kinds,
  CASE WHEN kind NOT IN ({_TYPES}) THEN 'NO_PROFILE' WHEN n >= 2 THEN 'SUPPORTED' WHEN n = 1 THEN 'LOW_CONFIDENCE' ELSE 'UNKNOWN' END AS decision,
  CASE WHEN kind NOT IN ({_TYPES}) THEN 0.0 WHEN n >= 2 THEN least(0.97, round(0.70 + 0.07 * (n - 1), 2)) WHEN n = 1 THEN 0.42 ELSE 0.10 END::DOUBLE AS confidence
FROM d LEFT JOIN n ON n.doc_id = d.doc_id""",
}
