"""All registered queries and their SQL twins."""

from __future__ import annotations

from attestry.plans import sql_cards, sql_case, sql_evidence, sql_identity, sql_ledger, sql_pairing, sql_passport, sql_profiles, sql_risk, sql_streams, sql_validate
from attestry.plans.fixtures import as_sql
from attestry.plans.queries import QUERIES

_SQL = [sql_risk.SQL, sql_identity.SQL, sql_validate.SQL, sql_case.SQL, sql_evidence.SQL, sql_ledger.SQL, sql_pairing.SQL, sql_passport.SQL, sql_streams.SQL, sql_profiles.SQL, sql_cards.SQL]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    texts = {name: as_sql(text) for part in _SQL for name, text in part.items() if name in QUERIES}
    # a stream over all available input ends in the result of its batch form
    for streamed, batch in (("registry_stream", "registry_outcome"), ("ledger_stream", "ledger_build"), ("case_stream", "case_risk")):
        texts[streamed] = texts[batch]
    return texts
