"""Distributed ranks equal plain windows, nothing is cut, and scores keep their invariants."""

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.operators import crossdoc, evidence, ledger, payloads, risk, standardize
from attestry.operators.ranking import ordinal, top_rows
from attestry.plans.fixtures import table

EVIDENCE = (
    "case_id long, item_seq long, module string, signal string, category string, status string, severity string, "
    "confidence double, quality double, available boolean, correlation_group string, is_positive boolean"
)


def item(seq, signal="registry_revoked", severity="CRITICAL", confidence=0.95, group=None, case=1, category="REGISTRY_STATUS", available=True):
    return (case, seq, "M5", signal, category, "REVOKED", severity, confidence, 1.0, available, group, False)


def score(spark, rows):
    return {r.case_id: r for r in risk.risk_override(spark.createDataFrame(rows, EVIDENCE), ).collect()}


def test_ordinal_of_hot_keys(spark):
    # one key holds a third of the rows and all its order values tie except for the id
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    hot = ordinal(df, ["k"], order, "n")
    assert hot.exceptAll(plain).isEmpty() and plain.exceptAll(hot).isEmpty()


def long_ledger(spark):
    """One target with 200 blocks in four segments, and its stored anchors."""
    events = spark.range(1, 201).selectExpr("1 AS target_id", "id AS event_id", "'view' AS event_type", "'2024-01-01' AS recorded_at", "concat('p', id) AS payload")
    blocks = ledger.ledger_build(events).cache()
    return blocks, ledger.anchors(blocks).cache()


def test_missing_blocks_are_found(spark):
    blocks, kept = long_ledger(spark)
    index = F.col("block_index")

    def verdict(left, stored):
        row = ledger.ledger_verify(left, stored).first()
        return row.chain_valid, row.first_bad_block, row.first_cause

    assert verdict(blocks, kept) == (True, None, None) and verdict(blocks, None) == (True, None, None)
    for stored in (kept, None):
        assert verdict(blocks.filter(index != 64), stored) == (False, 65, "BROKEN_LINK")
        assert verdict(blocks.filter(~index.between(65, 128)), stored) == (False, 129, "BROKEN_LINK")
        assert verdict(blocks.filter(index != 1), stored) == (False, 2, "BROKEN_LINK")
        assert verdict(blocks.filter(index > 64), stored) == (False, 65, "BROKEN_LINK")
    assert verdict(blocks.filter(index <= 150), kept) == (False, 151, "MISSING_BLOCKS")
    assert verdict(blocks.limit(0), kept) == (False, 1, "MISSING_BLOCKS")
    renumbered = blocks.withColumn("segment", F.when(F.col("segment") == 3, 2).otherwise(F.col("segment")))
    assert not verdict(renumbered, kept)[0]
    forged = kept.withColumn("head_hash", F.lit("0"))
    assert verdict(blocks, forged) == (False, None, "HEAD_MISMATCH")


def test_digit_runs_of_any_length_are_masked(spark):
    texts = ["1" * 25, "1234 5678 9012", "1-2" * 4000 + "9999", "12345678901", "1234  5678  9012", "a 123456789012 b 2345-6789-0123", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: (r.identifiers, r.masked_text) for r in standardize.mask_document_text(df).collect()}
    assert got[0] == (1, "XXXX XXXX 1111") and got[1] == (1, "XXXX XXXX 9012") and got[2] == (1, "XXXX XXXX 9999")
    assert got[3] == (0, texts[3]) and got[4] == (0, texts[4]) and got[5] == (2, "a XXXX XXXX 9012 b XXXX XXXX 0123")
    assert got[6] == (None, None)


def test_payload_slots_beyond_a_thousand_count(spark):
    text = "TN0519900000001|A NAME" + "|" * 1500 + "1990-01-01|LMV"
    df = spark.createDataFrame([(1, text), (2, "TN0519900000001|A")], "doc_id int, payload string")
    row = payloads.parse_payloads(df).filter("doc_id = 1").first()
    assert (row.dob, row.cov) == ("1990-01-01", "LMV")


def test_short_and_unreadable_module_entries(spark):
    base = table(spark, SMALL, "module_results").limit(1)
    rows = base.withColumns({
        "has_m3": F.lit(True), "m3_overall": F.lit("clean"), "m3_signals": F.lit("ela:suspicious;metadata;copy_move:suspicious:low:x"),
        "has_m5": F.lit(True), "m5_status": F.lit(None).cast("string"), "has_m7": F.lit(True), "m7_applicable": F.lit(True),
        "m7_detection": F.lit("DECODED"), "m7_checks": F.lit("name;dob:"), "m2_failed": F.lit("identifier_checksum"), "has_m2": F.lit(True),
    })
    got = {(r.module, r.signal): r for r in evidence.evidence_union(rows).collect()}
    assert got["M3", "forensic_ela_anomaly"].confidence == 0.7 and got["M3", "forensic_ela_anomaly"].severity == "MEDIUM"
    assert got["M3", "forensic_suspicious"].severity == "LOW"
    assert not got["M5", "registry_provider_unavailable"].available
    every = rows.withColumns({"m5_status": F.lit("MISMATCH"), "m5_mismatched": F.lit("a;b;c;d;e")})
    assert evidence.evidence_union(every).filter("signal = 'registry_field_mismatch'").count() == 5


def test_superseded_documents_count_as_revisions(spark):
    rows = [("c", "D1", 1, "SUPERSEDED"), ("c", "D2", 2, "ACTIVE"), ("d", "D3", 1, "SUPERSEDED"), ("d", "D4", 2, "REMOVED"), ("e", "D5", 1, "REMOVED"), ("e", "D6", 2, None)]
    df = spark.createDataFrame(rows, "case_id string, document_id string, uploaded_at int, status string").withColumns(
        {"document_type": F.lit("passport")} | {c: F.lit("x") for c in crossdoc.IDENTITY}
    )
    got = {r.case_id: (r.document_id, r.document_revision) for r in crossdoc.active_revisions(df).collect()}
    assert got == {"c": ("D2", 2), "e": ("D6", 1)}
    stored = df.withColumn("document_revision", F.lit(7))
    assert {r.document_revision for r in crossdoc.active_revisions(stored).collect()} == {7}


def test_top_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = top_rows(df, ["k"], [F.desc("id")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_tree_hash_depends_only_on_own_leaves(spark):
    leaves = spark.range(40).select(F.lit("a").alias("k"), F.col("id").alias("position"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    single = spark.createDataFrame([("b", 0, "x")], "k string, position long, leaf string")
    together = {r.k: r.tree_hash for r in ledger.fold_tree(leaves.unionByName(single), ["k"], width=3).collect()}
    alone = ledger.fold_tree(single, ["k"], width=3).first().tree_hash
    assert together["b"] == alone and together["a"] != alone
    shorter = ledger.fold_tree(leaves.filter("position < 39"), ["k"], width=3).first().tree_hash
    assert shorter != together["a"]
    with pytest.raises(Exception, match="more leaves"):
        ledger.fold_tree(leaves, ["k"], width=3, levels=2).collect()


def test_revoked_scores_55_and_is_raised_to_85(spark):
    row = score(spark, [item(1)])[1]
    assert (row.base_score, row.risk_score, row.critical_override_applied) == (55, 85, True)


def test_diminishing_returns_and_caps(spark):
    rows = [item(i, "registry_field_mismatch", "HIGH", group="G") for i in range(6)]
    got = risk.category_breakdown(spark.createDataFrame(rows, EVIDENCE)).filter("category = 'REGISTRY_STATUS'").first()
    assert got.raw_contribution == round(12 * (1 + 0.5 + 0.25 + 3 * 0.10), 4)
    capped = risk.category_breakdown(spark.createDataFrame([item(i) for i in range(3)], EVIDENCE))
    assert capped.filter("category = 'REGISTRY_STATUS'").first().contribution == 55.0
    assert capped.count() == 9


def test_unavailable_and_neutral_items_add_nothing(spark):
    rows = [item(1, available=False), item(2, severity="NONE")]
    assert score(spark, rows)[1].base_score == 0


def test_unknown_signal_falls_back_to_severity(spark):
    assert score(spark, [item(1, "never_seen", "HIGH")])[1].base_score == 7


def test_low_confidence_is_discounted(spark):
    assert score(spark, [item(1, "registry_not_found", "HIGH", 0.49)])[1].base_score == 6
    assert score(spark, [item(1, "registry_not_found", "HIGH", 0.50)])[1].base_score == 8


def test_scores_stay_in_bounds(spark):
    rows = risk.risk_score(table(spark, SMALL, "evidence"))
    low, high = rows.agg(F.min("risk_score"), F.max("risk_score")).first()
    assert 0 <= low and high <= 100


def test_tampering_is_located(spark):
    blocks = ledger.ledger_build(table(spark, SMALL, "ledger_events"))
    target = blocks.groupBy("target_id").count().orderBy(F.desc("count")).first().target_id
    hit = (F.col("target_id") == target) & (F.col("block_index") == 2)
    edited = blocks.withColumn("event_type", F.when(hit, "forged").otherwise(F.col("event_type")))
    row = ledger.ledger_verify(edited).filter(F.col("target_id") == target).first()
    assert (row.chain_valid, row.first_bad_block, row.first_cause) == (False, 2, "TAMPERED_CONTENT")
    dropped = ledger.ledger_verify(blocks.filter(~hit)).filter(F.col("target_id") == target).first()
    assert (dropped.first_bad_block, dropped.first_cause) == (3, "BROKEN_LINK")


def test_separator_in_values_cannot_forge_a_line(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert df.select(ledger.canonical("x", "y").alias("l")).distinct().count() == 2


def test_ordinal_deals_usual_keys_once_and_spreads_hot_ones(spark):
    """Usual keys took a range sort, a stored copy of all columns and a join; now one shuffle. Keys beyond the bound are still spread."""
    n = 3000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") < 2000, 1).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7 % n).alias("v"))
    usual = ordinal(rows, ["k"], [F.asc("v")], "n")
    assert usual._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    spread = ordinal(rows, ["k"], [F.asc("v")], "n", hot_rows=100)
    counted = ordinal(rows, ["k"], [F.asc("v")], "n", sizes=rows.unionByName(rows), hot_rows=100)
    want = sorted(map(str, usual.collect()))
    assert sorted(map(str, spread.collect())) == want and sorted(map(str, counted.collect())) == want
    assert spread.dtypes == usual.dtypes


@pytest.mark.parametrize("build", [risk.top_contributors, risk.risk_reasons])
def test_items_of_usual_cases_are_shuffled_once(spark, build):
    found = build(table(spark, SMALL, "evidence"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert found.count() > 0


@pytest.mark.parametrize("build", [risk.top_contributors, risk.risk_reasons])
def test_hot_cases_rank_as_usual_ones(spark, build):
    rows = [
        item(100 - i, group=(None, "A", "B")[i % 3], severity=("NONE", "LOW", "CRITICAL", "HIGH")[i % 4], case=case, available=i % 7 > 0,
             confidence=(0.3, 0.6, 0.95)[i % 3], category=("REGISTRY_STATUS", "MACHINE_READABLE")[i % 2])
        for case, size in ((1, 60), (2, 5), (3, 40)) for i in range(size)
    ]
    given = spark.createDataFrame(rows, EVIDENCE)
    usual, mixed = build(given), build(given, hot_rows=20)
    assert usual.count() > 11 and usual.dtypes == mixed.dtypes
    assert sorted(usual.collect()) == sorted(mixed.collect())
