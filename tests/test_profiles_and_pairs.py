"""Profiles given as rows, label pairing on normalised pages, reasons in first order."""

import random

import pytest
from pyspark.sql import functions as F

from attestry import dims
from attestry.operators import faces, pairing, profiles, ranking

SUBMISSION = "verification_id string, document_type string, document_number string, name string, date_of_birth string, issue_date string, expiry_date string"


def test_a_document_type_is_added_by_rows_only(spark):
    rules = [
        ("seaman_book", "required", "name", None, "critical"),
        ("seaman_book", "pattern", "document_number", "SB[0-9]{4}", "warning"),
        ("seaman_book", "min_age", "date_of_birth", "16", "critical"),
        ("seaman_book", "max_age", "date_of_birth", "99", "low"),
        ("seaman_book", "after", "expiry_date", "issue_date", "critical"),
        ("seaman_book", "not_future", "issue_date", None, "critical"),
        ("seaman_book", "anchor", None, "SEAFARER", None),
        ("seaman_book", "token", None, "SHIP", None),
        ("seaman_book", "token", None, "RANK", None),
        ("seaman_book", "aspect", None, "1.4~0.1", None),
    ]
    # the rules come from a table, an unknown type has no checks
    stored = spark.createDataFrame(rules, "document_type string, rule string, field string, argument string, severity string")
    rows = [
        ("ok", " Seaman_Book ", "sb-1234", "A", "1990-02-28", "2020-01-01", "2030-01-01"),
        ("bad", "seaman_book", "SB12", " ", "2010-02-01", "2030-01-01", "2029-01-01"),
        ("odd", "seaman_book", None, None, "1.2.1990", None, "2030-01-01"),
        ("other", "library card", "1", "A", None, None, None),
        ("none", None, None, None, None, None, None),
    ]
    got = profiles.profile_checks(spark.createDataFrame(rows, SUBMISSION), profiles.read_rules(stored), reference="2024-02-01").collect()
    found = {(r.verification_id, r.rule, r.field): (r.status, r.severity) for r in got}
    assert len(found) == 18 and {k[0] for k in found} == {"ok", "bad", "odd"}
    assert {v for k, v in found.items() if k[0] == "ok"} == {("passed", None)}
    failed = {(k[1], k[2]) for k, v in found.items() if k[0] == "bad" and v[0] == "failed"}
    assert failed == {("required", "name"), ("pattern", "document_number"), ("min_age", "date_of_birth"), ("after", "expiry_date"), ("not_future", "issue_date")}
    assert found["odd", "min_age", "date_of_birth"] == ("inconclusive", None) and found["odd", "pattern", "document_number"] == ("passed", None)
    assert found["odd", "after", "expiry_date"] == ("inconclusive", None) and found["odd", "required", "name"] == ("failed", "critical")
    pages = [(1, "seaman_book", "seafarer of the ship, rank 2", 140.0, 100.0), (2, "seaman_book", "ship SHIP", 100.0, 140.0), (3, "seaman_book", None, None, None), (4, "x", "seafarer", 1.0, 1.0)]
    signals = profiles.profile_signals(spark.createDataFrame(pages, "doc_id long, declared_type string, text string, width double, height double"), rules).collect()
    assert {(r.doc_id, r.signals, r.kinds, r.decision, r.confidence) for r in signals} == {
        (1, 3, "anchor,token,aspect", "SUPPORTED", 0.84), (2, 1, "aspect", "LOW_CONFIDENCE", 0.42), (3, 0, "", "UNKNOWN", 0.1), (4, 0, "", "NO_PROFILE", 0.0),
    }


@pytest.mark.parametrize("rule", [("x", "patern", "name", "a", None), ("x", "pattern", "name", None, None), ("x", "required", None, None, None), (None, "required", "name", None, None)])
def test_unknown_rules_are_errors(rule):
    with pytest.raises(ValueError, match="not a rule"):
        profiles.check_rules([rule])


def test_no_documents_and_no_rules(spark):
    empty = spark.createDataFrame([], SUBMISSION)
    assert profiles.profile_checks(empty, dims.PROFILE_RULES).count() == 0
    one = spark.createDataFrame([("a", "passport", None, None, None, None, None)], SUBMISSION)
    assert profiles.profile_checks(one, []).count() == 0


TOKEN = "doc_id long, token_id long, is_label boolean, text string, conf double, x0 double, x1 double, y0 double, y1 double, page_width double, page_height double"


def brute_nearest(tokens, valid):
    out = {}
    for a in tokens:
        best = None
        box = lambda t: (t[5] / t[9], t[6] / t[9], t[7] / t[10], t[8] / t[10])
        al, ar, at, ab = box(a)
        for v in tokens if a[2] else []:
            if v[0] != a[0] or v[2] or not valid(v[3]):
                continue
            vl, vr, vt, vb = box(v)
            mx, my = abs((vl + vr) / 2 - (al + ar) / 2), abs((vt + vb) / 2 - (at + ab) / 2)
            dx, dy = vl - ar, vt - ab
            if 0 <= dx <= 0.6 and min(vb, ab) - max(vt, at) > -0.01:
                best = min(best or (9,), (dx + my * 0.5, v[1], 0))
            if 0 <= dy <= 0.25 and (min(vr, ar) - max(vl, al) > -0.05 or mx <= 0.15):
                best = min(best or (9,), (dy + mx * 0.5, v[1], 1))
        if best:
            out[a[0], a[1]] = (best[1], best[2], round(best[0], 3))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_values_on_pages_of_any_size(spark, seed):
    rng = random.Random(seed)
    tokens = []
    for i in range(400):
        doc = rng.randrange(4)
        w, h = (100.0, 60.0) if doc % 2 else (3000.0, 1700.0)
        x, y = rng.uniform(-0.05, 1) * w, rng.uniform(-0.05, 1) * h
        tokens.append((doc, i, rng.random() < 0.4, rng.choice(["V0", "V1"]), 0.5, x, x + rng.choice([0.02, 0.1, 0.7]) * w, y, y + rng.choice([0.02, 0.1, 0.6]) * h, w, h))
    # equal boxes: the first token answers
    tokens += [(*t[:1], t[1] + 1000, *t[2:]) for t in tokens[:50]]
    frame = spark.createDataFrame(tokens, TOKEN)
    for valid, condition in ((lambda t: True, None), (lambda t: t == "V0", F.col("text") == "V0")):
        got = {(r.doc_id, r.label_token): (r.value_token, int(r.relationship == "LABEL_ABOVE_VALUE"), round(r.distance, 3)) for r in pairing.label_value_nearest(frame, condition).collect()}
        want = brute_nearest(tokens, valid)
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert all(abs(got[k][2] - want[k][2]) < 0.0015 for k in want)


def test_no_grid_cell_holds_the_width_of_a_page(spark):
    """A page of very many tokens: what meets in a cell is a small part of it."""
    tokens = [(0, i, i % 2 == 0, "V", 0.5, float(i % 100), i % 100 + 0.5, float(i // 100), i // 100 + 0.5, 100.0, 100.0) for i in range(10_000)]
    frame = spark.createDataFrame(tokens, TOKEN)
    got = pairing.label_value_nearest(frame)
    assert got.count() > 4_900 and got.filter("distance > 0.02").isEmpty()


def test_distinct_values_keep_their_first_order(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else rng.choice("ab"), rng.choice(["x", "y", "z", None, "w"]), i) for i in range(3000)]
    got = {r.k: r["values"] for r in ranking.distinct_in_order(spark.createDataFrame(rows, "k string, v string, i long"), ["k"], F.col("v"), F.col("i")).collect()}
    want = {}
    for k, v, _ in rows:
        if v is not None and v not in want.setdefault(k, []):
            want[k].append(v)
    assert got == want


def test_reasons_for_a_raised_threshold(spark):
    rows = [("d", "M3", "copy_move", "HIGH", True, 1), ("d", "M2", "mrz", "CRITICAL", True, 2), ("d", "M2", "mrz", "HIGH", True, 3), ("d", "M3", "forensic_high_concern", "LOW", True, 4),
            ("d", "M3", "ela", "HIGH", False, 5), ("e", "M4", "x", "HIGH", True, 6), ("f", "M2", None, "HIGH", True, 7)]
    evidence = spark.createDataFrame(rows, "case_id string, module string, signal string, severity string, available boolean, item_seq int")
    got = {r.document_id: r.reasons for r in faces.elevated_documents(evidence).collect()}
    assert got == {"d": ["m2_validation: mrz", "m3_forensics: copy_move", "m3_forensics: forensic_high_concern"], "f": None}


def test_pages_that_are_cut_into_cells_answer_alike(spark):
    from attestry.plans.fixtures import table

    tokens = table(spark, "/root/testdata/sf0.001", "page_tokens")
    cut, whole = (sorted(map(tuple, pairing.label_value_nearest(tokens, crowd=n).collect())) for n in (0, 64))
    assert cut and cut == whole
