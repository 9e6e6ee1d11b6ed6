"""Streams cut into micro-batches at random, with rows out of order and late, against the batch jobs and plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestry.operators import crossdoc, freshness, telemetry
from attestry.plans.fixtures import table
from attestry.streaming import cases, jobs, watermarks

SMALL = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def run_in_batches(spark, tmp_path, schema, batches, run):
    """Result of ``run`` after each of the batches (lists of rows) has arrived as one file."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "work")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        found = run(spark.readStream.schema(schema).parquet(source), folder)
    return found


def cut(rows, key, n, disorder, rng):
    """Rows in order of arrival (up to ``disorder`` seconds out of order), in ``n`` batches."""
    rows = sorted(rows, key=lambda r: key(r) + rng.uniform(0, disorder))
    marks = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *marks], [*marks, len(rows)], strict=True)]


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


# ------------------------------------------------------------------ sessions

SESSION = "verification_id string, ts timestamp, module string, result double"


@pytest.mark.parametrize("disorder", [0, 600, 20_000])
def test_sessions_of_any_batches_equal_the_batch_job(spark, tmp_path, disorder):
    rng = random.Random(disorder)
    # one verification holds a third of all rows; the last rows are far later, so most sessions close
    rows = [(f"v{rng.randrange(6) if i % 3 else 0}", at(rng.randrange(30_000)), f"M{rng.randrange(1, 7)}", float(i)) for i in range(250)]
    batches = cut(rows, lambda r: (r[1] - START).total_seconds(), 4, disorder, rng)
    got = run_in_batches(spark, tmp_path, SESSION, batches, watermarks.session_stream)
    want = jobs.assemble_sessions(spark.createDataFrame(rows, SESSION)).collect()
    assert same(got.drop("state").collect(), want)
    states = {r.state for r in got.select("state").collect()}
    assert "open" in states and ("amended" if disorder == 20_000 else "closed") in states and ("amended" in states) == (disorder == 20_000)


def test_sessions_keep_rows_without_time_and_cope_with_nothing(spark, tmp_path):
    batches = [[("v", None, "M1", 1.0)], [("v", at(0), "M1", None), (None, at(5), "M2", 2.0)], [("v", at(0), "M1", 3.0)]]
    got = run_in_batches(spark, tmp_path, SESSION, batches, watermarks.session_stream)
    assert {(r.verification_id, r.m1, r.m2, r.updates, r.state) for r in got.collect()} == {("v", 3.0, None, 2, "open"), (None, None, 2.0, 1, "open")}
    assert spark.read.parquet(str(tmp_path / "work/late")).count() == 1


# ------------------------------------------------------------------ freshness

LOOKUP = "event_id long, ts timestamp, document_type string, query_hash string, provider string, outcome string"


def brute_fresh(rows):
    served = {}
    last = {}
    for e, t, kind, h, p, outcome in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        if outcome in ("TIMEOUT", "ERROR") or not (h or "").strip():
            continue
        key = ((kind or "").strip().lower(), h.strip(), (p or "").strip().lower())
        if key not in last or t > last[key][0] + timedelta(seconds=300):
            last[key] = (t, e, outcome)
        served[key, last[key]] = served.get((key, last[key]), 0) + 1
    return [(*key, t.strftime("%Y-%m-%d %H:%M:%S.%f"), e, outcome, n) for (key, (t, e, outcome)), n in served.items()]


def lookup_rows(rng, n, span):
    kinds = [(" Passport", "h1", "p"), ("passport", "h1 ", "P"), ("visa", "h2", None), (None, "h3", "p"), ("visa", " ", "p"), ("visa", None, "p")]
    key = lambda i: kinds[0] if i % 3 == 0 else rng.choice(kinds)
    return [(i, at(rng.choice([rng.randrange(span), rng.uniform(0, span), 300 * rng.randrange(span // 300)])), *key(i), rng.choice(["MATCHED", "TIMEOUT", "REVOKED"])) for i in range(n)]


@pytest.mark.parametrize(("n", "span"), [(5, 900), (150, 1_500), (400, 60_000), (400, 6_000)])
def test_freshness_starts_with_the_answer(spark, n, span):
    rows = lookup_rows(random.Random(n + span), n, span) + [(10_000, None, "visa", "h2", "p", "MATCHED")]
    got = freshness.fresh_lookups(spark.createDataFrame(rows, LOOKUP)).collect()
    assert same(map(tuple, got), brute_fresh(rows))


def test_one_answer_serves_across_aligned_periods(spark):
    rows = [(i, at(s), "visa", "h", "p", o) for i, (s, o) in enumerate([(10, "TIMEOUT"), (299, "MATCHED"), (301, "REVOKED"), (599, "MATCHED"), (600, "MATCHED")])]
    got = freshness.fresh_lookups(spark.createDataFrame(rows, LOOKUP)).collect()
    assert sorted((r.event_id, r.served) for r in got) == [(1, 3), (4, 1)]
    assert freshness.fresh_lookups(spark.createDataFrame(rows[:1], LOOKUP)).count() == 0


def test_lookups_of_any_batches_equal_the_batch_job(spark, tmp_path):
    rng = random.Random(8)
    rows = lookup_rows(rng, 300, 12_000)
    batches = cut(rows, lambda r: (r[1] - START).total_seconds(), 4, 800, rng)
    got = run_in_batches(spark, tmp_path, LOOKUP, batches, watermarks.lookup_stream)
    assert same([tuple(r)[:-1] for r in got.collect()], brute_fresh(rows))
    late = [(9_000, at(5), "visa", "h2", "p", "MATCHED")]
    again = run_in_batches(spark, tmp_path, LOOKUP, [late], watermarks.lookup_stream).collect()
    assert [r.event_id for r in again if r.state == "late"] == [9_000] and len(again) == len(brute_fresh(rows)) + 1


# ------------------------------------------------------------------ stages and latency

STAGE = "verification_id long, event_id long, started_at timestamp, duration_ms double, stage string, status string"


def stage_rows(rng, n, span):
    pick = lambda i: 0 if i % 3 == 0 else rng.randrange(5)
    status = ["completed", "completed", "skipped", "failed"]
    return [(pick(i), i, at(rng.randrange(span)), float(rng.randrange(1000)), rng.choice(telemetry.STAGES), rng.choice(status)) for i in range(n)]


def test_stage_order_of_any_batches_equals_the_batch_job(spark, tmp_path):
    rng = random.Random(3)
    rows = stage_rows(rng, 300, 20_000)
    batches = cut(rows, lambda r: (r[2] - START).total_seconds(), 4, 800, rng)
    got = run_in_batches(spark, tmp_path, STAGE, batches, watermarks.stage_order_stream)
    want = telemetry.stage_order(spark.createDataFrame(rows, STAGE))
    assert same(got.drop("state").collect(), want.collect())
    late = [(0, 7_000, at(1), 1.0, "STANDBY", "completed"), (0, 7_001, None, 1.0, "STANDBY", "completed")]
    again = run_in_batches(spark, tmp_path, STAGE, [late], watermarks.stage_order_stream).collect()
    assert {r.event_id: r.progress for r in again if r.state == "late"} == {7_000: "LATE", 7_001: "LATE"} and len(again) == len(rows) + 2


@pytest.mark.parametrize("slide", [None, "10 minutes"])
def test_latency_windows_of_any_batches_equal_the_batch_job(spark, tmp_path, slide):
    rng = random.Random(5)
    rows = stage_rows(rng, 300, 30_000)
    batches = cut(rows, lambda r: (r[2] - START).total_seconds(), 4, 20_000, rng)
    got = run_in_batches(spark, tmp_path, STAGE, batches, lambda s, f: watermarks.latency_stream(s, f, "1 hour", slide))
    frame = spark.createDataFrame(rows, STAGE)
    want = telemetry.sliding_latency(frame, "1 hour", slide or "1 hour")
    assert same(got.drop("state").collect(), want.collect())
    assert {r.state for r in got.collect()} >= {"amended", "open"}


def test_rolled_up_quantiles_keep_their_rank_error(spark):
    """Minutes rolled up into hours and days: exact below the sketch's size, within half a percent of the rank beyond."""
    n = 60_000
    rows = spark.range(n).select(F.lit("OCR").alias("stage"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 86_400).alias("started_at"),
                                 (F.col("id") * 7919 % n).cast("double").alias("duration_ms"))
    minutes = telemetry.latency_panes(rows)
    assert minutes.count() == 1000
    hours = telemetry.merge_panes(minutes.withColumn("pane", F.date_trunc("hour", "pane")))
    day = telemetry.latency_windows(hours, "1 day").first()
    assert day.runs == n and abs(day.p50_ms - 0.5 * n) < 0.005 * n and abs(day.p95_ms - 0.95 * n) < 0.005 * n
    few = telemetry.latency_windows(telemetry.merge_panes(telemetry.latency_panes(rows.filter("duration_ms < 1000")).withColumn("pane", F.date_trunc("day", "pane"))), "1 day").first()
    assert (few.p50_ms, few.p95_ms) == (499.0, 949.0)


def test_sliding_latency_is_exact_in_large_windows(spark):
    """Many more rows than a sketch holds, exact halves in the mean, a stage without name, equal and negative values."""
    n = 20_000
    moment = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 7200).alias("started_at")
    many = spark.range(n).select(F.lit("OCR").alias("stage"), moment, (F.col("id") * 7919 % n - 100).cast("double").alias("duration_ms"))
    few = spark.range(200).select(F.lit(None).cast("string").alias("stage"), moment, F.when(F.col("id") == 0, 4742.0).otherwise(4741.105 - 0.897 / 199).alias("duration_ms"))
    got = {(r.window_start, r.stage): r for r in telemetry.sliding_latency(many.unionByName(few), "2 hours", "1 hour").collect()}
    whole = got["2024-01-01 00:00:00", "OCR"]
    assert (whole.runs, whole.avg_ms, whole.p50_ms, whole.p95_ms) == (n, 9899.5, 9899.0, 18899.0)
    second = sorted(i * 7919 % n - 100 for i in range(n) if i % 7200 >= 3600)
    part = got["2024-01-01 01:00:00", "OCR"]
    assert (part.runs, part.p50_ms, part.p95_ms) == (len(second), second[-(-len(second) // 2) - 1], second[-(-len(second) * 95 // 100) - 1])
    assert len(got) == 5 and got["2024-01-01 00:00:00", None].runs == 200


# ------------------------------------------------------------------ cases

CASE = ("case_id string, document_id string, document_type string, status string, uploaded_at timestamp, document_number string, "
        "passport_number string, name string, date_of_birth string, nationality string")  # fmt: skip


def document(case, number, kind, status, seconds, name="ANNA BELL"):
    return (case, f"{case}-{number}", kind, status, at(seconds), "X1234567", "X1234567", name, "1990-01-01", "NLD")


def test_cases_of_any_batches_equal_case_risk(spark, tmp_path):
    docs = table(spark, SMALL, "case_documents").filter("case_id < 40")
    evidence = table(spark, SMALL, "document_evidence")
    rows = docs.orderBy(F.xxhash64("document_id")).collect()
    batches = [rows[:5], rows[5:150], rows[150:]]
    got = run_in_batches(spark, tmp_path, docs.schema, batches, lambda s, f: cases.case_stream(s, evidence, f, None))
    assert same(got.drop("state").collect(), crossdoc.case_risk(docs, evidence).collect())
    # later batches touched some cases only
    written = spark.read.parquet(str(tmp_path / "work/cases")).groupBy("batch_id").count().collect()
    assert {r["count"] for r in written if r.batch_id == 0} == {len({r.case_id for r in rows[:5]})}


def test_cases_expire_and_documents_are_replaced_and_removed(spark, tmp_path):
    evidence = table(spark, SMALL, "document_evidence")
    batches = [
        [document("a", 1, "passport", "ACTIVE", 0), document("a", 2, "visa", "ACTIVE", 10, "OTHER NAME"), document("b", 1, "passport", "ACTIVE", 20), document("g", 1, "visa", "ACTIVE", 5)],
        # the visa's name is put right, and an older row of it arrives afterwards; b's only document is removed
        [document("a", 2, "visa", "ACTIVE", 600), document("b", 1, "passport", "REMOVED", 700)],
        [document("a", 2, "visa", "ACTIVE", 5, "OLDER NAME"), document("c", 1, "passport", "ACTIVE", 6_000)],
        # c goes on, a starts anew, and one row belongs to the a that is gone
        [document("c", 2, "visa", "ACTIVE", 9_000), document("a", 9, "visa", "ACTIVE", 9_100), document("a", 3, "visa", "ACTIVE", 50), document("d", 1, "visa", "ACTIVE", None)],
    ]
    seen = []

    def run(stream, folder):
        found = {r.case_id: r for r in cases.case_stream(stream, evidence, folder).collect()}
        seen.append(found)
        return found

    got = run_in_batches(spark, tmp_path, CASE, batches, run)
    assert seen[0]["a"].conflict_detected and not seen[1]["a"].conflict_detected and not seen[2]["a"].conflict_detected
    assert seen[0]["b"].documents_considered == 1 and seen[1]["b"].documents_considered == 0
    assert seen[1]["g"].state == "open" and seen[2]["g"].state == "expired" and seen[2]["b"].state == "expired"
    assert got["c"].documents_considered == 2 and got["c"].state == "open"
    assert got["a"].documents_considered == 1 and got["a"].state == "open"
    late = spark.read.parquet(str(tmp_path / "work/late")).select("document_id").collect()
    assert sorted(r.document_id for r in late) == ["a-3", "d-1"]


def test_a_batch_that_only_ends_cases_computes_no_risk(spark, tmp_path):
    """The timers of the last rows fire in a batch of their own, which wrote an empty risk table at the cost of a whole one."""
    evidence = table(spark, SMALL, "document_evidence")
    batches = [[document("a", 1, "passport", "ACTIVE", 0), document("b", 1, "passport", "ACTIVE", 20_000)]]
    got = {r.case_id: r.state for r in run_in_batches(spark, tmp_path, CASE, batches, lambda s, f: cases.case_stream(s, evidence, f)).collect()}
    assert got == {"a": "expired", "b": "open"}
    assert [p.name for p in (tmp_path / "work/cases").iterdir()] == ["batch_id=0"]
    assert len(list((tmp_path / "work/expired").iterdir())) > 1


def test_pointers_of_dense_lookups_shrink(spark, monkeypatch):
    """Chains of one key meet; after a few rounds only pointers behind long jumps are left."""
    kept, whole = [], freshness.checkpointed

    def counted(df):
        out = whole(df)
        if out.columns[-1] == "next":
            kept.append(out.count())
        return out

    monkeypatch.setattr(freshness, "checkpointed", counted)
    lookups = spark.range(12000).selectExpr(
        "id AS event_id", "timestamp_seconds(id * 7 + pmod(xxhash64(id), 300)) AS ts", "'passport' AS document_type", "'1' AS query_hash", "'p' AS provider", "'MATCHED' AS outcome"
    )
    asked, last = 0, None
    for t in sorted(r.t for r in lookups.selectExpr("unix_seconds(ts) AS t").collect()):
        if last is None or t > last + 300:
            asked, last = asked + 1, t
    assert freshness.fresh_lookups(lookups).count() == asked
    assert sum(kept) < 5 * kept[0]
