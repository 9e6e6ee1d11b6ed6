"""Stores, intake and streams over small folders."""

from conftest import SMALL
from pyspark.sql import functions as F

from attestry.operators import ledger, registry
from attestry.plans.fixtures import stream, table
from attestry.sources import intake, stores, tables
from attestry.streaming import jobs

SECRET, KEY = b"test secret", bytes(range(32))


def test_intake(spark, tmp_path):
    files = {
        "a.jpg": b"\xff\xd8\xff\xe0rest", "b.png": b"\x89PNG\r\n\x1a\nrest", "c.webp": b"RIFF1234WEBPVP8 ",
        "d.jpg": b"%PDF-1.7", "e.bin": b"hello", "f.jpg": b"\xff\xd8\xff" + b"0" * intake.MAX_BYTES,
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    accepted, quarantined = intake.intake_manifest(spark, str(tmp_path))
    assert {r.path[-5:] for r in accepted.collect()} == {"a.jpg", "b.png", ".webp"}
    reasons = {r.path[-5:]: r.reason for r in quarantined.collect()}
    assert reasons == {"d.jpg": "TYPE_NOT_ALLOWED", "e.bin": "UNRECOGNISED_FORMAT", "f.jpg": "FILE_TOO_LARGE"}


def test_registry_store_scan_and_purge(spark, tmp_path):
    records = table(spark, SMALL, "registry")
    path = str(tmp_path / "registry")
    stores.write_registry(records, path, SECRET, KEY)
    stored = spark.read.parquet(path)
    assert stored.join(records, stored.document_number == records.document_number).isEmpty()
    back = stores.scan_registry_by_type(spark, path, "passport", KEY).select("record_id", "document_number", "name")
    plain = records.filter("document_type = 'passport'").select("record_id", "document_number", "name")
    assert back.exceptAll(plain).isEmpty() and back.count() == plain.count()
    wrong = stores.scan_registry_by_type(spark, path, "passport", bytes(32))
    assert wrong.filter(F.col("name").isNotNull()).isEmpty()
    assert stores.purge_registry_type(spark, [path], "passport") == plain.count()
    assert spark.read.parquet(path).filter("document_type = 'passport'").isEmpty()


def test_blind_index_finds_the_same_records(spark):
    records = table(spark, SMALL, "registry")
    protected = registry.protect_registry(records, SECRET, KEY)
    pads = registry.blind_index_pads(SECRET, ["passport", "visa", "driving_license", "pan_card", "border_permit", "aadhaar", "voter_id"])
    probes = table(spark, SMALL, "registry").withColumn("blind_index", registry.blind_index(F.col("document_type"), F.lower("document_number"), pads))
    joined = probes.select("blind_index", "document_type").distinct().join(protected, ["blind_index", "document_type"])
    assert joined.count() == records.count()


def test_ledger_store(spark, tmp_path):
    blocks = ledger.ledger_build(table(spark, SMALL, "ledger_events"))
    path = str(tmp_path / "ledger")
    stores.append_ledger(blocks, path)
    target = blocks.first().target_id
    one = stores.read_ledger(spark, path, target)
    assert one.count() == blocks.filter(F.col("target_id") == target).count()
    assert stores.read_ledger(spark, path).count() == blocks.count()


def test_case_documents_schema_is_not_inferred(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"case_id": "1", "traveler_data": {"docNumber": "A"}, "document_revision": 2}\n')
    df = tables.load_case_documents(spark, str(tmp_path / "d.json"), "json")
    assert df.first().traveler_data == {"docNumber": "A"} and "module_statuses" in df.columns


def test_ledger_stream_over_several_batches(spark, tmp_path):
    """Batches that extend and repeat the ledger give the chain of one build."""
    events = table(spark, SMALL, "ledger_events").filter("target_id < 5")
    source, folder = str(tmp_path / "in"), str(tmp_path / "work")
    schema = events.schema
    cuts = [(0, 300), (200, 700), (700, 10**9)]  # the second batch repeats events of the first
    for low, high in cuts:
        events.filter(f"event_id >= {low} AND event_id < {high}").coalesce(1).write.mode("append").parquet(source)
        blocks = jobs.ledger_stream(spark.readStream.schema(schema).parquet(source), folder)
    whole = ledger.ledger_build(events)
    assert blocks.select(*whole.columns).exceptAll(whole).isEmpty() and blocks.count() == whole.count()
    assert ledger.ledger_verify(blocks).filter(~F.col("chain_valid")).isEmpty()


def test_ledger_stream_keeps_late_events(spark, tmp_path):
    """Lower ids that arrive later are appended, repeats are not, and unusable events go to the dead letters."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "target_id long, event_id long, event_type string, recorded_at string, payload string"
    for ids in ([1, 2, 5], [3, 4, 6, 5], [6, 1, 0]):
        rows = [(1, i, "view", "2024-01-01", f"p{i}") for i in ids] + [(None, 90 + ids[0], "view", "2024-01-01", "x")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        blocks = jobs.ledger_stream(spark.readStream.schema(schema).parquet(source), folder)
    order = [r.event_id for r in blocks.orderBy("block_index").collect()]
    assert order == [1, 2, 5, 3, 4, 6, 0]
    assert ledger.ledger_verify(blocks).first().chain_valid
    assert spark.read.parquet(f"{folder}/dead_letter").count() == 3


def test_session_ties_do_not_depend_on_order(spark):
    rows = [("v", "2024-01-01 00:00:00", "M1", 2.0), ("v", "2024-01-01 00:00:00", "M1", 1.0), ("v", "2024-01-01 00:00:00", "M2", 5.0)]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "verification_id string, ts string, module string, result double").withColumn("ts", F.to_timestamp("ts"))
        assert jobs.assemble_sessions(df).first().m1 == 2.0


def test_fresh_lookups(spark):
    rows = [(1, "2024-01-01 00:00:10", "TIMEOUT"), (2, "2024-01-01 00:01:00", "MATCHED"), (3, "2024-01-01 00:04:59", "MISMATCH"), (4, "2024-01-01 00:05:01", "REVOKED")]
    df = spark.createDataFrame(rows, "event_id int, ts string, outcome string").selectExpr(
        "event_id", "to_timestamp(ts) AS ts", "outcome", "'passport' AS document_type", "'h' AS query_hash", "'p' AS provider"
    )
    got = {(r.event_id, r.served) for r in jobs.fresh_lookups(df).collect()}
    assert got == {(2, 2), (4, 1)}


def test_registry_stream_computes_compared_columns_only(spark, tmp_path):
    """Every micro-batch computed all columns of the documents twice, those of the machine readable zone too."""
    folder = "/root/testdata/sf0.001"
    static = [table(spark, folder, n) for n in ("registry", "watchlist")]
    unread = F.when(F.col("verification_id").isNotNull(), F.raise_error(F.lit("an unused column was computed"))).cast("string")
    got = jobs.registry_stream(stream(spark, folder, "submissions").withColumn("mrz_line1", unread), *static, str(tmp_path / "out"))
    want = registry.registry_outcome(table(spark, folder, "submissions"), *static)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
