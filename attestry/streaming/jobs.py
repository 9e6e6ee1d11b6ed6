"""Structured Streaming forms of the jobs.

Jobs that look records up or extend the ledger apply the batch operators to each micro-batch; every batch
writes to its own ``batch_id`` folder and replaces it on a retry, so a batch counts once. Jobs over event time are in
``watermarks``, the case state is in ``cases``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.dims import COMPARISON_METHODS, TRANSIENT_OUTCOMES
from attestry.operators import ledger, registry
from attestry.session import shared_folder

SESSION_GAP, LATE_BY = "15 minutes", "15 minutes"
FRESH_FOR = "300 seconds"
MODULES = ("M1", "M2", "M3", "M4", "M5")


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The given table as a file stream; the schema comes from the table, not from inference per batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def run_batches(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


# ---------------------------------------------------------------------------------------
# Module results that arrive separately


def assemble_sessions(results: DataFrame) -> DataFrame:
    """Latest result per module of each verification session; an update extends the session."""
    # of equal times the later event decides, or the larger result where events have no id
    tie = [c for c in ("event_id", "result") if c in results.columns]
    latest = [F.max_by(F.col("result"), F.when(F.col("module") == m, F.struct("ts", *tie))).alias(m.lower()) for m in MODULES]
    grouped = results.groupBy("verification_id", F.session_window("ts", SESSION_GAP).alias("session"))
    return grouped.agg(*latest, F.count("*").alias("updates")).select(
        "verification_id", F.date_format("session.start", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.date_format("session.end", "yyyy-MM-dd HH:mm:ss").alias("expires_at"), *[m.lower() for m in MODULES], "updates",
    )


# ---------------------------------------------------------------------------------------
# Lookups


def fresh_lookups(lookups: DataFrame) -> DataFrame:
    """First answer per document type, number and provider in each freshness period.

    Periods are aligned, so no reused answer is older than FRESH_FOR and the result does not
    depend on how the input is cut into batches. Repeats collapse before the shuffle.
    Transient outcomes are no answers: they neither pass nor keep a later answer from passing.
    """
    answered = lookups.filter(~F.col("outcome").isin(*TRANSIENT_OUTCOMES))
    grouped = answered.groupBy("document_type", "query_hash", "provider", F.window("ts", FRESH_FOR).alias("w"))
    first = F.min_by(F.struct("event_id", "outcome"), F.struct("ts", "event_id"))
    return grouped.agg(first.alias("a"), F.count("*").alias("served")).select(
        "document_type", "query_hash", "provider", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("period"),
        "a.event_id", "a.outcome", "served",
    )


def registry_stream(submissions: DataFrame, official: DataFrame, watchlist: DataFrame, folder: str) -> DataFrame:
    """Registry outcome of every incoming document against the static registry.

    A micro-batch comes as rows already computed, so nothing is pruned inside it: only the columns that are compared enter.
    """
    used = {"verification_id", "document_type", "issue_date", *COMPARISON_METHODS}
    submissions = submissions.select(*[c for c in submissions.columns if c in used])

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(registry.registry_outcome(batch, official, watchlist), f"{folder}/out", batch_id)

    run_batches(submissions, folder, handle)
    return submissions.sparkSession.read.parquet(f"{folder}/out").drop("batch_id")


# ---------------------------------------------------------------------------------------
# Ledger


def ledger_stream(events: DataFrame, folder: str) -> DataFrame:
    """Extends the ledger batch by batch; events without target or type go to ``dead_letter``.

    Each batch reads the heads left by the batch before it and writes the heads it leaves, so the cost of a batch
    does not grow with the length of the ledger. Repeats of an event are dropped by target and event id from the
    stream's state, whichever batch they come in; an event that arrives late is appended in order of arrival, and
    within a batch events are appended in order of their ids.
    """
    spark = events.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        usable = F.col("target_id").isNotNull() & F.col("event_type").isNotNull()
        write_batch(batch.filter(~usable), f"{folder}/dead_letter", batch_id)
        heads = spark.read.parquet(f"{folder}/heads/batch_id={batch_id - 1}") if batch_id > 0 else None
        write_batch(ledger.ledger_build(batch.filter(usable), heads=heads), f"{folder}/blocks", batch_id)
        latest = ledger.block_heads(spark.read.parquet(f"{folder}/blocks/batch_id={batch_id}"))
        if heads is not None:
            latest = latest.unionByName(heads.join(latest, "target_id", "left_anti"))
        write_batch(latest, f"{folder}/heads", batch_id)

    run_batches(events.dropDuplicates(["target_id", "event_id"]), folder, handle)
    return spark.read.parquet(f"{folder}/blocks").drop("batch_id")
