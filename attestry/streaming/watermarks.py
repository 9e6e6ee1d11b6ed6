"""Streams whose results are complete: what is closed, what is still open, and what came late.

Each micro-batch is split by the watermark of the batches before it. Rows behind it go to ``late``; the others meet
the state that the batch before left, as parquet in the shared folder, and leave closed results and a new state.
A batch reads the state of its predecessor only, never the history, and replaces its own folders on a retry. The
work is that of the batch operators: partial aggregates before the shuffle, no Python worker, no key held by one task.

Sessions and latency windows are kept as partials that merge, so late rows can be merged in afterwards and the result
equals the batch job over all rows, however they were cut. Results that follow the order of rows (freshness
of lookups, stage order) are decided once the watermark has passed; late rows cannot change them and are returned.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import freshness, telemetry
from attestry.session import checkpointed
from attestry.streaming.jobs import LATE_BY, MODULES, SESSION_GAP, run_batches, write_batch

SECOND = 1_000_000
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
Advance = Callable[[DataFrame | None, DataFrame, int | None], tuple[DataFrame, DataFrame]]


def micros(length: str) -> int:
    """Microseconds of a length such as ``15 minutes``."""
    number, unit = length.split()
    return int(number) * UNITS[unit.rstrip("s")] * SECOND


class WatermarkedRun:
    """One run's folders. ``advance`` makes (closed results, new state) of state, rows in time and watermark."""

    def __init__(self, stream: DataFrame, folder: str, time: str, late_by: str, advance: Advance):
        self.spark, self.folder, self.time, self.late_by, self.advance = stream.sparkSession, folder, time, micros(late_by), advance
        run_batches(stream.withColumn(time, F.col(time).cast("timestamp")), folder, self._handle)
        self.last = self.spark.read.parquet(f"{folder}/marks").agg(F.max("batch_id")).first()[0]

    def _part(self, name: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/batch_id={batch_id}")

    def _handle(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        before = self._part("marks", batch_id - 1).first().mark if batch_id else None
        at = F.unix_micros(self.time)
        newest = batch.agg(F.max(at)).first()[0]
        marks = [before] if before is not None else []
        mark = max([*marks, newest - self.late_by] if newest is not None else marks, default=None)
        # rows without a time can be placed nowhere and are kept with the late ones
        late = F.coalesce(at < F.lit(before), at.isNull())
        write_batch(batch.filter(late), f"{self.folder}/late", batch_id)
        closed, state = self.advance(self._part("state", batch_id - 1) if batch_id else None, batch.filter(~late), mark)
        write_batch(closed, f"{self.folder}/closed", batch_id)
        write_batch(state, f"{self.folder}/state", batch_id)
        write_batch(self.spark.createDataFrame([(mark,)], "mark long"), f"{self.folder}/marks", batch_id)
        batch.unpersist()

    def closed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/closed").drop("batch_id")

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/late").drop("batch_id")

    def state(self) -> DataFrame:
        return self._part("state", self.last)


def reconciled(closed: DataFrame, opened: DataFrame, late: DataFrame, keys: list[str], merge: Callable[..., DataFrame]) -> DataFrame:
    """Partials with their ``state``: open if one of their parts is, else amended if late rows are in them, else closed.

    Only partials whose keys have late rows are merged again.
    """
    both = closed.withColumn("rank", F.lit(0)).unionByName(opened.withColumn("rank", F.lit(2)))
    named = both.join(late.select(*keys).distinct().withColumn("touched", F.lit(True)), keys, "left")
    parts = named.filter("touched").drop("touched").unionByName(late.withColumn("rank", F.lit(1)))
    every = named.filter("touched IS NULL").drop("touched").unionByName(merge(parts, F.max("rank").alias("rank")))
    state = F.element_at(F.array(*[F.lit(x) for x in ("closed", "amended", "open")]), F.col("rank") + 1)
    return every.withColumn("state", state).drop("rank")


# ---------------------------------------------------------------------------------------
# Sessions of module results


def session_parts(results: DataFrame) -> DataFrame:
    """One partial session per row: its time, and its result under its module."""
    tie = [c for c in ("event_id", "result") if c in results.columns]
    latest = F.struct(F.col("ts"), *tie, *[F.col("result")][: "result" not in tie])
    slots = [F.when(F.col("module") == m, latest).alias(m.lower()) for m in MODULES]
    return results.withColumn("ts", F.col("ts").cast("timestamp")).select(
        "verification_id", F.col("ts").alias("first_at"), F.col("ts").alias("last_at"), *slots, F.lit(1).cast("long").alias("updates")
    )


def merge_sessions(parts: DataFrame, *more: Column, gap: str = SESSION_GAP) -> DataFrame:
    """Partial sessions that lie less than the gap apart become one, with ``more`` aggregates; they combine before the shuffle."""
    length = (F.unix_micros("last_at") - F.unix_micros("first_at") + micros(gap)).cast("decimal(24,6)") / SECOND
    window = F.session_window("first_at", F.make_interval(secs=length.cast("decimal(18,6)")))
    slots = [m.lower() for m in MODULES]
    return parts.groupBy("verification_id", window.alias("w")).agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), *[F.max(m).alias(m) for m in slots], F.sum("updates").alias("updates"), *more
    ).drop("w")


def session_stream(results: DataFrame, folder: str, late_by: str = LATE_BY, gap: str = SESSION_GAP) -> DataFrame:
    """All sessions of a stream of module results: closed, still open, or amended by late rows."""

    def advance(state, rows, mark):
        parts = session_parts(rows) if state is None else session_parts(rows).unionByName(state)
        merged = checkpointed(merge_sessions(parts, gap=gap))
        over = F.coalesce(F.unix_micros("last_at") + micros(gap) <= F.lit(mark), F.lit(False))
        return merged.filter(over), merged.filter(~over)

    run = WatermarkedRun(results, folder, "ts", late_by, advance)
    late = session_parts(run.late().filter("ts IS NOT NULL"))
    every = reconciled(run.closed(), run.state(), late, ["verification_id"], partial(merge_sessions, gap=gap))
    end = F.timestamp_micros(F.unix_micros("last_at") + micros(gap))
    return every.select(
        "verification_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("expires_at"),
        *[F.col(m.lower()).getField("result").alias(m.lower()) for m in MODULES], "updates", "state",
    )


# ---------------------------------------------------------------------------------------
# Latency windows


def latency_stream(events: DataFrame, folder: str, length: str = "1 hour", slide: str | None = None, late_by: str = LATE_BY) -> DataFrame:
    """Latency per stage and window of a stream: closed, open or amended windows, quantiles from merged sketches."""
    slide = slide or length

    def advance(state, rows, mark):
        panes = telemetry.latency_panes(rows, slide)
        merged = checkpointed(telemetry.merge_panes(panes if state is None else panes.unionByName(state)))
        # the last window a pane belongs to ends one length after the pane began
        over = F.coalesce(F.unix_micros("pane") + micros(length) <= F.lit(mark), F.lit(False))
        return merged.filter(over), merged.filter(~over)

    run = WatermarkedRun(events, folder, "started_at", late_by, advance)
    late = telemetry.latency_panes(run.late().filter("started_at IS NOT NULL"), slide)
    panes = reconciled(run.closed(), run.state(), late, ["pane", "stage"], telemetry.merge_panes)
    return telemetry.latency_windows(panes, length, slide, states=True)


# ---------------------------------------------------------------------------------------
# Results that follow the order of rows


def lookup_stream(lookups: DataFrame, folder: str, late_by: str = LATE_BY) -> DataFrame:
    """Answers with the lookups each served within its freshness, closed or open; late lookups are rows of their own.

    The state holds rows ahead of the watermark and answers that are still fresh at it.
    """

    def advance(state, rows, mark):
        rows = freshness.as_answers(rows)
        known = rows if state is None else rows.unionByName(state)
        # an answer that is carried on counts for what it has served so far
        due = F.coalesce(F.unix_micros("ts") < F.lit(mark), F.lit(False))
        served = checkpointed(freshness.fresh_answers(known.filter(due)))
        over = F.unix_micros("ts") + freshness.FRESH_MICROS < F.lit(mark)
        return served.filter(over), served.filter(~over).unionByName(known.filter(~due))

    run = WatermarkedRun(lookups, folder, "ts", late_by, advance)
    late = freshness.as_answers(run.late().filter("ts IS NOT NULL")).withColumn("state", F.lit("late"))
    opened = freshness.fresh_answers(run.state()).withColumn("state", F.lit("open"))
    return freshness.reported(run.closed().withColumn("state", F.lit("closed")).unionByName(opened).unionByName(late), "state")


def stage_order_stream(events: DataFrame, folder: str, late_by: str = LATE_BY) -> DataFrame:
    """Every step against the step before it: closed, open or late (which has no place in the order any more).

    The state holds rows ahead of the watermark and the last decided step of every verification.
    """
    columns = ["verification_id", "event_id", "started_at", "stage", "status"]

    def decided(rows, carried):
        return telemetry.stage_order(rows.select(*columns), after=carried, keep=["started_at"])

    def split(state):
        return state.filter("step IS NULL"), state.filter("step IS NOT NULL").select("verification_id", "step", "stage")

    def advance(state, rows, mark):
        rows = rows.select(*columns, F.lit(None).cast("long").alias("step"))
        held, carried = split(state) if state is not None else (rows.limit(0), None)
        known = rows.unionByName(held.select(*rows.columns))
        due = F.coalesce(F.unix_micros("started_at") < F.lit(mark), F.lit(False))
        steps = checkpointed(decided(known.filter(due), carried))
        last = steps.groupBy("verification_id").agg(F.max_by(F.struct("step", "stage"), "step").alias("s")).select("verification_id", "s.*")
        if carried is not None:
            last = last.unionByName(carried.join(last, "verification_id", "left_anti"))
        return steps, known.filter(~due).unionByName(last, allowMissingColumns=True)

    run = WatermarkedRun(events, folder, "started_at", late_by, advance)
    held, carried = split(run.state())
    opened = decided(held, carried).withColumn("state", F.lit("open"))
    late = run.late().select(*columns, F.lit(None).cast("long").alias("step"), F.lit("LATE").alias("progress"), F.lit("late").alias("state"))
    every = run.closed().withColumn("state", F.lit("closed")).unionByName(opened).unionByName(late.select(*opened.columns))
    return every.select("verification_id", "step", "event_id", "stage", "status", "progress", "state")
