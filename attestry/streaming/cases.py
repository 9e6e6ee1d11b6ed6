"""Case state on a stream: documents are added, replaced and removed, and a case expires an hour after its last document.

The state is keyed by case and held by the state store: a list of the latest row of every document, and the times of the case's
first and last document. A batch reads and writes it as a whole; rows are only rewritten where one is replaced. A batch touches the cases it has rows for and hands on their documents; their risk is then that of the batch
operator over these documents alone. No batch reads the history of the stream.

A document's later row replaces the earlier one, whichever arrives first. A row more than the expiry after the case's last
one starts the case anew; rows of a batch that belong to a case that is gone, or have no time, are returned as late.
Event-time timers clear the state of a case once the watermark has passed its expiry.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attestry.operators import crossdoc
from attestry.session import checkpointed
from attestry.streaming.jobs import LATE_BY, run_batches, write_batch

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRY_SECONDS = 3600
KEY, DOCUMENT = "case_id", "document_id"
NEVER_LATE = "9999-12-31 00:00:00"


class CaseDocuments(StatefulProcessor):
    """Hands on the documents of every case a batch has rows for, and the cases that expire."""

    def __init__(self, fields: list[str], stored: T.StructType, expiry: int | None):
        self.fields, self.stored = fields, stored
        self.expiry = None if expiry is None else expiry * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.documents = handle.getListState("documents", self.stored)
        self.span = handle.getValueState("span", "first long, last long")

    def _row(self, key, values, state: str) -> Row:
        return Row(**{KEY: key[0], **dict(zip(self.fields, values, strict=True)), "state": state})

    def _timer(self, last: int) -> int:
        return (last + self.expiry) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a batch bounds the rows of a case that are sorted here; every call of the state is a round trip, so there are few per case
        late, taken = [], []
        held = self.span.get()
        before = first, last = held or (None, None)
        for row in sorted(rows, key=lambda r: (r["__at"] is None, r["__at"] or 0)):
            at = row["__at"]
            if at is None or (self.expiry is not None and first is not None and at + self.expiry < first):
                late.append(row)
                continue
            if self.expiry is not None and last is not None and at > last + self.expiry:
                held = None
                late, taken, first, last = late + taken, [], None, None
            taken.append(row)
            first = at if first is None else min(first, at)
            last = at if last is None else max(last, at)
        for row in late:
            yield self._row(key, [row[f] for f in self.fields], "late")
        if not taken:
            # a batch of late rows alone leaves the case as it is
            if held is not None:
                for stored in self.documents.get():
                    yield self._row(key, stored[1:], "open")
            return
        # rows are in order of time, so the last row of a document is its latest one
        latest = {row[DOCUMENT] or "": (row["__at"], *[row[f] for f in self.fields]) for row in taken}
        name, replaced = self.fields.index(DOCUMENT) + 1, False
        if held is not None:
            for stored in self.documents.get():
                new = latest.get(stored[name] or "")
                if new is not None and stored[0] <= new[0]:
                    replaced = True
                    continue
                if new is not None:
                    del latest[stored[name] or ""]
                yield self._row(key, stored[1:], "open")
        added = list(latest.values())
        if replaced:
            gone = set(latest)
            self.documents.put([s for s in self.documents.get() if (s[name] or "") not in gone] + added)
        elif held is None:
            self.documents.put(added)
        elif added:
            self.documents.appendList(added)
        if (first, last) != before:
            self.span.update((first, last))
        if self.expiry is not None and last != before[1]:
            if before[1] is not None:
                self.handle.deleteTimer(self._timer(before[1]))
            self.handle.registerTimer(self._timer(last))
        for stored in added:
            yield self._row(key, stored[1:], "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.documents.clear()
        self.span.clear()
        yield self._row(key, [None] * len(self.fields), "expired")

    def close(self) -> None:
        pass


def with_clock(rows: DataFrame, time: str, late_by: str) -> DataFrame:
    """``rows`` with an event-time column ``clock`` that moves the watermark but never makes a row late.

    Spark drops rows behind the watermark before a stateful operator sees them. The watermark is therefore read off a copy
    of the times that passes no row, and the rows themselves carry a time that is never behind it.
    """
    clock = F.col(time).cast("timestamp").alias("clock")
    ticks = rows.select(clock, *rows.columns).withWatermark("clock", late_by).filter("clock < TIMESTAMP '0001-01-01 00:00:01'")
    return ticks.unionByName(rows.withColumn("clock", F.lit(NEVER_LATE).cast("timestamp")))


def case_stream(
    documents: DataFrame, evidence: DataFrame, folder: str, expiry: int | None = EXPIRY_SECONDS, time: str = "uploaded_at", late_by: str = LATE_BY
) -> DataFrame:
    """Risk of every case of a stream of documents, as of its last batch, with ``state`` open or expired.

    Without ``expiry`` cases stay open for ever. Late rows are written to ``late`` in ``folder``.
    """
    spark = documents.sparkSession
    fields = [c for c in documents.columns if c != KEY]
    # the state's column names are its own: fields may bear any name
    stored = T.StructType([T.StructField("at", T.LongType()), *[T.StructField(f"f{i}", documents.schema[c].dataType) for i, c in enumerate(fields)]])
    shown = T.StructType([documents.schema[KEY], *[T.StructField(c, documents.schema[c].dataType) for c in fields], T.StructField("state", T.StringType())])
    rows = documents.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
    if expiry is not None:
        rows = with_clock(rows, time, late_by)
    # executors get the class itself, so they need not have this package
    register_pickle_by_value(sys.modules[__name__])
    processor = CaseDocuments(fields, stored, expiry)
    changed = rows.groupBy(KEY).transformWithState(processor, shown, "append", "none" if expiry is None else "eventTime")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = checkpointed(batch)
        write_batch(batch.filter("state = 'late'").drop("state"), f"{folder}/late", batch_id)
        write_batch(batch.filter("state = 'expired'").select(KEY), f"{folder}/expired", batch_id)
        current = batch.filter("state = 'open'").drop("state")
        # a batch that only ends cases has no risk to compute; the first one always leaves the table's schema
        if batch_id > 0 and current.isEmpty():
            return
        named = current.select(DOCUMENT).distinct()
        write_batch(crossdoc.case_risk(current, evidence.join(named, DOCUMENT, "left_semi")), f"{folder}/cases", batch_id)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        run_batches(changed, folder, handle)
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    states = spark.read.parquet(f"{folder}/cases")
    names = [c for c in states.columns if c not in (KEY, "batch_id")]
    risks = states.groupBy(KEY).agg(F.max_by(F.struct(*names), "batch_id").alias("s"), F.max("batch_id").alias("changed"))
    ended = spark.read.parquet(f"{folder}/expired").groupBy(KEY).agg(F.max("batch_id").alias("ended"))
    # timers run after the rows of a batch, so a case that expires in a batch has not been touched since
    state = F.when(F.col("ended") >= F.col("changed"), "expired").otherwise("open")
    return risks.join(ended, KEY, "left").select(KEY, "s.*", state.alias("state"))
