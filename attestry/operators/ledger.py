"""Hash-chained audit ledger, evidence and risk hashes, integrity reports.

One chain over everything is serial by nature. Here every target has its own chain, cut into
segments of ``SEGMENT_BLOCKS`` blocks that start from a hash of target and segment number.
Segment heads are folded into one head per target by a tree of the same width. Work per group
is bounded by the segment size however many events one target has.

Hashed text joins a fixed column order with ``|``; NULL is empty and ``|`` and ``\\`` are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.dims import DEFAULT_RISK, RiskConfig
from attestry.functions.text import case_when
from attestry.operators import risk
from attestry.session import checkpointed
from attestry.operators.ranking import ordinal

SEGMENT_BLOCKS = 64
# 64 ** 5: a thousand million leaves per key
TREE_LEVELS = 5
ZERO_HASH = "0" * 64
RECORD_VERSION, SYSTEM_VERSION = "1.0.0", "1.0.0"


def canonical(*columns: str | Column) -> Column:
    """Fixed-order text of the columns, safe against values that contain the separator."""
    parts = []
    for column in columns:
        value = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
        parts.append(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))
    return F.concat_ws("|", *parts)


def digits(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def _content() -> Column:
    return canonical("block_index", "recorded_at", "target_id", "event_type", "evidence_hash", F.lit(RECORD_VERSION), F.lit(SYSTEM_VERSION))


def segment_start(target: Column, segment: Column) -> Column:
    return F.sha2(canonical(target, segment), 256)


def link(previous: Column, content: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), content), 256)


def ledger_events(events: DataFrame) -> DataFrame:
    """Audit events of every target: the payload is anchored by its hash."""
    return events.select("target_id", "event_id", "event_type", "recorded_at", F.sha2("payload", 256).alias("evidence_hash"))


def chain_blocks(numbered: DataFrame, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """Hashes numbered events. ``last_hash`` continues a segment that earlier blocks began."""
    blocks = numbered.withColumn("segment", F.floor((F.col("block_index") - 1) / segment_blocks)).withColumn("content", _content())
    fields = ["block_index", "event_id", "event_type", "recorded_at", "evidence_hash", "content"]
    segments = blocks.groupBy("target_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("blocks"), F.max("last_hash").alias("last_hash")
    )
    fresh = F.get("blocks", F.lit(0))["block_index"] == F.col("segment") * segment_blocks + 1
    start = F.when(fresh, segment_start(F.col("target_id"), F.col("segment"))).otherwise(F.col("last_hash"))
    hashes = F.aggregate(
        "blocks", F.array(start), lambda acc, b: F.concat(acc, F.array(link(F.element_at(acc, -1), b["content"])))
    )
    chained = segments.withColumn("hashes", hashes)
    rows = chained.select("target_id", "segment", "hashes", F.posexplode("blocks").alias("i", "b"))
    return rows.select(
        "target_id", "segment", "b.block_index", "b.event_id", "b.event_type", "b.recorded_at", "b.evidence_hash",
        F.get("hashes", F.col("i")).alias("previous_hash"), F.get("hashes", F.col("i") + 1).alias("block_hash"),
    )


def ledger_build(
    events: DataFrame,
    segment_blocks: int = SEGMENT_BLOCKS,
    heads: DataFrame | None = None,
) -> DataFrame:
    """Blocks of every target in order of event_id, each bound to the block before it.

    ``heads`` (target_id, last_index, last_hash) lets new events extend an existing ledger.
    """
    numbered = ordinal(ledger_events(events), ["target_id"], [F.asc("event_id")], "block_index")
    if heads is None:
        numbered = numbered.withColumn("last_hash", F.lit(None).cast("string"))
    else:
        numbered = numbered.join(heads, "target_id", "left").withColumn(
            "block_index", F.col("block_index") + F.coalesce("last_index", F.lit(0))
        )
    return chain_blocks(numbered, segment_blocks)


def block_heads(blocks: DataFrame) -> DataFrame:
    """Last index and hash per target."""
    return blocks.groupBy("target_id").agg(
        F.max("block_index").alias("last_index"), F.max_by("block_hash", "block_index").alias("last_hash")
    )


def fold_tree(leaves: DataFrame, keys: list[str], width: int = SEGMENT_BLOCKS, levels: int = TREE_LEVELS) -> DataFrame:
    """One hash per key over its ``leaf`` values in order of the dense, zero-based ``position``.

    The number of levels is fixed and holds ``width ** levels`` leaves per key; more of them end the job with an
    error instead of a hash of a part. A key whose nodes are down to one keeps that node, so further levels change
    nothing and a key's hash depends on its own leaves only.
    """
    nodes = leaves
    for level in range(levels):
        group = F.floor(F.col("position") / width)
        grouped = nodes.withColumn("_group", group).groupBy(*keys, "_group").agg(
            F.array_sort(F.collect_list(F.struct("position", "leaf"))).alias("_nodes")
        )
        joined = F.sha2(F.array_join(F.transform("_nodes", lambda n: n["leaf"]), "\n"), 256)
        alone = (F.size("_nodes") == 1) & (F.col("_group") == 0) & F.lit(level > 0)
        nodes = grouped.select(
            *keys, F.col("_group").alias("position"), F.when(alone, F.col("_nodes")[0]["leaf"]).otherwise(joined).alias("leaf")
        )
    whole = F.when(F.col("position") == 0, F.col("leaf")).otherwise(F.raise_error(F.lit("a key has more leaves than the tree holds")))
    return nodes.select(*keys, whole.alias("tree_hash"))


def ledger_heads(blocks: DataFrame) -> DataFrame:
    """One anchor per target over the last hashes of its segments."""
    heads = blocks.groupBy("target_id", "segment").agg(F.max_by("block_hash", "block_index").alias("leaf"))
    leaves = heads.withColumnRenamed("segment", "position")
    return fold_tree(leaves, ["target_id"]).withColumnRenamed("tree_hash", "head_hash")


def ledger_head_report(events: DataFrame, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    return ledger_heads(ledger_build(events, segment_blocks))


def verify_blocks(blocks: DataFrame, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """Each block with ``cause``: NULL, BROKEN_LINK or TAMPERED_CONTENT.

    A block's link is broken if its previous hash or its index does not follow the block before it. The window is
    one segment of one target, so it never holds more than a segment; the first block of a later segment is joined
    to the last index of the segment before, so a missing segment or the missing end of one shows too.
    """
    order = Window.partitionBy("target_id", "segment").orderBy("block_index")
    expected = F.coalesce(F.lag("block_hash").over(order), segment_start(F.col("target_id"), F.col("segment")))
    ends = blocks.groupBy("target_id", (F.col("segment") + 1).alias("segment")).agg(F.max("block_index").alias("_end"))
    first = F.col("block_index") == F.min("block_index").over(Window.partitionBy("target_id", "segment"))
    before = F.when(F.col("segment") > 0, F.col("_end")).otherwise(0)
    follows = F.when(first, F.coalesce(before, F.lit(-1))).otherwise(F.lag("block_index").over(order)) + 1
    right_place = F.col("segment") == F.floor((F.col("block_index") - 1) / segment_blocks)
    blocks = blocks.join(ends, ["target_id", "segment"], "left")
    cause = case_when(
        [
            ((F.col("previous_hash") != expected) | (F.col("block_index") != follows) | ~right_place, "BROKEN_LINK"),
            (link(F.col("previous_hash"), _content()) != F.col("block_hash"), "TAMPERED_CONTENT"),
        ]
    )
    return blocks.withColumn("cause", cause).drop("_end")


def anchors(blocks: DataFrame) -> DataFrame:
    """What a target's owner keeps apart from the ledger: last index and head hash per target."""
    last = blocks.groupBy("target_id").agg(F.max("block_index").alias("last_index"))
    return last.join(ledger_heads(blocks), "target_id")


def ledger_verify(blocks: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Per target: blocks verified and the first bad block with its cause.

    ``kept`` are stored ``anchors``: a ledger that ends before the stored index misses blocks from there on
    (MISSING_BLOCKS), one that ends elsewhere or has another head is a HEAD_MISMATCH without a place. Without
    them blocks cut off at the end cannot be seen.
    """
    found = verify_blocks(blocks).groupBy("target_id").agg(
        F.count("*").alias("events_verified"),
        F.min_by("cause", F.when(F.col("cause").isNotNull(), F.col("block_index"))).alias("first_cause"),
        F.min(F.when(F.col("cause").isNotNull(), F.col("block_index"))).alias("first_bad_block"),
    )
    if kept is not None:
        now = anchors(blocks).select("target_id", F.col("last_index").alias("_last"), F.col("head_hash").alias("_head"))
        found = kept.join(found, "target_id", "full").join(now, "target_id", "left")
        last = F.coalesce("_last", F.lit(0))
        cut = F.col("first_cause").isNull() & (last < F.col("last_index"))
        other = F.col("first_cause").isNull() & ~F.coalesce((F.col("_head") == F.col("head_hash")) & (last == F.col("last_index")), F.lit(False))
        found = found.select(
            "target_id", F.coalesce("events_verified", F.lit(0).cast("long")).alias("events_verified"),
            F.when(cut, last + 1).otherwise(F.col("first_bad_block")).alias("first_bad_block"),
            F.when(cut, "MISSING_BLOCKS").when(other, "HEAD_MISMATCH").otherwise(F.col("first_cause")).alias("first_cause"),
        )
    return found.select("target_id", "events_verified", F.col("first_cause").isNull().alias("chain_valid"), "first_bad_block", "first_cause")


def tampered(blocks: DataFrame) -> DataFrame:
    """A copy with altered content, broken links and missing blocks, for exercising verification.

    Blocks vanish inside a chain, at its start, at its end, and as a whole.
    """
    e, target, index = F.col("event_id"), F.col("target_id"), F.col("block_index")
    gone = (e % 1201 == 0) | ((target % 53 == 5) & (index <= 2)) | ((target % 59 == 7) & (index > 4)) | (target % 211 == 11)
    return blocks.filter(~gone).withColumn(
        "event_type", F.when(e % 997 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type"))
    ).withColumn("previous_hash", F.when(e % 1499 == 0, ZERO_HASH).otherwise(F.col("previous_hash")))


def ledger_verify_tampered(events: DataFrame) -> DataFrame:
    # blocks feed the copy, the links and the anchors: built once, read from the shared folder
    blocks = checkpointed(ledger_build(events))
    return ledger_verify(tampered(blocks), anchors(blocks))


def latest_anchor(blocks: DataFrame) -> DataFrame:
    """Evidence hash of the last block of each target that carries one."""
    anchored = F.when(F.col("evidence_hash") != ZERO_HASH, F.col("block_index"))
    return blocks.groupBy("target_id").agg(F.max_by("evidence_hash", anchored).alias("anchored_evidence_hash"))


def integrity_report(blocks: DataFrame, current: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Chain state and whether the current evidence still has the anchored hash.

    ``current`` holds target_id and evidence_hash of the evidence as it is now, ``kept`` the stored ``anchors``.
    A target without an anchored hash has evidence_match NULL.
    """
    rows = ledger_verify(blocks, kept).join(latest_anchor(blocks), "target_id", "left").join(
        current.select("target_id", F.col("evidence_hash").alias("calculated_evidence_hash")), "target_id", "left"
    )
    differs = F.col("calculated_evidence_hash") != F.col("anchored_evidence_hash")
    broken = ~F.col("chain_valid") | F.coalesce(differs, F.lit(False))
    return rows.select(
        "target_id", "events_verified", "chain_valid", (~differs).alias("evidence_match"),
        F.when(broken, "INTEGRITY_FAILURE").otherwise("VALID").alias("integrity_status"),
    )


def integrity_of_events(events: DataFrame) -> DataFrame:
    """Report over a tampered copy, with the evidence of some targets changed after anchoring."""
    whole = checkpointed(ledger_build(events))
    blocks = tampered(whole)
    last = events.groupBy("target_id").agg(F.max_by("payload", "event_id").alias("payload"))
    changed = F.when(F.col("target_id") % 10 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    current = last.select("target_id", F.sha2(changed, 256).alias("evidence_hash"))
    return integrity_report(blocks, current, anchors(whole))


def evidence_package_hash(evidence: DataFrame) -> DataFrame:
    """Canonical hash of all evidence of a case, in order of emission; volatile columns stay out."""
    line = canonical(
        "item_seq", "case_id", "module", "signal", "category", "status", "severity", digits(F.col("confidence"), 4), "correlation_group"
    )
    rows = ordinal(evidence, ["case_id"], [F.asc("item_seq")], "_n")
    leaves = rows.select("case_id", (F.col("_n") - 1).alias("position"), line.alias("leaf"))
    return fold_tree(leaves, ["case_id"]).withColumnRenamed("tree_hash", "evidence_hash")


def risk_snapshot(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """Reproducibility hash of an assessment: result and evidence sorted by module and signal."""
    line = canonical("module", "signal", "status", "severity", digits(F.col("confidence"), 4))
    order = [F.asc("module"), F.asc("signal"), F.asc("item_seq")]
    rows = ordinal(evidence, ["case_id"], order, "_n")
    leaves = rows.select("case_id", (F.col("_n") - 1).alias("position"), line.alias("leaf"))
    hashes = fold_tree(leaves, ["case_id"])
    result = risk.risk_override(evidence, config).select("case_id", "risk_score", "risk_level")
    snapshot = F.sha2(canonical("case_id", F.lit(config.version), "risk_score", "risk_level", "tree_hash"), 256)
    return result.join(hashes, "case_id").select("case_id", "risk_score", "risk_level", snapshot.alias("snapshot_hash"))


def officer_decisions(events: DataFrame) -> DataFrame:
    """Latest decision per target with the number of decisions and the hash of that record."""
    record = F.sha2(canonical("target_id", "event_id", "decision", "recorded_at"), 256)
    rows = events.withColumn("decision_hash", record).groupBy("target_id")
    latest = F.max_by(F.struct("decision", "decision_hash", "event_id"), F.col("event_id"))
    return rows.agg(latest.alias("d"), F.count("*").alias("decisions")).select("target_id", "decisions", "d.*")
