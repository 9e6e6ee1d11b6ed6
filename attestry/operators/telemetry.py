"""Stage latency statistics and stage progression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.text import case_when
from attestry.operators.ranking import ordinal

# Stages of one verification in order.
STAGES = (
    "STANDBY DOCUMENT_SELECTED UPLOADING OCR_PROCESSING VALIDATING FORENSICS BIOMETRIC_PENDING BIOMETRIC_PROCESSING "
    "REGISTRY_VERIFICATION RISK_ASSESSMENT OFFICER_REVIEW COMPLETED"
).split()


def stage_latency(events: DataFrame) -> DataFrame:
    """Count, mean and the exact order statistics p50 = s[n/2], p95 = s[0.95 n] per stage.

    There are few stages and any may hold a large share of all events, so no stage is sorted
    in one task: counts per millisecond locate the cell of each quantile, then only the
    values of that cell are counted. Every step aggregates before its shuffle.
    """
    rows = events.select("stage", F.col("duration_ms").alias("value"), F.floor("duration_ms").alias("cell"))
    cells = rows.groupBy("stage", "cell").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    order = Window.partitionBy("stage").orderBy("cell")
    running = cells.withColumn("upto", F.sum("n").over(order))
    sizes = running.groupBy("stage").agg(F.sum("n").alias("count"), F.sum("total").alias("total"))
    # zero-based ranks wanted per stage, as in s[int(0.5 n)] and s[min(int(0.95 n), n - 1)]
    ranks = F.array(
        F.struct(F.lit("p50").alias("q"), F.floor(F.col("count") * 0.50).alias("rank")),
        F.struct(F.lit("p95").alias("q"), F.least(F.floor(F.col("count") * 0.95), F.col("count") - 1).alias("rank")),
    )
    wanted = sizes.select("stage", F.explode(ranks).alias("w")).select("stage", "w.q", "w.rank")
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    targets = running.join(wanted, "stage").filter(hit).select(
        "stage", "q", "cell", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("offset")
    )
    inside = rows.join(F.broadcast(targets.select("stage", "cell").distinct()), ["stage", "cell"], "left_semi")
    values = inside.groupBy("stage", "cell", "value").count()
    within = Window.partitionBy("stage", "cell").orderBy("value")
    values = values.withColumn("upto", F.sum("count").over(within))
    found = (
        targets.join(values, ["stage", "cell"])
        .filter((F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("count")))
        .groupBy("stage")
        .agg(
            F.max(F.when(F.col("q") == "p50", F.col("value"))).alias("p50"),
            F.max(F.when(F.col("q") == "p95", F.col("value"))).alias("p95"),
        )
    )
    return sizes.join(found, "stage").select(
        "stage", F.col("count").alias("runs"), F.round(F.col("total") / F.col("count"), 2).alias("avg_ms"),
        F.round("p50", 2).alias("p50_ms"), F.round("p95", 2).alias("p95_ms"),
    )


def stage_order(events: DataFrame, after: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Each step of a verification against the step before it.

    The previous step is found by an equi-join on consecutive step numbers, which spreads a
    verification with very many steps over all tasks. ``after`` (verification_id, step, stage) holds the last steps
    decided earlier, on which the steps of ``events`` follow; ``keep`` names further columns of the events.
    """
    position = case_when([(F.col("stage") == s, i) for i, s in enumerate(STAGES)])
    steps = ordinal(
        events.withColumn("position", position), ["verification_id"], [F.asc("started_at"), F.asc("event_id")], "step"
    ).select("verification_id", "step", "event_id", "stage", "status", "position", *keep)
    if after is not None:
        ahead = after.select("verification_id", F.col("step").alias("ahead"))
        steps = steps.join(ahead, "verification_id", "left").withColumn("step", F.col("step") + F.coalesce("ahead", F.lit(0))).drop("ahead")
    before = steps.select("verification_id", (F.col("step") + 1).alias("step"), F.col("position").alias("previous"))
    if after is not None:
        before = before.unionByName(after.select("verification_id", (F.col("step") + 1).alias("step"), position.alias("previous")))
    rows = steps.join(before, ["verification_id", "step"], "left")
    verdict = case_when(
        [
            (F.col("status") == "failed", "STAGE_FAILED"),
            (F.col("previous").isNull(), "START"),
            (F.col("position") <= F.col("previous"), "RESTARTED"),
            (F.col("position") > F.col("previous") + 1, "GAP"),
        ],
        "ADVANCED",
    )
    return rows.select("verification_id", "step", "event_id", "stage", "status", verdict.alias("progress"), *keep)


# ---------------------------------------------------------------------------------------
# Mergeable latency statistics

# items a sketch keeps: its quantiles are exact for up to so many rows, beyond that within 0.1 % of the rank
SKETCH_ITEMS = 4096


def latency_panes(events: DataFrame, width: str = "1 minute") -> DataFrame:
    """Count, total and quantile sketch per stage and pane of time: partials that merge into any longer span."""
    pane = F.window(F.col("started_at").cast("timestamp"), width)
    return events.groupBy(pane.alias("w"), "stage").agg(
        F.count("duration_ms").alias("runs"), F.sum("duration_ms").alias("total"), F.kll_sketch_agg_double("duration_ms", SKETCH_ITEMS).alias("sketch")
    ).select(F.col("w.start").alias("pane"), "stage", "runs", "total", "sketch")


def merge_panes(panes: DataFrame, *more: Column) -> DataFrame:
    """Panes of equal time and stage put together; also rolls panes up once their ``pane`` is cut to a longer span."""
    return panes.groupBy("pane", "stage").agg(
        F.sum("runs").alias("runs"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", SKETCH_ITEMS).alias("sketch"), *more
    )


def latency_windows(panes: DataFrame, length: str = "1 hour", slide: str | None = None, states: bool = False) -> DataFrame:
    """Windows of ``length`` every ``slide`` from panes as wide as the slide: sketches merge, no row is read again.

    With ``states`` a window is open if one of its panes is, else amended if one of its panes is, else closed.
    """
    window = F.window("pane", length, slide or length)
    state = F.when(F.bool_or(F.col("state") == "open"), "open").when(F.bool_or(F.col("state") == "amended"), "amended").otherwise("closed")
    rows = panes.groupBy(window.alias("w"), "stage").agg(
        F.sum("runs").alias("runs"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", SKETCH_ITEMS).alias("sketch"),
        *([state.alias("state")] if states else []),
    )
    quantile = lambda q: F.round(F.kll_sketch_get_quantile_double("sketch", F.lit(q)), 2)
    return rows.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "stage", "runs", F.round(F.col("total") / F.col("runs"), 2).alias("avg_ms"),
        quantile(0.5).alias("p50_ms"), quantile(0.95).alias("p95_ms"), *(["state"] if states else []),
    )


def sliding_latency(events: DataFrame, length: str = "1 day", slide: str = "1 hour") -> DataFrame:
    """Latency per stage in sliding windows: mean of the exact total and the first values that 50 and 95 % of the rows reach.

    A row enters one pane, in a cell of values within 1.6 % of each other. Windows add up the panes' cells, so what they read is
    bounded by time and cells; the values of a window's two cells in question alone are then counted. Rows without duration do not count.
    """
    value = F.col("duration_ms").cast("double")
    # monotone in the value, some seven hundred cells from a millisecond to a day
    cell = F.floor(F.signum("value") * F.log1p(F.abs("value")) * 64)
    pane = F.window(F.col("started_at").cast("timestamp"), slide)["start"]
    rows = events.select(pane.alias("pane"), "stage", value.alias("value")).filter("value IS NOT NULL")
    values = rows.groupBy("pane", "stage", "value").agg(F.count("*").alias("n")).withColumn("cell", cell)
    cells = values.groupBy("pane", "stage", "cell").agg(
        F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(20,6)") * F.col("n")).alias("total")
    )
    start = F.window("pane", length, slide)["start"].alias("w")
    merged = cells.select(start, "stage", "cell", "n", "total").groupBy("w", "stage", "cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    whole, below = Window.partitionBy("w", "stage"), Window.partitionBy("w", "stage").orderBy("cell")
    running = merged.select(
        "w", "stage", "cell", "n", F.sum("n").over(below).alias("upto"), F.sum("n").over(whole).alias("runs"), F.sum("total").over(whole).alias("total")
    )
    # whole numbers: a share of the rows as a fraction may lie beside the rank
    ranks = [F.struct(F.lit(q).alias("q"), F.ceil(F.col("runs") * F.lit(share).cast("decimal(3,2)")).cast("long").alias("rank")) for q, share in (("p50", "0.50"), ("p95", "0.95"))]
    wanted = running.select("*", F.explode(F.array(*ranks)).alias("r")).filter((F.col("r.rank") <= F.col("upto")) & (F.col("r.rank") > F.col("upto") - F.col("n")))
    wanted = wanted.select("w", F.col("stage").alias("of"), F.col("cell").alias("at"), "runs", "total", "r.q", (F.col("r.rank") - F.col("upto") + F.col("n")).alias("rank"))
    covered = rows.select("pane").distinct().select("pane", start)
    near = wanted.join(covered, "w").withColumnRenamed("pane", "in")
    met = values.join(near, (F.col("pane") == F.col("in")) & F.col("stage").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at")))
    met = met.groupBy("w", "stage", "runs", "total", "q", "rank", "value").agg(F.sum("n").alias("n"))
    reached = F.sum("n").over(Window.partitionBy("w", "stage", "q").orderBy("value"))
    met = met.withColumn("upto", reached).filter("upto >= rank")
    first = lambda q: F.round(F.min(F.when(F.col("q") == q, F.col("value"))), 2).alias(f"{q}_ms")
    found = met.groupBy("w", "stage", "runs", "total").agg(first("p50"), first("p95"))
    mean = (F.col("total").cast("double") / F.col("runs")).cast("decimal(20,8)")
    return found.select(
        F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "stage", "runs", F.round(mean, 2).cast("double").alias("avg_ms"), "p50_ms", "p95_ms"
    )
