"""Reuse of registry answers: an answer serves its own lookup and all that follow within its freshness.

The next lookup after that asks again. Which lookups ask thus follows from the first one by a chain, and a key may hold
a third of all rows, so no key is walked row by row. Time is cut into cells as long as the freshness: a cell
holds one answer at most, cells without any row within reach start a new chain, and inside a chain every instant
points to the first instant it does not serve. Jumping along doubled pointers marks the answers; the number of rounds
grows with the logarithm of the cells in a chain. Chains that meet go on as one, so few instants lie behind long jumps,
and each round keeps the pointers of those only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.dims import TRANSIENT_OUTCOMES
from attestry.session import checkpointed

FRESH_MICROS = 300 * 1_000_000
KEYS = ["document_type", "query_hash", "provider"]


def as_answers(lookups: DataFrame) -> DataFrame:
    """Lookups as rows (key, ts, event_id, outcome, served = 1); outages are never reused, nor lookups without a hash."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return lookups.filter(~F.coalesce("outcome", F.lit("")).isin(*TRANSIENT_OUTCOMES)).select(
        clean("document_type").alias("document_type"), F.trim(F.coalesce("query_hash", F.lit(""))).alias("query_hash"), clean("provider").alias("provider"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id", "outcome", F.lit(1).cast("long").alias("served"),
    ).filter("query_hash <> '' AND ts IS NOT NULL")


def _cells(nodes: DataFrame) -> DataFrame:
    """Per key and cell: first and last instant, chain, and the first instant behind the next cell."""
    cells = nodes.groupBy(*KEYS, "cell").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy(*KEYS).orderBy("cell")
    # nothing before reaches the first instant of such a cell
    head = F.coalesce(F.col("first") > F.lag("last").over(order) + FRESH_MICROS, F.lit(True))
    behind = F.when(F.lead("cell").over(order) == F.col("cell") + 1, F.lead("first", 2).over(order)).otherwise(F.lead("first").over(order))
    cells = cells.withColumn("head", head).withColumn("behind", behind)
    cells = cells.withColumn("chain", F.sum(F.col("head").cast("long")).over(order))
    return cells.withColumn("size", F.count("*").over(Window.partitionBy(*KEYS, "chain")))


def _first_after(nodes: DataFrame) -> Column:
    """The first instant of the next cell that an instant does not serve, by a sort per cell."""
    order = Window.partitionBy(*KEYS, "cell").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    return F.min(F.when(F.col("is_target"), F.col("at"))).over(order)


def _openers(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(key, at) of the instants that ask: chain heads and what follows from them by pointers."""
    heads = cells.filter("head").select(*KEYS, F.col("first").alias("at"))
    long_chains = cells.filter("size > 1")
    most = long_chains.agg(F.max("size")).first()[0]
    if most is None:
        return heads
    inside = nodes.join(long_chains.select(*KEYS, "cell", "behind"), [*KEYS, "cell"])
    sources = inside.select(*KEYS, (F.col("cell") + 1).alias("cell"), (F.col("at") + FRESH_MICROS).alias("at"), "behind", F.lit(False).alias("is_target"))
    targets = inside.select(*KEYS, "cell", "at", F.lit(None).cast("long").alias("behind"), F.lit(True).alias("is_target"))
    both = sources.unionByName(targets)
    jumps = both.withColumn("next", F.coalesce(_first_after(both), "behind")).filter("NOT is_target AND next IS NOT NULL")
    jumps = checkpointed(jumps.select(*KEYS, (F.col("at") - FRESH_MICROS).alias("at"), "next"))
    reached = heads
    for _ in range(int(most).bit_length()):  # a chain has one answer a cell at most
        # an instant is reached already, or lies behind a jump as long as the present ones: no other needs a pointer
        needed = reached.select(*KEYS, "at").unionByName(jumps.select(*KEYS, F.col("next").alias("at"))).distinct()
        jumps = checkpointed(jumps.join(needed, [*KEYS, "at"], "left_semi"))
        ahead = reached.join(jumps, [*KEYS, "at"]).select(*KEYS, F.col("next").alias("at"))
        reached = checkpointed(reached.unionByName(ahead).distinct())
        onward = jumps.select(*KEYS, F.col("at").alias("next"), F.col("next").alias("further"))
        jumps = checkpointed(jumps.join(onward, [*KEYS, "next"]).select(*KEYS, "at", F.col("further").alias("next")))
    return reached


def fresh_answers(answers: DataFrame) -> DataFrame:
    """Answers that were asked for, with the number of lookups each served (rows of ``as_answers``, or such results).

    At one instant the smallest event identifier answers. A lookup exactly 300 seconds after the answer is served.
    """
    nodes = answers.groupBy(*KEYS, F.unix_micros("ts").alias("at")).agg(
        F.min(F.struct("event_id", "outcome")).alias("answer"), F.sum("served").alias("served")
    )
    nodes = checkpointed(nodes.withColumn("cell", F.floor(F.col("at") / F.lit(FRESH_MICROS)).cast("long")))
    cells = checkpointed(_cells(nodes))
    openers = _openers(nodes, cells).withColumn("cell", F.floor(F.col("at") / F.lit(FRESH_MICROS)).cast("long"))
    placed = cells.select(*KEYS, "cell").join(openers.withColumnRenamed("at", "own"), [*KEYS, "cell"], "left")
    order = Window.partitionBy(*KEYS).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("earlier", F.last("own", ignorenulls=True).over(order))
    served_by = F.when(F.col("own") <= F.col("at"), F.col("own")).otherwise(F.col("earlier"))
    grouped = nodes.join(placed, [*KEYS, "cell"]).groupBy(*KEYS, served_by.alias("opened")).agg(
        F.min_by("answer", "at").alias("answer"), F.sum("served").alias("served")
    )
    return grouped.select(*KEYS, F.timestamp_micros("opened").alias("ts"), "answer.event_id", "answer.outcome", "served")


def reported(served: DataFrame, *more: str) -> DataFrame:
    return served.select(*KEYS, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("answered_at"), "event_id", "outcome", "served", *more)


def fresh_lookups(lookups: DataFrame) -> DataFrame:
    """Every answer that lookups had to ask for, and how many lookups it served within 300 seconds."""
    return reported(fresh_answers(as_answers(lookups)))
