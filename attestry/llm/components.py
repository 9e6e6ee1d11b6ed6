"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import checkpointed, join_on_hot_key

# links that a task handles at least, where that leaves every core a task
TASK_ROWS = 20_000


def _in_few(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` in no more tasks than ``total`` links need: every task of a round leaves files for each shuffle and checkpoint."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS)))


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge table; equal before and after a round that changes nothing."""
    # the hash sum wraps around in 128 bits at most; decimals keep it exact
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _to_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Links (u, v), with v linked to the ``m`` of u instead; ``least`` is (u, m, n), n the links u has."""
    joined = join_on_hot_key(links, least, "u", "n", total)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _star(links: DataFrame, total: int) -> DataFrame:
    """Links every neighbour v of u, and u itself, to the least of them. ``links`` are (u, v)."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    own = least.select("u", F.col("m").alias("v"))
    return _to_least(links, least, total).unionByName(own).filter("u <> v")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node it reaches. Nodes are longs.

    Large-star links each node's larger neighbours to its least neighbour, small-star the smaller ones; the
    rounds needed grow with the logarithm of the longest path. The minimum is combined before the shuffle
    and hubs, at most ``HOT_SHARE`` nodes, are broadcast with their minimum to join it back, so a node with
    very many links is no hot task. Each round is checkpointed in the shared folder, so lineage stays short and survives lost executors.
    A round has as many tasks as its links need, however many partitions shuffles have, so that few links leave few files.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpointed(now)
    before = None
    while (state := _fingerprint(now)) != before:
        before = state
        now = _in_few(now, state[0])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: only neighbours above u move, so u keeps its place below them
        above = F.count_if(F.expr("v > u")).alias("n")
        least = both.groupBy("u").agg(F.min("v").alias("m"), above).select("u", F.least("u", "m").alias("m"), "n")
        large = _in_few(_to_least(both.filter("v > u"), least, state[0]), state[0]).distinct()
        large = checkpointed(_in_few(large, state[0]))
        # small-star: every link now points from the larger to the smaller node
        total = large.count()
        now = checkpointed(_in_few(_in_few(_star(large, total), total).distinct(), total))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
