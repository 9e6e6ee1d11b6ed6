"""Merkle manifest of a table: a hash tree per group of rows, one tree over the groups, and a proof per row.

A row's leaf hashes its fields. Trees have three children a node. Ranks give every leaf its place; the base-three
digits of the rank are grouped away one after the other, the lowest first, so a grouping nests the structs of up to
three children in their parent's row. Six digits make a block of at most 729 leaves, which bounds a row, and the roots of
the blocks are the leaves of the next pass, so a group of any size needs a few passes. On the way down a block's path to
the root meets its nested struct in one grouping, and transform and explode turn both into a proof per child.
No join is made of leaves and paths.

Defined results: nulls are hashed as ``-`` and differ from empty strings; the null group is the first. Rows with
equal identifier are ordered by leaf, and repeated rows each have a place and a proof; null identifiers come
first in their group. Empty tables give empty results. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import checkpointed

FANOUT, DIGITS = 3, 6
BLOCK = FANOUT**DIGITS
STEPS = "array<struct<before:string,after:string>>"


def joined_hash(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings put together."""
    return F.sha2(F.concat(*parts), 256)


def row_hash(fields: Sequence[Column]) -> Column:
    """Hash of a row: ``-`` for null, else the number of UTF-8 bytes, a colon and the value, field by field."""
    texts = [f.cast("string") for f in fields]
    return joined_hash(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, steps: Column) -> Column:
    """Root that follows from a leaf and its proof."""
    return F.aggregate(steps, leaf, lambda low, s: joined_hash(s["before"], low, s["after"]))


def siblings(steps: Column) -> Column:
    """The hashes of a proof put together, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(steps, lambda s: F.array(s["before"], s["after"]))), "")


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rank`` from 0 and size ``n`` of every row in its ``tree``, for trees of any size.

    Range-sorted, so a tree spans as many tasks as it needs; checkpointed, so positions stay when executors are lost.
    """
    placed = checkpointed(rows.orderBy("tree", *order).withColumn("pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("pos", 33))
    spans = placed.groupBy("tree", "part").agg(F.min("pos").alias("start"), F.count("*").alias("rows"))
    parts = Window.partitionBy("tree")
    before = F.sum("rows").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    spans = spans.select("tree", "part", (before - F.col("start")).alias("shift"), F.sum("rows").over(parts).alias("n"))
    return placed.join(spans, ["tree", "part"]).withColumn("rank", F.col("pos") + F.col("shift")).drop("pos", "part", "shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, n, block, hash, kids) of nodes (tree, n, rank, hash, item); one row nests at most 729 nodes.

    A tree of ``n`` nodes ends at its root: levels above it hand the root through.
    """
    digits = [f"d{i}" for i in range(DIGITS)]
    at = lambda i: F.expr(f"CAST(rank DIV {FANOUT**i} % {FANOUT} AS INT)")
    rows = nodes.select(
        "tree", "n", F.expr(f"rank DIV {BLOCK}").alias("block"), *[at(i).alias(d) for i, d in enumerate(digits)], "hash", F.col("item").alias("kids")
    ).repartition("tree", "block")  # all the groupings below keep this dealing: one shuffle
    for i, digit in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(digit, "hash", "kids")))
        rows = rows.groupBy("tree", "n", "block", *digits[i + 1 :]).agg(kids.alias("kids"))
        hashes = F.col("kids.hash")
        parent = F.when(F.col("n") > FANOUT**i, F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0])
        rows = rows.withColumn("hash", parent)
    return rows


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored blocks of every pass, and (tree, hash, height) of the trees' roots; a pass divides nodes by 729."""
    passes, roots = [], None
    while True:
        level = checkpointed(_blocks(nodes))
        ended = level.filter(F.col("n") <= BLOCK).select("tree", "hash", F.lit(len(passes)).alias("height"))
        roots = ended if roots is None else roots.unionByName(ended)
        passes.append(level)
        above = level.filter(F.col("n") > BLOCK)
        if above.isEmpty():
            return passes, roots
        nodes = above.select("tree", F.expr(f"(n + {BLOCK - 1}) DIV {BLOCK}").alias("n"), F.col("block").alias("rank"), "hash", F.struct("block").alias("item"))


def _children(kids: Column, n: Column, level: int, above: Column) -> Column:
    """(item, hash, steps) of all nodes nested in ``kids``: the steps from each up to the block's root, then ``above``."""

    def hashes(low, size):
        return F.array_join(F.transform(F.slice(kids, low, size), lambda k: k["hash"]), "")

    def child(kid, i):
        step = F.struct(hashes(F.lit(1), i).alias("before"), hashes(i + 2, F.lit(FANOUT)).alias("after"))
        steps = F.concat(F.when(n > FANOUT**level, F.array(step)).otherwise(F.array().cast(STEPS)), above)
        if level == 0:
            return F.struct(kid["kids"].alias("item"), kid["hash"].alias("hash"), steps.alias("steps"))
        return _children(kid["kids"], n, level - 1, steps)

    below = F.transform(kids, child)
    return below if level == 0 else F.flatten(below)


def _descend(passes: list[DataFrame], paths: DataFrame) -> DataFrame:
    """(carried, item, hash, steps) of the lowest nodes; ``paths`` (tree, height, steps, carried) lead to the trees' roots."""
    found = None
    for height in reversed(range(len(passes))):
        here = paths.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("block"), "steps", "carried")
        if found is not None:
            here = here.unionByName(found.select("tree", F.col("node.item.block").alias("block"), F.col("node.steps").alias("steps"), "carried"))
        both = passes[height].drop("hash").unionByName(here, allowMissingColumns=True)
        # one block and one path a key
        met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "steps", "carried")])
        children = _children(F.col("kids"), F.col("n"), DIGITS - 1, F.col("steps"))
        found = met.select("tree", "carried", F.explode(children).alias("node"))
    return found.select("carried", "node.*")


def manifest(rows: DataFrame, order: str, leaf: str = "leaf", group: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Per row: ``order``, ``leaf``, the columns ``keep``, ``subroot``, ``root`` and ``proof`` (steps from leaf to root).

    ``rows`` hold one leaf each; ``group`` names the column whose values have a tree of their own. The proof's steps
    are what stands before and after a node in its run.
    """
    item = F.struct(*[F.col(f"`{c}`") for c in (order, leaf, *keep)])
    # orders as the groups do, null first, and is never null itself
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = checkpointed(rows.select(tree.alias("tree"), F.col(f"`{leaf}`").alias("hash"), item.alias("item")))
    ranked = _ranked(leaves, [f"item.`{order}`", "hash"])
    passes, roots = _climb(ranked)
    groups = roots.select(F.lit("").alias("tree"), "hash", F.struct(F.col("tree").alias("of"), "height").alias("item"))
    top_passes, top = _climb(_ranked(groups, ["item.of"]))
    start = top.select("tree", "height", F.array().cast(STEPS).alias("steps"), F.struct(F.col("hash").alias("root")).alias("carried"))
    group_paths = _descend(top_passes, start).select(
        F.col("item.of").alias("tree"), "item.height", "steps", F.struct(F.col("hash").alias("subroot"), "carried.root").alias("carried")
    )
    return _descend(passes, group_paths).select("item.*", "carried.*", F.col("steps").alias("proof"))
