"""Ranking that stays distributed when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import checkpointed

# rows of one key that a task may sort; more are spread over tasks
HOT_ROWS = 1_000_000


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank.

    The constant bound on row_number lets Spark cut each map task to ``k`` rows per key
    before the shuffle, so a hot key sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1, "_first").drop("_first")


def distinct_in_order(df: DataFrame, keys: Sequence[str], value: Column, position: Column, name: str = "values") -> DataFrame:
    """Per key the distinct values in order of their first position, as an array ``name``; null values are none.

    The first position of each value combines before the shuffle, so a key's array holds its distinct values only,
    however often a value stands in a hot key.
    """
    first = df.select(*keys, value.alias("_value"), position.alias("_at")).filter("_value IS NOT NULL").groupBy(*keys, "_value").agg(F.min("_at").alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_value")))
    return first.groupBy(*keys).agg(ordered.alias("_all")).select(*keys, F.col("_all._value").alias(name))


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int, sizes: DataFrame | None = None) -> tuple[bool, DataFrame, DataFrame | None]:
    """Whether keys of more than ``hot_rows`` rows exist, the rows of all other keys, and those of such keys if there are any.

    ``sizes`` may name a frame that is cheaper to count than ``df`` and holds no fewer rows of any key.
    """
    counted = (df if sizes is None else sizes).groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = checkpointed(counted.filter(F.col("_rows") > hot_rows).select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    if hot.isEmpty():
        return False, df, None
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(hot[f"_hot_{k}"])
    return True, df.join(F.broadcast(hot), same, "left_anti"), df.join(F.broadcast(hot), same, "left_semi")


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, sizes: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``row_number()`` over every row of every key, for keys of any size.

    ``order`` must be unique within a key. Keys of up to ``hot_rows`` rows are numbered by a window, which takes one
    shuffle and leaves the rows dealt by key; what a task then sorts of one key is bounded. Larger keys, of which there
    are few, are spread. ``sizes`` may name a frame that is cheaper to count than ``df`` and holds no fewer rows of any key.
    """
    keys = list(keys)
    numbered = lambda rows: rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    hot, usual, large = split_hot(df, keys, hot_rows, sizes)
    return numbered(usual).unionByName(spread_ordinal(large, keys, order, name)) if hot else numbered(usual)


def spread_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """The numbers of ``ordinal`` with every key spread over as many tasks as it needs.

    The rows are range-sorted on key and order; the position in the sorted data minus the key's start in that part, plus the key's rows in
    earlier parts, is the row number. The sorted rows are checkpointed so that a lost executor cannot change
    positions between the two uses.
    """
    keys = list(keys)
    placed = checkpointed(
        df.orderBy(*keys, *order).withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", 33))
    spans = placed.groupBy(*keys, "_part").agg(F.min("_pos").alias("_start"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    # rows without a key are numbered like those of any key
    spans = spans.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_in"), "_start", "_before")
    same = F.col("_part") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return (
        placed.join(spans, same)
        .withColumn(name, F.col("_before") + F.col("_pos") - F.col("_start") + 1)
        .select(*df.columns, name)
    )
