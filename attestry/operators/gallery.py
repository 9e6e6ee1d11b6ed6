"""1:N gallery search: the nearest vectors of a stated query set, exact, over a partitioned index.

The index deals every gallery vector to the nearest of a bounded number of pivots. Cells lie together on shelves of bounded
size, a fuller cell on several of its own. A search first measures each query against the shelves of its nearest cells,
which gives a k-th similarity, and then against every further shelf with a cell that the triangle inequality of angles
cannot rule out at that similarity. So the result is exact, and what is skipped cannot matter.

A shelf meets a bounded part of its queries in one task. Products of matrices choose the few rows there that can be among
the k nearest, whatever the last bits of a product are; only these are measured as the 1:1 check does, and leave the task.

Defined results: vectors that are null, empty, zero or hold nulls have no similarity and are neither found nor
searched for; vectors of another length are compared with none. Similarity is the one of the 1:1 check (clipped to 0..1, four
decimals); ties rank by identifier. Repeated vectors are found one by one, a query never finds its own identifier.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators.faces import decide
from attestry.operators.ranking import top_rows
from attestry.operators.risk import rounded
from attestry.session import checkpointed

#: Pivots are at most this many, so the table of cells is bounded whatever the gallery holds.
MAX_CELLS = 1024
#: Cells that a query visits before any is ruled out.
PROBES = 8
#: Gallery rows of a shelf, and queries that one task compares with them at once.
BLOCK_ROWS, QUERY_ROWS = 20_000, 4_096
#: Similarities that a task holds at once.
AT_ONCE = 2_000_000
# similarities are rounded to four decimals, so a cell is ruled out only if it stays below by more than that
SLACK = 2e-4
# more than products of unit vectors differ by the order of their sums
NOISE = 1e-9

# executors get these functions themselves, so they need not have this package
register_pickle_by_value(sys.modules[__name__])


def dot(a: Column, b: Column) -> Column:
    """Inner product; NULL for vectors of different lengths."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, p: total + p)


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, unit): vectors scaled to length one; those without a direction are left out."""
    wide = F.col(vector).cast("array<double>")
    norm = F.sqrt(dot(F.col("_wide"), F.col("_wide")))
    rows = df.select(F.col(key), wide.alias("_wide")).withColumn("_norm", norm).filter("_norm > 0 AND _norm < double('Infinity')")
    return rows.select(key, F.transform("_wide", lambda x: x / F.col("_norm")).alias("unit"))


def by_length(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes, found = np.diff(ends), {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        found[size] = at, values[ends[at][:, None] + np.arange(size)]
    return found


def nearness(lists: pa.ListArray, pivots: dict[int, tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
    """Product of every vector with every pivot, NaN where the lengths differ."""
    near = np.full((len(lists), count), np.nan)
    for size, (at, vectors) in by_length(lists).items():
        if size in pivots:
            near[np.ix_(at, pivots[size][0])] = vectors @ pivots[size][1].T
    return near


def nearest_rows(similar: np.ndarray, own: list[int], k: int) -> np.ndarray:
    """Positions that can be among the ``k`` nearest by similarity of four decimals, then by position."""
    clipped = np.clip(similar, 0.0, 1.0)
    low, high = np.floor((clipped - NOISE) * 1e4 + 0.5), np.floor((clipped + NOISE) * 1e4 + 0.5)
    low[own] = high[own] = -2.0
    if len(low) - len(own) <= k:
        return np.flatnonzero(high > -2.0)
    kth = -np.partition(-low, k - 1)[k - 1]
    last = np.flatnonzero(low == kth)[k - 1 - int((low > kth).sum())]
    return np.flatnonzero((high > kth) | ((high == kth) & (np.arange(len(high)) <= last)))


class GalleryIndex:
    """``rows`` (key, shelf, unit), ``cells`` with size, radius and shelves in the shared folder, and the pivots."""

    def __init__(self, gallery: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, block_rows: int = BLOCK_ROWS):
        self.key = key
        units = unit_vectors(gallery, key, vector)
        wanted = cells or max(1, math.ceil(math.sqrt(units.count())))
        # a bounded top-k by hash: any vectors will do as pivots, the result does not depend on them
        chosen = units.orderBy(F.xxhash64(key), key).limit(min(wanted, MAX_CELLS)).select("unit").collect()
        self.count = count = len(chosen)
        self.pivots = pivots = by_length(pa.array([r.unit for r in chosen], pa.list_(pa.float64())))

        def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.nan_to_num(nearness(batch.column(1), pivots, count), nan=-1.0)
                cell = near.argmax(axis=1) if len(near) else np.zeros(0, dtype=np.int64)
                added = [pa.array(near[np.arange(len(near)), cell]), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[key, "unit", "near", "cell"])

        shape = T.StructType([*units.schema.fields, T.StructField("near", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        placed = checkpointed(units.mapInArrow(place, shape))
        blocks = F.ceil(F.count("*") / F.lit(block_rows)).cast("int")
        sized = placed.groupBy("cell").agg(F.count("*").alias("size"), F.min("near").alias("least"), blocks.alias("blocks"))
        # at most MAX_CELLS rows: they are numbered in one task and broadcast within that bound
        order = Window.orderBy("cell")
        shelf = F.when(F.col("blocks") > 1, F.lit(0)).otherwise(F.floor(F.sum(F.when(F.col("blocks") == 1, F.col("size"))).over(order) / block_rows))
        spread = F.sum(F.when(F.col("blocks") > 1, F.col("blocks")).otherwise(0)).over(order) - F.col("blocks")
        # usual cells share the even shelves, each part of a fuller cell has an odd one
        first = F.when(F.col("blocks") > 1, spread * 2 + 1).otherwise(shelf * 2).cast("int")
        self.cells = checkpointed(sized.withColumn("shelf", first))
        parts = F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
        self.rows = placed.join(F.broadcast(self.cells.select("cell", "blocks", "shelf")), "cell").select(key, (F.col("shelf") + parts * 2).alias("shelf"), "unit")

    def _visits(self, queries: DataFrame) -> DataFrame:
        """(query_id, near, cell, size, least, blocks, shelf, bound): every query with every cell, and what the cell can reach."""
        pivots, count = self.pivots, self.count

        def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = nearness(batch.column(1), pivots, count)
                ends = pa.array((np.arange(len(near) + 1) * count).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(near.reshape(-1), mask=np.isnan(near.reshape(-1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["query_id", "near"])

        shape = T.StructType([queries.schema["query_id"], T.StructField("near", T.ArrayType(T.DoubleType()))])
        pairs = queries.select("query_id", "unit").mapInArrow(measure, shape).select("query_id", F.posexplode("near").alias("cell", "near"))
        pairs = pairs.join(F.broadcast(self.cells), "cell")

        def angle(cosine: Column) -> Column:
            return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))

        bound = F.cos(F.greatest(F.lit(0.0), angle(F.col("near")) - angle(F.col("least"))))
        return pairs.withColumn("bound", F.greatest(F.lit(0.0), F.coalesce(F.when(F.col("near").isNotNull(), bound), F.lit(1.0))))

    def _measure(self, visits: DataFrame, asked: DataFrame, parts: int, k: int) -> DataFrame:
        """The best ``k`` of the visited shelves per query; a task meets a part of the queries with one shelf."""
        key = self.key

        def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.filter(rows.column(key).is_valid()).sort_by(key)
            keys, ids = rows.column(key).combine_chunks(), queries.column("query_id").combine_chunks()
            left, right = (by_length(t.column("unit").combine_chunks()) for t in (queries, rows))
            found = [], [], []
            for size in left.keys() & right.keys():
                (asked_at, wanted), (row_at, vectors) = left[size], right[size]
                places = defaultdict(list)
                for i, value in enumerate(keys.take(pa.array(row_at)).to_pylist()):
                    places[value].append(i)
                names, step = ids.take(pa.array(asked_at)).to_pylist(), max(1, AT_ONCE // len(vectors))
                for at in range(0, len(wanted), step):
                    for i, similar in enumerate(wanted[at : at + step] @ vectors.T, at):
                        if names[i] is None:
                            continue
                        near = nearest_rows(similar, places.get(names[i], []), k)
                        found[0].append(np.full(len(near), asked_at[i]))
                        found[1].append(row_at[near])
                        # summed from the first to the last, as the 1:1 check does
                        found[2].append(np.cumsum(wanted[i] * vectors[near], axis=1)[:, -1])
            of, to, dots = (np.concatenate([np.zeros(0, kind), *f]) for f, kind in zip(found, (np.int64, np.int64, np.float64), strict=True))
            return pa.table([ids.take(pa.array(of)), keys.take(pa.array(to)), pa.array(dots)], names=["query_id", key, "_dot"])

        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
        queries = visits.select("query_id", "shelf").join(asked, "query_id").select("shelf", part, "query_id", "unit")
        rows = self.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        shape = T.StructType([asked.schema["query_id"], self.rows.schema[key], T.StructField("_dot", T.DoubleType())])
        found = queries.groupBy("shelf", "part").cogroup(rows.groupBy("shelf", "part")).applyInArrow(meet, shape)
        similarity = rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_dot"))), 4)
        found = found.select("query_id", key, similarity.alias("similarity"))
        return top_rows(found, ["query_id"], [F.desc("similarity"), F.col(key)], k)

    def search(self, queries: DataFrame, k: int, vector: str = "embedding", probes: int = PROBES, exact: bool = True) -> DataFrame:
        """(query_id, key, similarity, rank) of the ``k`` nearest; ``exact=False`` stops after the shelves of the nearest ``probes`` cells."""
        asked = checkpointed(unit_vectors(queries.withColumnRenamed(self.key, "query_id"), "query_id", vector))
        parts = max(1, math.ceil(asked.count() / QUERY_ROWS))
        # each query's cells in order of their pivots, then the shelves they lie on; both passes read the same stored order
        order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("near", F.lit(-1.0))), F.col("cell"))
        turns = self._visits(asked).withColumn("turn", F.row_number().over(order))
        shelves = turns.withColumn("shelf", F.explode(F.sequence(F.col("shelf"), F.col("shelf") + (F.col("blocks") - 1) * 2, F.lit(2))))
        ordered = checkpointed(shelves.groupBy("query_id", "shelf").agg(F.min("turn").alias("turn"), F.max("bound").alias("bound")))
        first = self._measure(ordered.filter(F.col("turn") <= probes), asked, parts, k)
        if not exact:
            return first
        first = checkpointed(first)
        reached = first.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("kth"))
        left = ordered.filter(F.col("turn") > probes).join(reached, "query_id", "left")
        rest = self._measure(left.filter(F.col("bound") >= F.coalesce("kth", F.lit(-1.0)) - SLACK), asked, parts, k)
        both = first.drop("rank").unionByName(rest.drop("rank"))
        return top_rows(both, ["query_id"], [F.desc("similarity"), F.col(self.key)], k)


def gallery_topk(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest of all vectors for every vector whose identifier 100 divides, with the 1:1 decision."""
    queries = embeddings.filter("vec_id % 100 = 0")
    found = GalleryIndex(embeddings).search(queries, k)
    return decide(found.withColumn("elevated", F.lit(False))).select("query_id", "rank", "vec_id", "similarity", "status")
