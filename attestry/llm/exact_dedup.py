"""Exact deduplication against a history held in minimal perfect hash tables.

The distinct digests of the history are dealt to shards by their first bytes. Per shard a minimal perfect hash
places each digest in a slot of its own; the slot holds the full digest, the locator of the row that stays and
the group's size. Incoming digests, one per distinct text, are looked up in the shard; the digest in the slot is
compared byte by byte, so an unknown text that the hash sends to a taken slot is not a member. Members join the
group in the slot, nonmembers form groups of their own.

Defined results: null text counts as the empty text. The row with the largest identifier stays; null
identifiers are the smallest. Rows repeated with the same identifier count in the group's size and are all
flagged ``kept`` by ``groups_per_row``; ``unique_rows`` lets one of them stay. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import checkpointed, join_on_hot_key, keep_one_row, ship_package

DIGEST = 32
# distinct digests per shard; about 60 bytes each in a task
SHARD_KEYS = 20_000
MIN_SHARDS = 64


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """One 64-bit hash per digest (rows of four words) for a level of the perfect hash."""
    with np.errstate(over="ignore"):
        seed = np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        mixed = np.full(len(words), seed, dtype=np.uint64)
        for i in range(4):
            mixed = (mixed ^ words[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
    return mixed


class PerfectHash:
    """Distinct digests to 0..n-1 without gaps: one bit array per level, slots numbered by rank.

    A digest takes the first level where no other remaining digest meets it; those that meet go one level down.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], words
        while len(left):
            size = len(left) + len(left) // 2 + 1
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot per digest; -1 if no level takes it, and any slot for most digests that are not members."""
        found = np.full(len(words), -1, dtype=np.int64)
        open_rows, start = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_rows):
                break
            at = start + (_mix(words[open_rows], level) % np.uint64(size)).astype(np.int64)
            taken = self.bits[at]
            found[open_rows[taken]] = self.rank[at[taken]]
            open_rows = open_rows[~taken]
            start += size
        return found


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, DIGEST // 8)


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def group_digests(rows: DataFrame, id_column: str) -> DataFrame:
    """(digest, winner, size, repeats): combined per task, so a hot text sends one row per task."""
    return (
        rows.groupBy("digest", id_column)
        .agg(F.count("*").alias("n"))
        .groupBy("digest")
        .agg(
            F.max(id_column).alias("winner"),
            F.sum("n").alias("size"),
            F.max_by("n", F.struct(F.col(id_column).isNotNull(), F.col(id_column))).alias("repeats"),
        )
    )


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row per shard: level sizes and bits of the perfect hash, and the slots' contents in slot order."""
    winner = groups.schema["winner"].dataType
    schema = T.StructType.fromDDL("shard int, levels array<int>, bits binary, digests binary")
    schema = schema.add("winners", T.ArrayType(winner)).add("sizes", T.ArrayType(T.LongType()))
    schema = schema.add("repeats", T.ArrayType(T.LongType()))

    def build(table: pa.Table) -> pa.Table:
        digests = table.column("digest").to_pylist()
        hashed = PerfectHash.build(words := _words(digests))
        order = np.argsort(hashed.slots(words))
        put = table.take(pa.array(order))
        one = lambda name: pa.array([put.column(name).combine_chunks().to_pylist()], pa.list_(put.schema.field(name).type))
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
            "levels": pa.array([hashed.sizes], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(hashed.bits).tobytes()], pa.binary()),
            "digests": pa.array([b"".join(digests[i] for i in order)], pa.binary()),
            "winners": one("winner"), "sizes": one("size"), "repeats": one("repeats"),
        })

    return groups.withColumn("shard", _shard(F.col("digest"), shards)).groupBy("shard").applyInArrow(build, schema)


def merge_groups(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups of history and incoming rows together: (digest, winner, size, repeats, known).

    ``known`` tells groups whose text the history holds. Each shard is one bounded group of distinct digests.
    """
    schema = T.StructType([incoming.schema[c] for c in ("digest", "winner", "size", "repeats")])
    schema = schema.add("known", T.BooleanType())

    def better(a, b):  # (winner, repeats) of the larger identifier; equal identifiers add up
        if a[0] == b[0]:
            return a[0], a[1] + b[1]
        if a[0] is None or (b[0] is not None and b[0] > a[0]):
            return b
        return a

    def merge(new: pa.Table, old: pa.Table) -> pa.Table:
        digests, winners, sizes, repeats = [], [], [], []
        kind = new.schema.field("winner").type
        if old.num_rows:
            packed = old.column("digests")[0].as_py()
            digests = [packed[i : i + DIGEST] for i in range(0, len(packed), DIGEST)]
            winners, sizes, repeats = (old.column(c)[0].as_py() for c in ("winners", "sizes", "repeats"))
            levels = old.column("levels")[0].as_py()
            bits = np.unpackbits(np.frombuffer(old.column("bits")[0].as_py(), np.uint8), count=sum(levels))
            hashed = PerfectHash(levels, bits.astype(bool))
        known = [True] * len(digests)
        if new.num_rows:
            coming = new.column("digest").to_pylist()
            slots = hashed.slots(_words(coming)) if digests else np.full(len(coming), -1)
            rest = (new.column(c).to_pylist() for c in ("winner", "size", "repeats"))
            for slot, digest, winner, size, n in zip(slots, coming, *rest, strict=True):
                if slot >= 0 and digests[slot] == digest:
                    winners[slot], repeats[slot] = better((winners[slot], repeats[slot]), (winner, n))
                    sizes[slot] += size
                else:
                    digests.append(digest)
                    winners.append(winner)
                    sizes.append(size)
                    repeats.append(n)
                    known.append(False)
        return pa.table({
            "digest": pa.array(digests, pa.binary()), "winner": pa.array(winners, kind),
            "size": pa.array(sizes, pa.int64()), "repeats": pa.array(repeats, pa.int64()),
            "known": pa.array(known, pa.bool_()),
        })

    dealt = incoming.withColumn("shard", _shard(F.col("digest"), shards))
    return dealt.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(merge, schema)


def dedup_groups(rows: DataFrame, is_history: Column, id_column: str) -> tuple[DataFrame, int]:
    """Groups over all ``rows`` (with a ``digest``): history rows build the index, the others are looked up."""
    ship_package(rows.sparkSession)
    sides = rows.withColumn("__old", is_history)
    old = checkpointed(group_digests(sides.filter("__old"), id_column))
    new = group_digests(sides.filter("NOT __old"), id_column)
    shards = max(MIN_SHARDS, -(-old.count() // SHARD_KEYS))
    index = checkpointed(build_index(old, shards))
    groups = checkpointed(merge_groups(new, index, shards))
    total = groups.agg(F.sum("size")).first()[0] or 0
    return groups, total


def halves(id_column: str) -> Column:
    """History for a table without one: a fixed half of the rows by identifier."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(2)) == 0


def groups_per_row(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: identifier, keep_id, group_size, kept, text_sha256."""
    rows = checkpointed(docs.select(F.col(id_column), digest_of(text).alias("digest")))
    groups, total = dedup_groups(rows, halves(id_column), id_column)
    joined = join_on_hot_key(rows, groups, "digest", "size", total)
    return joined.select(
        id_column,
        F.col("winner").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col(id_column).eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def unique_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one per distinct text stays."""
    keyed = docs.withColumn("__digest", digest_of(text))
    rows = checkpointed(keyed.select(F.col(id_column), F.col("__digest").alias("digest")))
    groups, _ = dedup_groups(rows, halves(id_column), id_column)
    # one winner per text: this join has no hot key on either side once the losers are filtered by identifier
    winners = groups.select(
        F.col("digest").alias("__digest"), F.col("winner").alias("__winner"), F.col("repeats").alias("__repeats"),
        F.col("size").alias("__size"),
    )
    return _only_winners(keyed, winners, rows.count(), id_column).select(*docs.columns)


def _only_winners(keyed: DataFrame, winners: DataFrame, total: int, id_column: str) -> DataFrame:
    joined = join_on_hot_key(keyed, winners, "__digest", "__size", total)
    kept = joined.filter(F.col(id_column).eqNullSafe(F.col("__winner")))
    return keep_one_row(kept.drop("__winner", "__size"), "__digest", "__repeats")
