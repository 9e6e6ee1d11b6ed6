"""Near copies: SimHash fingerprints of five-word shingles within three bits, or four fifths of the shingles in common.

The first kind is that of the SimHash operator with longer shingles: the same words, fingerprints, ring keys, chain
budgets and Hamming check, and no link is lost. Three of 64 bits are stricter than four fifths, where some ten bits
differ and no ring key selects any more, so the second kind is sought beside it and adds links only.

A document's set hash is the hash of its set of shingles, so texts with equal sets share it. Pairs of the second kind
are sought by MinHash: 80 least hashes in 20 bands of four; two documents with a band in common are candidates. A pair
at similarity s shares a band with probability 1 - (1 - s^4)^20, which is 0.99997 at 0.8 and more above; this is the
only place where a pair can be missed. Each of these links is then decided by the exact similarity of the two whole
sets, so no document goes for a candidate that is not a near copy.

Of bands with the same members one is kept. Members of a band meet with their sets in one task and are compared
until they are connected; only links of a spanning forest leave it.

Defined results: texts of fewer than five words have one shingle of all their words; null, empty and blank texts have
none and are near copies of each other only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import simhash
from attestry.llm.common import checkpointed, join_on_hot_key, map_texts

WORDS = 5
# least similarity, as a fraction
SHARED, OF = 4, 5
BANDS, BAND_ROWS = 20, 4
CHUNK = 1024
FACTORS = np.random.default_rng(11).integers(1 << 62, (1 << 63) - 1, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RNG = np.random.default_rng(12)
TIMES = _RNG.integers(1 << 62, (1 << 63) - 1, (BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIXED = _RNG.integers(0, (1 << 63) - 1, (BANDS * BAND_ROWS, 1), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the whole text's shingles."""
    return shingles_of(simhash.words_of(text))


def shingles_of(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(WORDS, len(words))
    hashed = np.array([*map(xxhash.xxh64_intdigest, words, repeat(simhash.SEED))], dtype=np.uint64)
    count = len(words) - size + 1
    mixed = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        mixed += hashed[i : i + count] * FACTORS[i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    ordered = np.sort(mixed ^ (mixed >> np.uint64(32)))
    # as np.unique, which takes nine times as long on so few numbers
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def set_hash(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), simhash.SEED)


def bands(grams: np.ndarray) -> np.ndarray:
    """One hash per band of least hashes; none for an empty set."""
    if not len(grams):
        return np.zeros(0, dtype=np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), CHUNK):
        least = np.minimum(least, ((grams[None, at : at + CHUNK] ^ MIXED) * TIMES).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), band) for band, r in enumerate(rows)], dtype=np.uint64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, dtype=np.uint64), *parts])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def set_hashes(docs: DataFrame, columns: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """``columns`` of every row and ``name``, the hash of its set of shingles."""

    def compute():
        return lambda texts: [_signed([set_hash(shingles(t)) for t in texts])]

    return map_texts(docs, columns, f"`{name}` long", compute, text)


def _sketches(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    def compute():
        def of_texts(texts):
            words = [simhash.words_of(t) for t in texts]
            sets = [shingles_of(w) for w in words]
            prints = [simhash.fingerprint_of(w, WORDS) for w in words]
            return [_signed([set_hash(s) for s in sets]), _lists([bands(s) for s in sets]), _signed(prints)]

        return of_texts

    return map_texts(docs, [id_column], "fp long, bands array<long>, print long", compute, text)


def _sets(docs: DataFrame, text: str) -> DataFrame:
    def compute():
        def of_texts(texts):
            sets = [shingles(t) for t in texts]
            return [_signed([set_hash(s) for s in sets]), _lists(sets)]

        return of_texts

    return map_texts(docs, [], "fp long, grams array<long>", compute, text)


def forest(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of positions that connect all sets which near copies connect; at most one less than the sets."""
    sizes = np.array([len(s) for s in sets])
    kinds, codes = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = [codes[bounds[i] : bounds[i + 1]] for i in range(len(sets))]
    left = np.ones(len(sets), dtype=bool)
    open_codes, open_of, gone = codes, of, 0
    present = np.zeros(len(kinds), dtype=bool)
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], reached, gone = False, [first], gone + 1
        while reached:
            one = reached.pop()
            if gone * 4 > len(sets):  # sets already connected need no more counting
                stay = left[open_of]
                open_codes, open_of, gone = open_codes[stay], open_of[stay], 0
            present[own[one]] = True
            both = np.bincount(open_of[present[open_codes]], minlength=len(sets))
            present[own[one]] = False
            near = np.flatnonzero(left & (both * OF >= (sizes + sizes[one] - both) * SHARED))
            for other in near.tolist():
                yield one, other
            left[near] = False
            reached.extend(near.tolist())
            gone += len(near)


def _band_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) among rows (band, fp, grams) sorted by band."""
    band, prints, sets = None, [], []

    def emit():
        found = list(forest(sets)) if len(sets) > 1 else []
        a, b = (_signed([prints[pair[side]] for pair in found]) for side in (0, 1))
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    for batch in batches:
        lists = batch.column(2)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        of_fp = batch.column(1).to_numpy().view(np.uint64).tolist()
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key != band:
                yield emit()
                band, prints, sets = key, [], []
            prints.append(of_fp[i])
            sets.append(values[ends[i] : ends[i + 1]].copy())
    yield emit()


def fingerprint_links(sketches: DataFrame) -> DataFrame:
    """(a, b): links among fingerprints by the SimHash operator, and of set hashes to the fingerprints of their texts.

    Fingerprints that are linked to no other and belong to one set hash need none. Both kinds of nodes are 64-bit hashes.
    """
    pairs = checkpointed(sketches.select("print", "fp").distinct())
    sizes = pairs.groupBy("print").agg(F.count("*").alias("n"))
    ring = checkpointed(simhash.links(sizes.select(F.col("print").alias("fp"))))
    near = ring.select(F.col("a").alias("print")).unionByName(ring.select(F.col("b").alias("print"))).distinct()
    wanted = sizes.join(near.withColumn("linked", F.lit(True)), "print", "left").filter("linked OR n > 1").drop("linked")
    own = join_on_hot_key(pairs, checkpointed(wanted), "print", "n", pairs.count())
    return ring.select("a", "b").unionByName(own.select(F.col("fp").alias("a"), F.col("print").alias("b")))


def links(docs: DataFrame, sketches: DataFrame, id_column: str, text: str) -> DataFrame:
    """(a, b): links of a spanning forest per band among the set hashes."""
    distinct = sketches.select("fp", "bands").dropDuplicates(["fp"])
    keyed = checkpointed(distinct.select(F.explode("bands").alias("band"), "fp"))
    members = F.struct(F.count("*").alias("n"), F.min("fp"), F.max("fp"), F.bit_xor(F.xxhash64("fp"))).alias("members")
    shared = keyed.groupBy("band").agg(members).filter("members.n > 1")
    # bands with the same members would be compared to no use
    shared = shared.groupBy("members").agg(F.min("band").alias("band")).select("band")
    inside = checkpointed(keyed.join(shared, "band"))
    # one document for each fingerprint in question gives its set
    least = sketches.groupBy("fp").agg(F.min(id_column).alias("__one"))
    ids = least.join(inside.select("fp").distinct(), "fp").select("__one").distinct()
    sets = _sets(docs.join(ids, docs[id_column].eqNullSafe(ids["__one"]), "left_semi"), text).dropDuplicates(["fp"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = inside.join(sets, "fp").select("band", "fp", "grams")
    return met.repartition(parts, "band").sortWithinPartitions("band").mapInArrow(_band_links, "a long, b long")


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one per group of near copies stays: the smallest identifier."""
    sketches = checkpointed(_sketches(docs, id_column, text))
    return simhash.one_per_component(
        docs, id_column, text, rows=sketches.select(id_column, "fp"), mark=set_hashes,
        link=lambda _: fingerprint_links(sketches).unionByName(links(docs, sketches, id_column, text)),
    )
