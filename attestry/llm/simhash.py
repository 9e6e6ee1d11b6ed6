"""SimHash near-duplicates: 64-bit fingerprints linked at three or fewer differing bits, by pigeonring filtering.

The 64 bits form a ring of four segments. If two fingerprints differ in at most three bits then, from some
segment on, every chain of l consecutive segments has at most floor(3 l / 4) differing bits: none in its first
segment, at most one in the first two, two in the first three, three in all four. Since at most one bit differs
in the second segment, one of its halves is equal too. So each distinct fingerprint is filed under eight keys
(start of the chain, which half, 16 + 8 equal bits), rows of one key are compared in the streaming pass over
key-sorted partitions, the chain's budgets prune before the full Hamming check, and only links of a spanning
forest leave the pass: a key with b fingerprints sends at most b - 1 rows (small keys at most 28). Links of one
component are never lost, since within a key all its members are compared until they are connected.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows
and exact copies share a fingerprint and so a component; null identifiers are ignored as component ids unless
all are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import checkpointed, join_on_hot_key, keep_one_row, map_texts
from attestry.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS, SEGMENT_BITS = 4, 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# shingles hashed at once within one text, so that a very long text needs little memory
CHUNK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the whole text's shingles of ``shingle`` words, as an unsigned number."""
    return fingerprint_of(words_of(text), shingle)


def fingerprint_of(words: list[bytes], shingle: int = SHINGLE) -> int:
    if not words:
        return 0
    size = min(shingle, len(words))
    count = len(words) - size + 1
    joined = map(b" ".join, zip(*(islice(words, i, None) for i in range(size)), strict=False))
    hashes, ones = map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.zeros(64, dtype=np.int64)
    for _ in range(0, count, CHUNK):
        some = np.array([*islice(hashes, CHUNK)], dtype=">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """``columns`` of every row and ``name``, the fingerprint's bits as a signed long."""

    def compute():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))]

    return map_texts(docs, columns, f"`{name}` long", compute, text)


def ring_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): the eight keys of each fingerprint."""
    made = []
    for start in range(SEGMENTS):
        first = f"shiftrightunsigned(fp, {start * SEGMENT_BITS}) & 65535"
        second = f"shiftrightunsigned(fp, {(start + 1) % SEGMENTS * SEGMENT_BITS})"
        for half in range(2):
            rest = f"shiftrightunsigned({second}, {half * 8}) & 255"
            made.append(f"{start << 25 | half << 24}L + (({first}) << 8) + ({rest})")
    return distinct.select(F.explode(F.expr(f"array({', '.join(made)})")).alias("key"), "fp")


def in_chain(difference: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether the differing bits stay within the budgets of every chain length from segment ``start`` on."""
    total = np.zeros(difference.shape, dtype=np.int64)
    within = np.ones(difference.shape, dtype=bool)
    for length in range(1, SEGMENTS + 1):
        shift = ((start + length - 1) % SEGMENTS) * SEGMENT_BITS
        segment = (difference >> np.asarray(shift).astype(np.uint64)) & np.uint64(0xFFFF)
        total += np.bitwise_count(segment)
        within &= total <= MAX_BITS * length // SEGMENTS
    return within


def linked(difference: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Candidates that pass the chain filter, then the full Hamming check."""
    found = in_chain(difference, start)
    found[found] = np.bitwise_count(difference[found]) <= MAX_BITS
    return found


def _forest(values: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among the fingerprints of one key; at most one less than those."""
    left = values
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            near = linked(left ^ reached[-1], start)
            one = reached.pop()
            if near.any():
                yield np.full(int(near.sum()), one), left[near]
                reached.extend(left[near])
                left = left[~near]


def _run_links(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key, all runs complete."""
    out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    lengths = np.diff(bounds)
    for run in np.flatnonzero(lengths > 8):
        lo, hi = bounds[run], bounds[run + 1]
        for a, b in _forest(values[lo:hi], int(keys[lo]) >> 25):
            out_a.append(a)
            out_b.append(b)
    small = np.repeat(lengths <= 8, lengths)
    keys, values = keys[small], values[small]
    for step in range(1, 8):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        near = linked(values[same] ^ values[same + step], keys[same] >> 25)
        out_a.append(values[same][near])
        out_b.append(values[same + step][near])
    return np.concatenate(out_a), np.concatenate(out_b)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links of a spanning forest per key among the distinct fingerprints."""

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key so far

        def emit(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if held and keys[-1] == held[-1][0][-1]:  # the whole batch goes on with the held key
                held.append((keys, values))
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            done = [*held, (keys[:cut], values[:cut])]
            held = [(keys[cut:], values[cut:])]
            yield emit(*_run_links(np.concatenate([k for k, _ in done]), np.concatenate([v for _, v in done])))
        if held:
            yield emit(*_run_links(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])))

    keyed = ring_keys(distinct)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(stream, "a long, b long")


def clusters(rows: DataFrame, id_column: str, link: Callable[[DataFrame], DataFrame] = links) -> tuple[DataFrame, int]:
    """(fp, component_id, repeats, size) per distinct fingerprint of ``rows`` (identifier, fp).

    ``link`` gives the links (a, b) among the distinct fingerprints.
    ``repeats`` is how many rows carry the component's identifier, ``size`` the rows of this fingerprint.
    """
    smallest = F.struct(F.col(id_column).isNull(), F.col(id_column))
    per_fp = checkpointed(
        rows.groupBy("fp", id_column).agg(F.count("*").alias("n"))
        .groupBy("fp").agg(F.min(id_column).alias("least"), F.min_by("n", smallest).alias("n"), F.sum("n").alias("size"))
    )
    roots = components(link(per_fp.select("fp")))
    rooted = per_fp.join(roots, per_fp["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = rooted.drop("node")
    least_first = F.struct(F.col("least").isNull(), F.col("least"))
    # an identifier repeated with two fingerprints of one component counts in both
    named = rooted.groupBy("root", "least").agg(F.sum("n").alias("n")).groupBy("root").agg(
        F.min("least").alias("component_id"), F.min_by("n", least_first).alias("repeats")
    )
    out = checkpointed(rooted.select("fp", "root", "size").join(named, "root"))
    return out, out.agg(F.sum("size")).first()[0] or 0


def near_duplicate_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: identifier, fingerprint (16 hex digits), component_id."""
    rows = checkpointed(fingerprints(docs, [id_column], text))
    found, total = clusters(rows, id_column)
    return join_on_hot_key(rows, found, "fp", "size", total).select(
        id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_component(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    rows: DataFrame | None = None,
    mark: Callable[..., DataFrame] = fingerprints,
    link: Callable[[DataFrame], DataFrame] = links,
) -> DataFrame:
    """The rows of ``docs``, all columns, of which one per component stays: the smallest identifier.

    ``mark`` gives the fingerprints, ``rows`` are those of all ``docs`` if they exist already.
    """
    rows = checkpointed(mark(docs, [id_column], text)) if rows is None else rows
    found, total = clusters(rows, id_column, link)
    decided = join_on_hot_key(rows, found, "fp", "size", total)
    kept = decided.filter(F.col(id_column).eqNullSafe(F.col("component_id")))
    # identifiers that stay are distinct apart from repeated ones, so this join has no hot key
    again = rows.groupBy(F.col(id_column).alias("__id")).agg(F.count("*").alias("__rows"))
    stay = kept.groupBy(F.col(id_column).alias("__stay"), F.col("fp").alias("__fp")).agg(
        F.max("repeats").alias("__repeats"), F.first("root").alias("__root")
    )
    stay = stay.join(again, F.col("__stay").eqNullSafe(F.col("__id"))).drop("__id")
    joined = docs.join(stay, docs[id_column].eqNullSafe(stay["__stay"])).drop("__stay")
    # where several rows share an identifier, the fingerprint tells which of them stays
    same = mark(joined.filter("__rows > 1"), joined.columns, text, "__now").filter("__now = __fp")
    chosen = joined.filter("__rows = 1").unionByName(same.select(*joined.columns))
    return keep_one_row(chosen.drop("__fp", "__rows"), "__root", "__repeats").select(*docs.columns)
