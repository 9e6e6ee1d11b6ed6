"""Removal of byte strings that repeat anywhere, by external induced sorting of shards.

A string of ``length`` bytes is found again wherever it stands, so equal strings must meet in one shard. Every
window of that length has an anchor: the leftmost of its ``GRAM``-byte grams with the least hash, which depends on
the window's content alone. Windows of a text that share an anchor follow one another and make one segment.

1. Per text: its SHA-256 and its segments (hash of the anchor's gram, hash of the segment, place). No text moves.
2. Segments whose anchor gram occurs once in all texts can't repeat. The others are dealt to shards by the gram;
   equal segments go once, with their number, so large groups of copies shrink before anything is sorted.
3. Of each shard's segments, the windows that share the longer side of their gram with another segment
   are sorted by ``induced_sorting``; a window repeats if the common prefix with a neighbour
   reaches ``length``, or if its segment occurs more than once.
4. Found windows go back to their texts; the union of their bytes is removed.

Grams with very many different segments (a passage that many texts quote in different surroundings) would make one
shard large: above ``HOT_SEGMENTS`` their windows are counted by hash instead, so no shard grows with a passage's
popularity and none is cut.

Defined results: null text is the empty text; texts shorter than ``length`` lose nothing; repeated rows count as
elsewhere, so all of them lose all their bytes if long enough. Rows are matched by content, so null or repeated
identifiers do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry.llm.common import join_on_hot_key, map_texts
from attestry.llm.induced_sorting import long_repeats
from attestry.session import shared_folder

LENGTH = 400
GRAM = 32
#: Bytes of segments per shard on average.
SHARD_BYTES = 4 << 20
HOT_SEGMENTS = 20_000
_PLACE_BITS = 20
_RANDOM = np.random.default_rng(11).integers(1, (1 << 64) - 1, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(count - 1, base, dtype=np.uint64)]))


_CHUNK = 1 << 18  # windows at once; their places fit _PLACE_BITS
_UP, _DOWN = _powers(_BASE, _CHUNK + 4 * LENGTH), _powers(_INVERSE, _CHUNK + 4 * LENGTH)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram of the bytes, which depends on the gram only."""
    with np.errstate(over="ignore"):
        total = np.cumsum(_RANDOM[data] * _UP[: len(data)])
        count = len(data) - GRAM + 1
        grams = total[GRAM - 1 :].copy()
        grams[1:] -= total[: count - 1]
        grams *= _DOWN[:count]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        return grams ^ (grams >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every stretch of ``width``, from running minima of blocks of that width."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    shaped = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(shaped, axis=1).ravel()
    backward = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(backward[:count], forward[width - 1 : width - 1 + count])


def anchored_segments(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, window after the last, place of the gram) per segment, in order."""
    windows, width = len(data) - length + 1, length - GRAM + 1
    if windows <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    raw = np.frombuffer(data, dtype=np.uint8)
    anchors, grams = [], []
    for at in range(0, windows, _CHUNK):
        here = min(_CHUNK, windows - at)
        hashes = gram_hashes(raw[at : at + here + length - 1])
        low = np.uint64((1 << _PLACE_BITS) - 1)
        # equal hashes in one window: the leftmost; the place decides through the low bits
        least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width)
        place = (least & low).astype(np.int64)
        anchors.append(place + at)
        grams.append(hashes[place])
    anchor, gram = np.concatenate(anchors), np.concatenate(grams)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return gram[first], first, np.append(first[1:], windows), anchor[first]


def segments(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, window after the last) per segment, in order."""
    return anchored_segments(data, length)[:3]


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here and lost executors do no harm."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _per_text(docs: DataFrame, id_column: str, text: str, length: int) -> DataFrame:
    """Identifier, digest, n_bytes and the segments of every row: gram, whole, first window, way from it to the gram."""

    def compute():
        def of_texts(texts):
            digests, sizes, rows = [], [], []
            for t in texts:
                data = (t or "").encode("utf-8")
                digests.append(hashlib.sha256(data).digest())
                sizes.append(len(data))
                gram, first, end, anchor = anchored_segments(data, length)
                whole = [xxhash.xxh3_64_intdigest(data[a : b + length - 1]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                rows.append((gram.view(np.int64), np.array(whole, dtype=np.uint64).view(np.int64), first.astype(np.int32), (anchor - first).astype(np.int32)))
            ends = pa.array(np.cumsum([0] + [len(r[0]) for r in rows]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, np.concatenate([r[k] for r in rows])) for k in range(4)]
            return [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *lists]

        return of_texts

    fields = "digest binary, n_bytes long, grams array<long>, wholes array<long>, firsts array<int>, ways array<int>"
    return map_texts(docs, [id_column], fields, compute, text)


def _sides(bodies: list[bytes], grams: list[int], ways: list[int], copies: list[int], length: int) -> list[tuple[int, int]]:
    """Windows (from, to) of each segment that may repeat in another one; none if from is not below to.

    Equal windows hold the gram at one offset, so they share what lies on its longer side: at least half of the window
    without the gram. A side is only worth sorting if another segment of the gram has the same bytes there.
    """
    side = (length - GRAM) // 2
    left, right, found = Counter(), Counter(), []
    for body, gram, way, n in zip(bodies, grams, ways, copies, strict=True):
        windows = len(body) - length + 1
        before = (gram, xxhash.xxh3_64_intdigest(body[way - side : way])) if way >= side else None
        least = way - (length - GRAM - side)  # first window with enough of the right side
        after = (gram, xxhash.xxh3_64_intdigest(body[way + GRAM : way + GRAM + side])) if windows - 1 >= least else None
        left[before] += n
        right[after] += n
        found.append((windows, before, after, max(least, 0), min(way - side + 1, windows)))
    out = []
    for n, (windows, before, after, low, high) in zip(copies, found, strict=True):
        by_left, by_right = before is not None and left[before] > n, after is not None and right[after] > n
        out.append((0 if by_left else low, windows if by_right else high) if by_left or by_right else (0, 0))
    return out


def _shard_windows(table: pa.Table, length: int) -> pa.Table:
    """Flagged windows of a shard's segments as (gram, whole, from, to) with ``to`` exclusive."""
    # a repeated row may bring a segment twice
    columns = {c: table.column(c).to_pylist() for c in ("gram", "whole", "copies", "way", "body")}
    chosen = list({k: i for i, k in enumerate(zip(columns["gram"], columns["whole"], strict=True))}.values())
    grams, wholes, copies, ways, bodies = ([v[i] for i in chosen] for v in columns.values())
    sides = _sides(bodies, grams, ways, copies, length)
    parts = [b[low : high - 1 + length] for b, (low, high) in zip(bodies, sides, strict=True) if low < high]
    flags = long_repeats(parts, length) if len(parts) > 1 else None
    out: list[tuple] = []
    at = 0
    for gram, whole, n, body, (low, high) in zip(grams, wholes, copies, bodies, sides, strict=True):
        if n > 1:
            out.append((gram, whole, 0, len(body) - length + 1))
        elif low < high and flags is not None:
            out += [(gram, whole, low + a, low + b) for a, b in runs(flags[at : at + high - low])]
        at += high - low + length if low < high else 0
    gram, whole, low, high = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({
        "gram": pa.array(gram, pa.int64()), "whole": pa.array(whole, pa.int64()),
        "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32()),
    })


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """(gram, whole, copies, way, body) of the wanted segments of each text."""

    def run(batches):
        for whole in batches:
            for n in range(whole.num_rows):
                row = whole.slice(n, 1).to_pylist()[0]
                data = row["text"].encode("utf-8")
                bodies = [data[s["first"] : s["last"] + length] for s in row["wanted"]]
                take = lambda k: [s[k] for s in row["wanted"]]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(take("gram"), pa.int64()), pa.array(take("whole"), pa.int64()), pa.array(take("copies"), pa.int64()),
                     pa.array(take("way"), pa.int32()), pa.array(bodies, pa.binary())],
                    names=["gram", "whole", "copies", "way", "body"],
                )

    return texts.select("text", "wanted").mapInArrow(run, "gram long, whole long, copies long, way int, body binary")


def _hot_windows(cut: DataFrame, length: int) -> DataFrame:
    """Flagged windows of segments of hot grams: every window by its hash, counted with its segment's copies."""

    def run(batches):
        for batch in batches:
            for gram, whole, copies, body in zip(*(batch.column(c).to_pylist() for c in ("gram", "whole", "copies", "body")), strict=True):
                hashes = [xxhash.xxh3_128_digest(body[i : i + length]) for i in range(len(body) - length + 1)]
                size = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gram] * size, pa.int64()), pa.array([whole] * size, pa.int64()), pa.array([copies] * size, pa.int64()),
                     pa.array(range(size), pa.int32()), pa.array(hashes, pa.binary())],
                    names=["gram", "whole", "copies", "low", "window"],
                )

    windows = cut.dropDuplicates(["gram", "whole"]).mapInArrow(run, "gram long, whole long, copies long, low int, window binary")
    repeated = windows.groupBy("window").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    return windows.join(repeated, "window").select("gram", "whole", "low", (F.col("low") + 1).cast("int").alias("high"))


def repeated_bytes(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, hot_segments: int = HOT_SEGMENTS
) -> DataFrame:
    """One row per document: identifier, n_bytes, n_removed, n_spans, kept_sha256, the removed ``spans`` and whether it ``repeats``."""
    rows = _stored(_per_text(docs, id_column, text, length), "rows")
    texts = rows.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(id_column).alias("one"), F.first("n_bytes").alias("n_bytes"),
        F.first(F.struct("grams", "wholes", "firsts", "ways")).alias("found"),
    )
    texts = _stored(texts, "texts")
    following = F.expr("coalesce(try_element_at(found.firsts, place + 2), cast(n_bytes - {} as int))".format(length - 1)) - 1
    every = (
        texts.filter(F.size("found.grams") > 0)
        .select("*", F.posexplode("found.grams").alias("place", "gram"))
        .select(
            "digest", "copies", "one", "gram", F.col("found.wholes")[F.col("place")].alias("whole"), F.col("found.ways")[F.col("place")].alias("way"),
            F.col("found.firsts")[F.col("place")].alias("first"), following.alias("last"),
        )
    )
    # a gram that occurs once has no repeats: only places of the others are stored
    # (stored, so that the join reads two plain shuffles, of which adaptive execution can split a hot gram)
    repeated = _stored(every.groupBy("gram").agg(F.sum("copies").alias("all")).filter("all > 1").select("gram"), "repeated")
    placed = _stored(every.join(repeated, "gram", "left_semi"), "placed")
    kinds = placed.groupBy("gram", "whole").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("places"), F.first("way").alias("way"),
        F.min(F.struct("digest", "one", "first", "last")).alias("at"),
    )
    # one row per gram with over ``hot_segments`` segments
    hot = placed.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > hot_segments)
    hot = placed.join(_stored(hot.select("gram"), "often"), "gram", "left_semi").select("gram", "whole").distinct().groupBy("gram").count()
    hot = hot.filter(F.col("count") > hot_segments).select("gram", F.lit(True).alias("hot"))
    wanted = _stored(kinds.join(hot, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "wanted")
    size = wanted.agg(F.sum(F.col("at.last") - F.col("at.first") + length)).first()[0] or 0
    shards = max(64, -(-size // SHARD_BYTES))

    keyed = docs.select(
        F.col(id_column).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("__digest", F.unhex(F.sha2("text", 256)))

    def cut(kinds: DataFrame) -> DataFrame:
        per_text = kinds.groupBy(F.col("at.digest").alias("digest"), F.col("at.one").alias("one")).agg(
            F.collect_list(F.struct("gram", "whole", "copies", "way", "at.first", "at.last")).alias("wanted")
        )
        found = keyed.join(per_text, (F.col("__digest") == per_text["digest"]) & F.col("__id").eqNullSafe(per_text["one"]))
        return _cut(found, length)

    dealt = cut(wanted.filter("NOT hot")).withColumn("shard", F.pmod("gram", F.lit(shards)).cast("int"))
    sorted_ = dealt.groupBy("shard").applyInArrow(
        lambda table: _shard_windows(table, length), "gram long, whole long, low int, high int"
    )
    flagged = sorted_.unionByName(_hot_windows(cut(wanted.filter("hot")), length))
    per_kind = flagged.groupBy("gram", "whole").agg(F.collect_list(F.struct("low", "high")).alias("windows"))
    per_kind = _stored(per_kind.join(wanted.select("gram", "whole", "places"), ["gram", "whole"]), "flagged")

    total = placed.count()
    key = F.struct("gram", "whole")
    back = join_on_hot_key(
        placed.select("digest", "first", key.alias("key")), per_kind.select(key.alias("key"), "windows", "places"), "key", "places", total
    )
    spans = back.select(
        "digest",
        F.transform(
            "windows",
            lambda w: F.struct((w["low"] + F.col("first")).alias("low"), (w["high"] + F.col("first") + length - 1).alias("high")),
        ).alias("spans"),
    ).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = spans.join(texts.select("digest", "copies", "one", "n_bytes"), "digest")
    spans = _stored(_merged(spans), "spans")
    partial = spans.filter("n_removed < n_bytes").select("digest", "one", "spans")
    texts_left = keyed.join(partial, (F.col("__digest") == partial["digest"]) & F.col("__id").eqNullSafe(partial["one"]))
    # texts of which a part stays; of all others the hash is known
    kept = _kept_hashes(texts_left.select("digest", "text", "spans")).dropDuplicates(["digest"])
    told = spans.join(kept, "digest", "left").withColumn("kept_sha256", F.coalesce("kept_sha256", F.sha2(F.lit(""), 256)))
    told = _stored(told.select("digest", "copies", "n_removed", "n_spans", "spans", "kept_sha256"), "told")
    with_spans = join_on_hot_key(rows.select(id_column, "digest", "n_bytes"), told, "digest", "copies", rows.count())
    without = rows.join(told.select("digest"), "digest", "left_anti").select(
        id_column, "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.lower(F.hex("digest")).alias("kept_sha256"), F.expr(f"cast(array() as {SPANS})").alias("spans"),
    )
    told = with_spans.select(id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans").unionByName(without)
    return told.withColumn("repeats", F.col("n_removed") > 0)


SPANS = "array<struct<low:int,high:int>>"


def union_of(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the union of spans; touching spans are one."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    first = np.concatenate([[True], low[1:] > reach[:-1]])
    return low[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(low) - 1)]


def _merged(spans: DataFrame) -> DataFrame:
    """One row per text with spans: digest, copies, one, n_bytes, n_removed, n_spans, spans (apart, in order)."""
    kept = ["digest", "copies", "one", "n_bytes"]
    schema = spans.select(*kept).schema

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("spans"))
            made = [union_of(*(np.array(s.values.field(k)) for k in ("low", "high"))) for s in column]
            values = [np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int32) for k in range(2)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0] + [len(m[0]) for m in made]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in values], names=["low", "high"]),
            )
            removed = pa.array([int((m[1] - m[0]).sum()) for m in made], pa.int64())
            count = pa.array([len(m[0]) for m in made], pa.int64())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, removed, count, lists], names=[*kept, "n_removed", "n_spans", "spans"])

    out = StructType([*schema.fields, *StructType.fromDDL(f"n_removed long, n_spans long, spans {SPANS}").fields])
    return spans.mapInArrow(run, out)


def _kept_hashes(texts: DataFrame) -> DataFrame:
    """(digest, kept_sha256) of each text without its spans."""

    def run(batches):
        for batch in batches:
            hashes = []
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                data, at, left = row["text"].encode("utf-8"), 0, hashlib.sha256()
                for span in row["spans"]:
                    left.update(data[at : span["low"]])
                    at = span["high"]
                left.update(data[at:])
                hashes.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string())], names=["digest", "kept_sha256"])

    return texts.mapInArrow(run, "digest binary, kept_sha256 string")
