"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over ten consecutive tokens that hashes the tokens under its ones and ignores the
others, so a replaced token does not break a hit as long as one mask skips it. Seeds of all benchmark positions
are matched with seeds of all document positions, those of a whole batch of documents at once; each hit names an
item and a diagonal (document position minus item position). Along the diagonal the maximal segments are found with +1 per equal and -4 per differing token, so at
least four fifths of the tokens of each are equal; the best one counts, and all others with MIN_TOKENS equal tokens
or more, since those apart by a replaced stretch are parts of one copy. A document is contaminated by an item when
the equal tokens of all its segments cover at least ``min_share`` of the item, or when one segment has LONG equal
tokens or more, whatever its share of the item.

The benchmark is handed to the tasks in blocks of bounded size, each one pass over the documents; usually there
is one block. Items of five to nine tokens have no full seed; they are matched whole with masks of their own length
that skip one position each, so one replaced token is borne. Shorter items match nothing.

Defined results: null or empty texts contain nothing; repeated rows are judged one by one; an empty benchmark
leaves every document clean. Null items are ignored; a null item_id is reported as null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestry.llm.common import map_texts

MASKS = ("1101101011", "1110010111", "1011101101", "1111000111")
SPAN = 10
MIN_TOKENS = 5
MISMATCH = 4
LONG = 13
# benchmark tokens per block: about 8 bytes each and 16 more per mask in a task
BLOCK_TOKENS = 2_000_000
FACTORS = np.random.default_rng(5).integers(1 << 62, (1 << 63) - 1, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FILTER_BITS = 22
WORD = re.compile(r"[^\W_]+")


def token_hashes(text: str | None) -> np.ndarray:
    return np.array([*map(xxhash.xxh64_intdigest, WORD.findall((text or "").lower()))], dtype=np.uint64)


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """One hash per position at which the whole mask fits."""
    count = len(tokens) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    mixed = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                mixed += tokens[i : i + count] * FACTORS[i]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def short_seeds(tokens: np.ndarray, length: int) -> list[np.ndarray]:
    """Per skipped position one hash per window of ``length`` tokens."""
    count = len(tokens) - length + 1
    if count <= 0:
        return [np.zeros(0, dtype=np.uint64)] * length
    with np.errstate(over="ignore"):
        parts = [tokens[i : i + count] * FACTORS[i] for i in range(length)]
        whole = np.sum(parts, axis=0, dtype=np.uint64)
        return [whole - part for part in parts]


class Table:
    """Sorted seed hashes with item and position, and a filter of the leading bits that occur."""

    def __init__(self, seeds: list[tuple[int, np.ndarray]]):
        hashes = np.concatenate([h for _, h in seeds])
        item = np.concatenate([np.full(len(h), k) for k, h in seeds])
        at = np.concatenate([np.arange(len(h)) for _, h in seeds])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], item[order], at[order]
        # 64 cells a seed or more, up to FILTER_BITS
        self.shift = np.uint64(64 - min(FILTER_BITS, len(hashes).bit_length() + 6))
        self.present = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.present[(hashes >> self.shift).astype(np.int64)] = True

    def hits(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the seeds that occur here, and the row of the table each meets."""
        place = np.flatnonzero(self.present[(seeds >> self.shift).astype(np.int64)])
        low = np.searchsorted(self.hashes, seeds[place], "left")
        many = np.searchsorted(self.hashes, seeds[place], "right") - low
        entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(place, many), entry


class Block:
    """Seed tables of some benchmark items: per mask sorted hashes with item and position."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.tokens = [t for _, t in items]
        whole = [(k, t) for k, t in enumerate(self.tokens) if len(t) >= SPAN]
        self.tables = [(mask, Table([(k, seed_hashes(t, mask)) for k, t in whole])) for mask in MASKS if whole]
        self.short = []
        for length in sorted({len(t) for t in self.tokens if len(t) < SPAN}):
            seeds = [(k, short_seeds(t, length)) for k, t in enumerate(self.tokens) if len(t) == length]
            self.short.append((length, [Table([(k, h[skip]) for k, h in seeds]) for skip in range(length)]))

    def diagonals(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, diagonal) of all hits, sorted; text k is ``tokens[bounds[k] : bounds[k + 1]]``."""
        found = [np.zeros((0, 3), dtype=np.int64)]

        def add(table: Table, seeds: np.ndarray, span: int):
            place, entry = table.hits(seeds)
            of = np.searchsorted(bounds, place, "right") - 1
            # a seed that reaches into the next text is none
            inside = place + span <= bounds[of + 1]
            if not inside.any():
                return
            place, entry, of = place[inside], entry[inside], of[inside]
            found.append(np.unique(np.stack([of, table.item[entry], place - bounds[of] - table.at[entry]], axis=1), axis=0))

        for mask, table in self.tables:
            add(table, seed_hashes(tokens, mask), SPAN)
        for length, tables in self.short:
            for table, seeds in zip(tables, short_seeds(tokens, length), strict=True):
                add(table, seeds, length)
        return np.unique(np.concatenate(found), axis=0)

    def overlaps_of_texts(self, texts: list, min_share: float) -> list[list[tuple[object, int, int, float]]]:
        """The contaminating items of each text; seeds of all texts are matched at once."""
        hashed = [token_hashes(t) for t in texts]
        bounds = np.cumsum([0, *map(len, hashed)])
        out: list[list] = [[] for _ in texts]
        hits = self.diagonals(np.concatenate([np.zeros(0, dtype=np.uint64), *hashed]), bounds)
        for rows in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1) if len(hits) else []:
            text = rows[0, 0]
            out[text] = self.overlaps(hashed[text], rows[:, 1:], min_share)
        return out

    def overlaps(self, tokens: np.ndarray, diagonals: np.ndarray, min_share: float) -> list[tuple[object, int, int, float]]:
        """(item_id, first token, end token, share of the item) for every contaminating item of one text."""
        covered: dict[int, list] = {}
        for k, diagonal in diagonals:
            item = self.tokens[k]
            low, high = max(0, diagonal), min(len(tokens), diagonal + len(item))
            equal = tokens[low:high] == item[low - diagonal : high - diagonal]
            if len(item) < SPAN:
                # a short item is in place as a whole, with one replaced token at most
                found = [(0, len(item))] if len(equal) == len(item) and equal.sum() >= len(item) - 1 else []
            else:
                best = best_segment(equal)
                found = [x for x in segments(equal) if equal[x[0] : x[1]].sum() >= MIN_TOKENS]
                found += [best] if best not in found and best[0] < best[1] else []
            if not found:
                continue
            state = covered.setdefault(int(k), [np.zeros(len(item), dtype=bool), len(tokens), 0, False])
            shift = low - diagonal
            for start, end in found:
                state[0][shift + start : shift + end] |= equal[start:end]
                state[1], state[2] = min(state[1], low + start), max(state[2], low + end)
                state[3] |= bool(equal[start:end].sum() >= LONG)
        out = []
        for k, (seen, start, end, long) in sorted(covered.items()):
            share = float(seen.sum()) / len(seen)
            if share >= min_share or long:
                out.append((self.ids[k], int(start), int(end), share))
        return out


def segments(equal: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of all maximal segments by the sum of +1 per equal and -MISMATCH per differing token, apart from each other."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]]))).tolist()
    held: list[tuple[int, int, int, int]] = []  # start, end, sum before, sum at the end
    total = last = 0
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        before = total - MISMATCH * (start - last)
        total, last = before + end - start, end
        left, upto = before, len(held)
        # joined with an earlier one that begins no higher if no end between lies as high; of equal sums the longer
        while True:
            j = upto - 1
            while j >= 0 and held[j][2] > left:
                j -= 1
            if j < 0 or held[j][3] >= total:
                break
            start, left, upto = held[j][0], held[j][2], j
        held[upto:] = [(start, end, left, total)]
    return [(start, end) for start, end, _, _ in held]


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """Bounds of the segment with the largest sum of +1 per equal and -MISMATCH per differing token."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    return int(np.argmax(total[: end + 1] == lowest[end])), end


OVERLAP = "array<struct<item_id:{kind},first_token:int,end_token:int,share:double>>"


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """The benchmark's items in blocks of bounded size, one at a time on the driver."""

    def compute():
        return lambda texts: [pa.array([token_hashes(t).view(np.int64) for t in texts], pa.list_(pa.int64()))]

    items = map_texts(benchmark.filter(F.col(text).isNotNull()), [item_id], "tokens array<long>", compute, text)
    items = items.filter(F.size("tokens") >= MIN_TOKENS)
    total = items.agg(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TOKENS))
    for n in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("tokens"), F.lit(blocks)) == n)
        yield [(i, np.array(t, dtype=np.int64).view(np.uint64)) for i, t in part.collect()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    columns: list[str],
    name: str = "overlaps",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_share: float = 0.5,
) -> DataFrame:
    """``columns`` of every row and an array column ``name`` of the items it overlaps."""
    kind = benchmark.schema[item_id].dataType.simpleString()
    field, id_type = OVERLAP.format(kind=kind), to_arrow_type(benchmark.schema[item_id].dataType)
    context, out = docs.sparkSession.sparkContext, None
    for items in _blocks(benchmark, item_id, item_text):
        shared = context.broadcast(items)  # at most BLOCK_TOKENS tokens and one item
        columns_now, field_name = columns if out is None else out.columns, name if out is None else "__more"

        def compute(shared=shared):
            block = Block(shared.value)

            def of_texts(texts):
                rows = block.overlaps_of_texts(texts, min_share)
                parts = list(zip(*[r for row in rows for r in row], strict=True)) or [(), (), (), ()]
                values = pa.StructArray.from_arrays(
                    [pa.array(list(parts[0]), id_type), pa.array(parts[1], pa.int32()), pa.array(parts[2], pa.int32()), pa.array(parts[3], pa.float64())],
                    names=["item_id", "first_token", "end_token", "share"],
                )
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                return [pa.ListArray.from_arrays(pa.array(ends), values)]

            return of_texts

        if out is None:
            with_text = columns_now if text in columns_now else [*columns_now, text]
            out = map_texts(docs, with_text, f"`{field_name}` {field}", compute, text)
        else:
            out = map_texts(out, columns_now, f"{field_name} {field}", compute, text)
            out = out.withColumn(name, F.concat(name, field_name)).drop(field_name)
    return out.select(*columns, name)


def contaminated(name: str = "overlaps") -> Column:
    return F.size(name) > 0
