"""Spelling variant grouping: words one edit apart, found by neighbourhoods over a reduced alphabet.

The letters of a word are hashed to four symbols, more where the vocabulary passes 2^25 words. All reduced words one edit away from a word's reduced form, and that form
itself, are generated and joined with the reduced vocabulary; what meets is verified on the original strings. The join key
also holds the half of the original word that the edit leaves alone, so few unrelated words meet even where very many
words share a reduced form. Reduced words are polynomial hashes: an edit changes one in a few operations,
whatever the word's length, and a colliding hash only costs a comparison.

A word's form is its near word of largest count if that count is at least twice its own; forms lead to a root. Counts
double with each step, so the number of pointer jumps follows from the largest count.

Defined results: null text has no words, a null identifier counts as the empty string where misspellings are planted;
repeated rows count each time. Among near words of equal count the smallest in code-point order decides. A word
without near words has ``n_near`` 0, null form and itself as root. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import BATCH_BYTES, checkpointed, ship_package, slices

RUNS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# more symbols mean more keys a word (four: some 65) and fewer words that meet by chance
FEWEST_SYMBOLS, BITS_PER_SYMBOL = 4, 5
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; wraps around."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base), dtype=np.uint64) * pow(int(base), -1, 1 << 64)


class ReducedWords:
    """A list of words as one flat array of letters and reduced symbols, with hashes of all their prefixes."""

    def __init__(self, words: list[str], symbols: int = FEWEST_SYMBOLS):
        self.symbols = symbols
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(letters)) - self.start[self.word]
        self.power = _powers(BASE, int(self.size.max(initial=0)) + 2)
        self.inverse = _powers(BASE_INVERSE, int(self.size.max(initial=0)) + 2)
        spread = _mixed(letters)
        # neighbouring code points fall to different symbols, which spreads the frequent letters about evenly
        self.symbol = (letters % np.uint64(symbols)).astype(np.int64)
        self.values = _mixed(np.arange(1, symbols + 1, dtype=np.uint64))
        self.codes = self._sums(self.values[self.symbol])
        self.whole = self._sums(spread)
        self.code = self._prefix(self.codes, self.size)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[self.place], dtype=np.uint64)])

    def _prefix(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the first ``n`` letters of each word."""
        return sums[self.start + n] - sums[self.start]

    def halves(self, change: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words ``change`` letters longer: half their length, and this word's first and last so many letters."""
        half = (self.size + change) // 2
        rest = self.size - half
        last = (self._prefix(self.whole, self.size) - self._prefix(self.whole, rest)) * self.inverse[rest]
        return half, self._prefix(self.whole, half), last

    def keys(self, code: np.ndarray, word: np.ndarray, change: int, behind: np.ndarray) -> np.ndarray:
        """Join keys of reduced words: code, length and the half without the edit (``behind``: the edit is in the second)."""
        _, first, last = self.halves(change)
        kept = np.where(behind, first[word], last[word])
        label = (self.size[word] + change).astype(np.uint64) * np.uint64(2) + behind.astype(np.uint64)
        return _mixed(code + _mixed(kept + _mixed(label))).view(np.int64)

    def own(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of the reduced words themselves: one key for each half that may be left alone."""
        every = np.arange(len(self.size))
        for behind in (True, False):
            yield every, self.keys(self.code, every, 0, np.full(len(every), behind))

    def neighbourhood(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of all reduced words one edit away, each once per side of the edit, and of the own ones."""
        yield from self.own()
        word, place, symbol = self.word, self.place, self.symbol
        total, base = self.code[word], self.start[word]
        before = self.codes[base + place] - self.codes[base]
        power = self.power[place]
        own = self.values[symbol] * power
        half = self.halves(0)[0][word]
        previous = np.concatenate([[-1], symbol[:-1]])
        previous[place == 0] = -1
        for t in range(self.symbols):  # another symbol in place of one
            at = np.flatnonzero(symbol != t)
            code = total[at] - own[at] + self.values[t] * power[at]
            yield word[at], self.keys(code, word[at], 0, place[at] >= half[at])
        # one symbol less; within a run of equal symbols the place only matters for the side it is on
        half = self.halves(-1)[0][word]
        at = np.flatnonzero((symbol != previous) | (place == half))
        code = before[at] + (total[at] - before[at] - own[at]) * BASE_INVERSE
        yield word[at], self.keys(code, word[at], -1, place[at] >= half[at])
        # one symbol more, before each place and at the end
        word = np.concatenate([word, np.arange(len(self.size))])
        place = np.concatenate([place, self.size])
        before = np.concatenate([before, self.code])
        ends = np.where(self.size > 0, symbol[self.start + self.size - 1] if len(symbol) else -1, -1)
        previous = np.concatenate([previous, ends])
        half = self.halves(1)[0][word]
        for t in range(self.symbols):
            at = np.flatnonzero((previous != t) | (place == half))
            code = before[at] + self.values[t] * self.power[place[at]] + (self.code[word[at]] - before[at]) * BASE
            yield word[at], self.keys(code, word[at], 1, place[at] >= half[at])


def planted(doc_id: Column, run: Column, every: int = 97) -> Column:
    """``run`` without one letter where the hash of identifier and run is a multiple of ``every``."""
    hashed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    cut = (hashed % F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.length(run)))
    return F.when(hashed % every == 0, without).otherwise(run)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = 5, times: int = 3) -> DataFrame:
    """(word, n) of all words of at least ``letters`` letters that occur at least ``times`` times."""
    runs = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(RUNS), F.lit(0))).alias("run")
    ).filter(F.length("run") >= letters)  # planting never lengthens a run
    words = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).select(planted(F.col("id"), F.col("run")).alias("word"))
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _keyed(words: DataFrame, columns: list[str], symbols: int, whole: bool) -> DataFrame:
    """``columns`` of ``words`` (the first is the word) once per key of its neighbourhood, or of its own reduced form."""
    ship_package(words.sparkSession)
    schema = words.select(*columns).schema.add("key", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for low, high in slices(list(map(len, texts)), BATCH_BYTES):
                reduced = ReducedWords(texts[low:high], symbols)
                for word, key in reduced.neighbourhood() if whole else reduced.own():
                    rows = batch.take(pa.array(word + low))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key)], names=[*columns, "key"])

    return words.select(*columns).mapInArrow(run, schema)


def near_pairs(words: DataFrame, symbols: int = FEWEST_SYMBOLS) -> DataFrame:
    """(word, near, near_n) of all words (word, n) that differ by one inserted, deleted or replaced letter, both ways round."""
    around = _keyed(words, ["word"], symbols, True)
    reduced = _keyed(words, ["word", "n"], symbols, False).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = around.join(reduced.hint("shuffle_hash"), "key").filter(F.levenshtein("word", "near", 1) == 1)
    # a pair may meet under several keys; dealt by word once, for this grouping and those to come
    return met.repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n); words are distinct."""
    words = checkpointed(words.select("word", "n"))
    size, least, most = words.agg(F.count("*"), F.min("n"), F.max("n")).first()
    symbols = max(FEWEST_SYMBOLS, size.bit_length() // BITS_PER_SYMBOL)
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    near = near_pairs(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.rank") >= 2 * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.rank") >= 2 * F.col("n"), -F.col("best.rank")).alias("form_n"),
    )
    found = checkpointed(found)
    steps = int(math.log2(most / least)) if size else 0
    ahead = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):  # each round doubles the steps taken
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = checkpointed(ahead.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return found.join(ahead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
