"""Licence scan: passages of a text against licence templates by Dice coefficient over word bigrams.

Text and templates are normalised (lower case, words of letters and digits). A passage of A bigrams reaches
Dice ``least`` with a template of B bigrams only if A lies between least/(2-least) and (2-least)/least times B,
and if it shares at least least/(2-least) times B bigrams with it: these bounds prune templates and places before
anything is compared. For each place that is left, the passage end with the best coefficient is found; of
overlapping passages, of whatever templates, the one with the highest coefficient stays.

Defined results: null and empty texts match nothing; repeated rows are scanned one by one; of equal coefficients
the longer passage stays, then the first. Templates of fewer than two words match nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from attestry.llm.common import map_texts

LEAST = 0.8
WORD = re.compile(r"[^\W_]+")
FILTER_BITS = 20
MATCHES = "array<struct<licence:string,dice:double,first_token:int,end_token:int>>"


def bigram_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w.encode()) for w in WORD.findall((text or "").lower())], dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


class Templates:
    def __init__(self, texts: Mapping[str, str], least: float = LEAST):
        self.least = least
        made = {name: bigram_hashes(text) for name, text in texts.items()}
        self.bigrams = {name: Counter(b.tolist()) for name, b in made.items() if len(b)}
        self.sorted = {name: np.unique(made[name]) for name in self.bigrams}
        self.present = np.zeros(1 << FILTER_BITS, dtype=bool)
        for known in self.sorted.values():
            self.present[(known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        found = bigram_hashes(text)
        places = np.flatnonzero(self.present[(found >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        out = []
        for name, known in self.sorted.items() if len(places) else ():
            at = np.minimum(np.searchsorted(known, found[places]), len(known) - 1)
            out += self._passages(name, found, places[known[at] == found[places]])
        return _apart(out, len(found) + 1)

    def _passages(self, name: str, found: np.ndarray, hits: np.ndarray) -> list[tuple[str, float, int, int]]:
        wanted, total = self.bigrams[name], sum(self.bigrams[name].values())
        ratio = self.least / (2 - self.least)
        shortest, longest = total * ratio, int(total / ratio)
        # hits that a passage starting here can hold
        within = np.searchsorted(hits, hits + longest) - np.arange(len(hits))
        best = []
        for start in np.flatnonzero(within >= shortest).tolist():
            left, shared, top = dict(wanted), 0, None
            for k in range(start, start + int(within[start])):
                key = int(found[hits[k]])
                if left[key]:
                    left[key] -= 1
                    shared += 1
                    size = int(hits[k] - hits[start]) + 1
                    dice = 2 * shared / (size + total)
                    if size >= shortest and dice >= self.least and (top is None or dice > top[0]):
                        top = (dice, int(hits[start]), int(hits[k]) + 2)
            if top:
                best.append(top)
        return [(name, *b) for b in best]


def _apart(matches: list[tuple[str, float, int, int]], size: int) -> list[tuple[str, float, int, int]]:
    """Passages that do not overlap: the higher coefficient first, then the longer, then the earlier."""
    chosen, taken = [], np.zeros(size + 1, dtype=bool)
    for match in sorted(matches, key=lambda m: (-m[1], m[2] - m[3], m[2], m[0])):
        if not taken[match[2] : match[3]].any():
            taken[match[2] : match[3]] = True
            chosen.append(match)
    return sorted(chosen, key=lambda m: m[2])


def scan(docs: DataFrame, columns: list[str], texts: Mapping[str, str], least: float = LEAST, text: str = "text") -> DataFrame:
    """``columns`` of every row and ``licences``: the matched passages with their coefficient and token bounds."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(texts))  # the caller's templates

    def compute():
        templates = Templates(shared.value, least)
        kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first_token", pa.int32()), ("end_token", pa.int32())]))
        keys = [f.name for f in kind.value_type]
        return lambda texts: [pa.array([[dict(zip(keys, m, strict=True)) for m in templates.matches(t)] for t in texts], kind)]

    return map_texts(docs, columns, f"licences {MATCHES}", compute, text)
