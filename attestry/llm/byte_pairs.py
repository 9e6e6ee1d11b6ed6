"""Byte-level BPE encoding and decoding in batched merge rounds.

Text is cut into the file's special tokens and pre-tokens; each distinct pre-token of a batch is encoded once. The bytes
of all new pre-tokens lie in one flat array of symbols. A round merges, in every pre-token, all places of its
lowest-ranked pair; the ranks of pairs are found by binary search over the sorted pair keys, and only pairs next to a
merge are looked up again. Finished pre-tokens leave the array.

A pre-token of many symbols is looked at in blocks: a pair is merged when no pair of its block or of the two beside it
ranks lower. A block has as many symbols as the longest token has bytes, so what lies further away cannot grow into
the pair before its turn. The rounds of a very long pre-token thus do not grow with its length.

Letters, digits and white space are those of the library that reads the file: it is asked once, on the driver.

Defined results: null text -> null ids and null decoded text; empty text -> no ids. The strings of special tokens in a
text become their ids. Decoding gives the text back to the character; ids that the vocabulary lacks decode to nothing,
broken UTF-8 to U+FFFD. Repeated rows are encoded each for itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attestry.llm.common import map_texts

# pre-tokens per generation that a task remembers, twice; forgotten ones are encoded again
MEMORY = 150_000
NO_RANK = np.int64(1 << 40)
CODE_POINTS = 0x110000


@dataclass(frozen=True)
class Model:
    first: np.ndarray  # symbol of each byte
    pair_keys: np.ndarray  # sorted left * size + right
    pair_ranks: np.ndarray  # rank of each key
    merged: np.ndarray  # rank -> symbol of the merged pair
    size: int
    outputs: dict[int, bytes]  # what an id decodes to
    specials: dict[str, int]
    patterns: tuple[tuple[int, str], ...]  # (code points covered, pattern of pre-tokens)
    longest: int  # bytes of the longest token


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else the next one above 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache
def letter_classes(path: str) -> dict[str, np.ndarray]:
    """Code points that the library's pre-tokenizer takes for letters, digits and white space.

    Unicode versions differ in their newest letters, so every code point that a newer version counts to a class is probed:
    it belongs if the library does not cut between it and the letter, digit or sign before it.
    """
    import regex
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(chr(c) for c in range(CODE_POINTS) if not 0xD800 <= c < 0xE000)

    def members(pattern: str, probe: str, is_cut: bool) -> np.ndarray:
        found = regex.findall(pattern, every)
        starts = np.array([span[0] for _, span in cut("".join([probe + c for c in found]))])
        cuts = np.isin(np.arange(len(found)) * (len(probe) + 1) + len(probe), starts)
        return np.array(list(map(ord, found)))[cuts == is_cut]

    return {"letter": members(r"\p{L}", "!a", False), "digit": members(r"\p{N}", "!1", False), "space": members(r"\s", "a!", True)}


def _class(codes: np.ndarray, end: int) -> str:
    codes = codes[codes < end]
    starts = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
    ends = np.append(starts[1:], len(codes)) - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[starts].tolist(), codes[ends].tolist(), strict=True))


def pre_token_pattern(classes: dict[str, np.ndarray], end: int) -> str:
    """Pattern of pre-tokens for texts below code point ``end``; shorter classes are searched faster."""
    letter, digit, space = (_class(classes[k], end) for k in ("letter", "digit", "space"))
    return (
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


def load_model(path: str | None = None) -> Model:
    """Reads the tokenizer file on the driver; tasks get the bounded model, not the file."""
    if path is None:
        from public_tokenizers import path as file_of

        path = file_of("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    vocabulary, letters = stored["model"]["vocab"], byte_letters()
    byte_of = {letter: b for b, letter in enumerate(letters)}
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in stored["model"]["merges"]]
    size = max(vocabulary.values()) + 1
    keys = np.array([vocabulary[a] * size + vocabulary[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    outputs = {i: bytes(map(byte_of.__getitem__, token)) for token, i in vocabulary.items()}
    longest = max(map(len, outputs.values()))
    specials = {t["content"]: t["id"] for t in stored["added_tokens"]}
    odd = [t for t in stored["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
    if odd or stored["normalizer"] or stored["pre_tokenizer"]["type"] != "ByteLevel" or stored["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is no plain byte-level model")
    classes = letter_classes(path)
    return Model(
        np.array([vocabulary[c] for c in letters], np.int64), keys[order], order.astype(np.int64),
        np.array([vocabulary[a + b] for a, b in pairs], np.int64), size,
        outputs | {i: text.encode() for text, i in specials.items()}, specials,
        tuple((end, pre_token_pattern(classes, end)) for end in (0x80, 0x10000, CODE_POINTS)), longest,
    )


class MergeRounds:
    """Encodes pre-tokens given as bytes."""

    def __init__(self, model: Model):
        self.model = model

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pairs that begin at the positions ``at``; pairs do not reach over a pre-token's end."""
        model, ranks = self.model, np.full(len(at), NO_RANK)
        inside = np.flatnonzero(at + 1 < len(ids))
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        if not len(model.pair_keys) or not len(inside):
            return ranks
        here = at[inside]
        keys = ids[here] * model.size + ids[here + 1]
        found = np.minimum(np.searchsorted(model.pair_keys, keys), len(model.pair_keys) - 1)
        hit = model.pair_keys[found] == keys
        ranks[inside[hit]] = model.pair_ranks[found[hit]]
        return ranks

    def _lowest(self, ranks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per position the lowest rank in its block and the two beside it, within the pre-token."""
        block = max(self.model.longest, 1)
        if lengths.max() <= block:
            return np.repeat(np.minimum.reduceat(ranks, starts), lengths)
        blocks = -(-lengths // block)
        owner = np.repeat(np.arange(len(starts)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begins = starts[owner] + within * block
        low = np.minimum.reduceat(ranks, begins)
        reach, beside = low.copy(), np.flatnonzero(owner[1:] == owner[:-1])
        reach[beside] = np.minimum(low[beside], low[beside + 1])
        reach[beside + 1] = np.minimum(reach[beside + 1], low[beside])
        return np.repeat(reach, np.diff(begins, append=len(ranks)))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as int32 bytes."""
        model = self.model
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = model.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        ranks = self._ranks(ids, word, np.arange(len(ids)))
        over_ids, over_words = [ids[:0]], [word[:0]]
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lengths = np.diff(starts, append=len(word))
            ended = np.repeat(np.minimum.reduceat(ranks, starts) == NO_RANK, lengths)
            if ended.any():
                over_ids.append(ids[ended])
                over_words.append(word[ended])
                ids, word, ranks = ids[~ended], word[~ended], ranks[~ended]
                continue
            chosen = np.flatnonzero((ranks == self._lowest(ranks, starts, lengths)) & (ranks < NO_RANK))
            # neighbours of one rank are places of a pair of equal symbols: from the left, every other one
            begins = np.diff(chosen, prepend=-2) != 1
            place = np.arange(len(chosen)) - np.maximum.accumulate(np.where(begins, np.arange(len(chosen)), 0))
            chosen = chosen[place % 2 == 0]
            ids[chosen] = model.merged[ranks[chosen]]
            stays = np.ones(len(ids), bool)
            stays[chosen + 1] = False
            ids, word, ranks = ids[stays], word[stays], ranks[stays]
            moved = chosen - np.arange(len(chosen))
            again = np.concatenate([moved, moved[moved > 0] - 1])
            ranks[again] = self._ranks(ids, word, again)
        over_words = np.concatenate(over_words)
        order = np.argsort(over_words, kind="stable")
        packed = np.concatenate(over_ids)[order].astype(np.int32).tobytes()
        ends = (np.cumsum(np.bincount(over_words, minlength=len(words))) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Coder:
    """Encodes texts; keeps the ids of pre-tokens it has met."""

    def __init__(self, model: Model):
        self.model, self.rounds = model, MergeRounds(model)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.patterns = [(chr(end - 1), re.compile(text)) for end, text in model.patterns]
        self.special = {text: np.int32(i).tobytes() for text, i in model.specials.items()}
        longest_first = sorted(map(re.escape, model.specials), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest_first)})").split if longest_first else lambda text: [text]

    def pre_tokens(self, text: str) -> list[str]:
        """Special tokens and pre-tokens; joined they are the text."""
        if not text:
            return []
        top = max(text)
        findall = next(p.findall for last, p in self.patterns if top <= last)
        found = []
        for i, part in enumerate(self.cut(text)):
            found += [part] if i % 2 else findall(part)
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        words = [self.pre_tokens(t or "") for t in texts]
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        new = set().union(*words) - self.known.keys()
        met = new & self.older.keys()
        self.known.update(zip(met, map(self.older.__getitem__, met), strict=True))
        fresh = [w for w in new - met if w not in self.special]
        self.known.update(zip(fresh, self.rounds.encode([w.encode() for w in fresh]), strict=True))
        self.known.update(self.special)
        get = self.known.__getitem__
        return [
            None if text is None else np.frombuffer(b"".join(map(get, parts)), np.int32)
            for text, parts in zip(texts, words, strict=True)
        ]

    def decode(self, ids: Iterable[int]) -> str:
        get = self.model.outputs.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.cumsum([0] + [0 if r is None else len(r) for r in rows])
    values = np.concatenate([np.zeros(0, np.int32), *[r for r in rows if r is not None]])
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int32()), mask=missing)


def encode_and_decode(
    docs: DataFrame, columns: list[str], model: Model, ids: str = "ids", decoded: str = "decoded", text: str = "text"
) -> DataFrame:
    """``columns`` of every row, the ids of its text and the text they spell."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the file's tokens, whatever the input

    def compute():
        coder = Coder(shared.value)

        def of_texts(texts):
            rows = coder.encode(texts)
            return [_lists(rows), pa.array([None if r is None else coder.decode(r.tolist()) for r in rows], pa.string())]

        return of_texts

    return map_texts(docs, columns, f"`{ids}` array<int>, `{decoded}` string", compute, text)
