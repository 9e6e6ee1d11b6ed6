"""SentencePiece encoding and decoding by Viterbi over shared prefixes.

Text is marked as the library does: one space is put before it and spaces become U+2581. Marked words (leading
marks and what follows up to the next mark, line feeds on their own) are encoded once per distinct word: the
distinct words are sorted, which lays them out as a trie in depth-first order, so each prefix shared with the word
before has one forward score; those of one depth are computed at once. A piece never reaches over a word's edge, so the best path of the
text is the chain of its words' best paths. Characters without a piece fall back to byte pieces.

Piece scores: a model of kind BPE only ranks its pieces, so the log-probability of a piece is taken from its rank
by Zipf's law, in whole millionths: sums are exact and equal scores are ties, which the longer last piece wins.

Defined results: null text -> null ids, 0 tokens; empty text -> no ids. Decoding the ids gives the text back to
the character, U+2581 in the text included (it falls back to bytes); null ids -> null text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from attestry.llm.common import map_texts

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# stands for U+2581 of the text itself: a lone surrogate, which no text from a table holds and no piece has
LITERAL_MARK = "\udc81"
WORDS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
# words that a task remembers before it forgets them all (about 30 MB); forgotten words are encoded again
MEMORY = 200_000


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, tuple[int, int]]  # piece -> (id, score)
    byte_ids: tuple[int, ...]
    outputs: tuple[bytes, ...]  # what an id decodes to; nothing for control pieces
    longest: int
    fallback: int  # score of a character without a piece


def load_vocabulary(path: str = MODEL_FILE) -> Vocabulary:
    """Reads the model on the driver; tasks get the bounded vocabulary, not the file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, byte_ids, outputs = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            outputs.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            outputs.append(b"")
        else:
            pieces[piece] = (i, -round(1e6 * math.log(len(pieces) + 2)))
            outputs.append(piece.replace(MARK, " ").encode())
    fallback = -round(1e6 * math.log(len(pieces) + 2)) - 10_000_000
    return Vocabulary(pieces, tuple(byte_ids), tuple(outputs), max(map(len, pieces)), fallback)


def marked_words(text: str) -> list[str]:
    """Words of the marked text; joined they are the whole marked text."""
    if not text:
        return []
    return WORDS.findall(MARK + text.replace(MARK, LITERAL_MARK).replace(" ", MARK))


def piece_tails(vocabulary: Vocabulary) -> dict[str, tuple[int, int] | None]:
    """Every ending of a piece: its id and score if it is a piece itself. No piece ends in what is not listed."""
    tails: dict[str, tuple[int, int] | None] = {piece[i:]: None for piece in vocabulary.pieces for i in range(1, len(piece))}
    return tails | vocabulary.pieces


class Endings:
    """All endings of pieces as a trie that is read backwards: edge i leads to node i + 1, edges are sorted by node and character."""

    def __init__(self, pieces: dict[str, tuple[int, int]]):
        sizes, backwards = np.array([*map(len, pieces)]), _characters(p[::-1] for p in pieces)
        starts, node = np.cumsum(sizes) - sizes, np.zeros(len(sizes), dtype=np.int64)
        levels, ends = [], []
        made = 0
        for depth in range(sizes.max()):
            deep = np.flatnonzero(sizes > depth)
            edges, place = np.unique(self._edges(node[deep], backwards[starts[deep] + depth]), return_inverse=True)
            node[deep] = made + 1 + place
            levels.append(edges)
            made += len(edges)
        self.edges = np.concatenate(levels)
        # id and score of the piece that ends in a node; -1 is no piece
        self.ids, self.scores = np.full(made + 1, -1, dtype=np.int32), np.zeros(made + 1, dtype=np.int64)
        self.ids[node], self.scores[node] = np.array([*pieces.values()]).T

    @staticmethod
    def _edges(nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        return nodes << 21 | characters

    def step(self, nodes: np.ndarray, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have an edge of the character, and the nodes those lead to."""
        wanted = self._edges(nodes, characters)
        edge = np.searchsorted(self.edges, wanted)
        edge[edge == len(self.edges)] = 0
        found = np.flatnonzero(self.edges[edge] == wanted)
        return found, edge[found] + 1


def _characters(words: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


class WordTrie:
    """The trie of sorted distinct words. Nodes are numbered level by level, within a level in the order of the words; 0 is the root."""

    def __init__(self, words: list[str]):
        sizes, characters = np.array([*map(len, words)]), _characters(words)
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(characters)) - starts[word]
        # a word shares with the one before what comes ahead of their first difference
        before = np.maximum(starts[word - 1] + place, 0)
        same = (word > 0) & (place < sizes[word - 1]) & (characters[np.minimum(before, len(characters) - 1)] == characters)
        fork = np.minimum.reduceat(np.where(same, sizes[word], place), starts)
        new = np.flatnonzero(place >= fork[word])
        depth, first = place[new], place[new] == fork[word[new]]
        by_level = np.argsort(depth, kind="stable")
        number = np.empty(len(new), dtype=np.int64)
        number[by_level] = np.arange(1, len(new) + 1)
        # the parent is the node just before, and where a word forks off the last node of the level above
        ordered = depth[by_level] * len(new) + by_level
        above = np.searchsorted(ordered, (depth - 1) * len(new) + np.arange(len(new)))
        parent = np.where(first, above, np.concatenate([[0], number[:-1]]))
        parent[depth == 0] = 0
        self.characters = np.concatenate([[0], characters[new[by_level]]])
        self.parent = np.concatenate([[0], parent[by_level]])
        self.levels = np.concatenate([[1], 1 + np.cumsum(np.bincount(depth))])
        # the last character of a word is never shared with the word before
        self.ends = number[np.searchsorted(new, starts + sizes - 1)]


class SharedPrefixViterbi:
    """Encodes distinct marked words and remembers their ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.endings = vocabulary, Endings(vocabulary.pieces)
        self._forget()

    def _forget(self) -> None:
        # words are numbered as they come; word k has the ids from the k-th bound to the next
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.bounds = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _learn(self) -> None:
        """Ids of the words numbered last: forward scores of all nodes of their trie, then the best paths back from the words' ends."""
        before = len(self.bounds) - 1
        words = sorted(islice(self.known, before, None))
        if not words:
            return
        trie = WordTrie(words)
        begin, token = self._best_steps(trie)
        at, rows = trie.ends, np.fromiter(map(self.known.__getitem__, words), dtype=np.int64) - before
        nodes, of = [], []
        while len(at):
            nodes.append(at)
            of.append(rows)
            at = begin[at]
            on = np.flatnonzero(at)
            at, rows = at[on], rows[on]
        nodes, of = np.concatenate(nodes[::-1]), np.concatenate(of[::-1])
        order = np.argsort(of, kind="stable")
        ids, sizes = self._spelt(token[nodes[order]], trie.characters[nodes[order]])
        ends = np.cumsum(np.bincount(of[order], sizes, len(words)).astype(np.int64))
        self.bounds = np.concatenate([self.bounds, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids])

    def _best_steps(self, trie: WordTrie) -> tuple[np.ndarray, np.ndarray]:
        """Per node where the last piece of its best path begins and that piece's id, -1 for a character without one."""
        end, size = np.arange(1, len(trie.parent)), self.vocabulary.longest + 1
        steps = [(end, trie.parent[1:], np.full(len(end), self.vocabulary.fallback), np.full(len(end), -1), np.zeros(len(end), int))]
        at, node = end, np.zeros(len(end), dtype=np.int64)
        for length in range(1, size):
            found, node = self.endings.step(node, trie.characters[at])
            end, at = end[found], trie.parent[at[found]]
            piece = np.flatnonzero(self.endings.ids[node] >= 0)
            ends_in = node[piece]
            steps.append((end[piece], at[piece], self.endings.scores[ends_in], self.endings.ids[ends_in], np.full(len(piece), length)))
            on = np.flatnonzero(at)
            end, at, node = end[on], at[on], node[on]
        end, begin, score, token, length = map(np.concatenate, zip(*steps, strict=True))
        order = np.argsort(end, kind="stable")
        begin, score, token, length = begin[order], score[order], token[order], length[order]
        # scores times ``size`` leave room for the length, so the longer last piece wins ties
        first = np.searchsorted(end[order], np.arange(1, len(trie.parent) + 1))
        best, value = np.zeros(len(trie.parent), dtype=np.int64), score * size + length
        for low, high in zip(trie.levels[:-1].tolist(), trie.levels[1:].tolist(), strict=True):
            start, stop = first[low - 1], first[high - 1]
            value[start:stop] += best[begin[start:stop]] * size
            best[low:high] = np.maximum.reduceat(value[start:stop], first[low - 1 : high - 1] - start) // size
        top = np.maximum.reduceat(value, first[:-1])
        chosen = np.flatnonzero(value == np.repeat(top, np.diff(first)))
        return np.concatenate([[0], begin[chosen]]), np.concatenate([[-1], token[chosen]])

    def _spelt(self, tokens: np.ndarray, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, with byte pieces for characters without one, and how many each token has."""
        lacking, sizes = np.flatnonzero(tokens < 0), np.ones(len(tokens), dtype=np.int64)
        kinds, kind = np.unique(characters[lacking], return_inverse=True)
        encoded = [(MARK if chr(c) == LITERAL_MARK else chr(c)).encode("utf-8") for c in kinds.tolist()]
        sizes[lacking] = np.array([*map(len, encoded)], dtype=np.int64)[kind]
        ids = np.repeat(tokens, sizes).astype(np.int32)
        in_bytes = np.frombuffer(b"".join(map(encoded.__getitem__, kind.tolist())), dtype=np.uint8)
        ids[ids < 0] = np.array(self.vocabulary.byte_ids, dtype=np.int32)[in_bytes]
        return ids, sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        words = [marked_words(t or "") for t in texts]
        if len(self.known) > MEMORY:
            self._forget()
        counts = np.cumsum([0, *map(len, words)])
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=counts[-1])
        self._learn()
        sizes = self.bounds[index + 1] - self.bounds[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.bounds[index] - ends[:-1], sizes) + np.arange(ends[-1])]
        of_texts = np.split(ids, ends[counts[1:-1]]) if texts else []
        return [None if text is None else found for text, found in zip(texts, of_texts, strict=True)]


def encode(docs: DataFrame, columns: list[str], vocabulary: Vocabulary, name: str = "ids", text: str = "text") -> DataFrame:
    """``columns`` of every row and an array column ``name`` of piece ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the model's pieces, whatever the input

    def compute():
        coder = SharedPrefixViterbi(shared.value)
        return lambda texts: [_lists(coder.encode(texts))]

    return map_texts(docs, columns, f"`{name}` array<int>", compute, text)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.cumsum([0] + [0 if r is None else len(r) for r in rows])
    values = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)])
    mask = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int32()), mask=mask)


def encode_and_decode(
    docs: DataFrame, columns: list[str], vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded", text: str = "text"
) -> DataFrame:
    """``columns`` of every row, the piece ids and the text they spell, in one pass and so one Python worker a task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the model's pieces, whatever the input

    def compute():
        coder, outputs = SharedPrefixViterbi(shared.value), pa.array(shared.value.outputs, pa.binary())

        def of_texts(texts):
            lists = _lists(coder.encode(texts))
            return [lists, decode_lists(lists, outputs)]

        return of_texts

    return map_texts(docs, columns, f"`{ids}` array<int>, `{decoded}` string", compute, text)


def decode_lists(lists: pa.ListArray, outputs: pa.Array) -> pa.Array:
    """The text of each list of ids, null for null."""
    parts = pa.ListArray.from_arrays(lists.offsets, outputs.take(lists.values), mask=lists.is_null())
    joined = pc.binary_join(parts, b"")
    spelt = pc.if_else(pc.starts_with(joined, b" "), pc.binary_replace_slice(joined, 0, 1, b""), joined)
    try:
        return spelt.cast(pa.string())
    except pa.ArrowInvalid:  # byte pieces that are no UTF-8
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in spelt.to_pylist()], pa.string())


def decode_ids(ids: Iterable[int], outputs: tuple[bytes, ...]) -> str:
    joined = b"".join(map(outputs.__getitem__, ids))
    return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def decode(rows: DataFrame, columns: list[str], vocabulary: Vocabulary, ids: str = "ids", name: str = "text") -> DataFrame:
    """``columns`` of every row and the text that the ids spell, as column ``name``."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    from pyspark.sql import types as T

    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField(name, T.StringType())])

    def run(batches):
        outputs = shared.value.outputs
        for batch in batches:
            lists = batch.column(len(columns))
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            there = lists.is_valid().to_pylist()
            texts = [decode_ids(values[a:b].tolist(), outputs) if t else None for t, a, b in zip(there, ends, ends[1:], strict=False)]
            kept = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*columns, name])

    return rows.select(*columns, rows[ids].alias("__ids")).mapInArrow(run, schema)
