"""Token counts by dynamic programming over a trie of pre-tokens.

Each task keeps a trie of the distinct pre-tokens it has met. A node stands for one prefix and holds its forward
score under the unigram model and the number of tokens of that best path, computed once however many pre-tokens
share the prefix; the node a pre-token ends in holds its count. The count of a text
is the sum over its pre-tokens. The model, its scores and the cut into pre-tokens are those of the encoder.

Defined results: null and empty texts have 0 tokens and 0 pre-tokens; repeated rows are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attestry.llm.common import map_texts
from attestry.llm.pieces import LITERAL_MARK, MARK, Vocabulary, marked_words, piece_tails

# nodes a task keeps (about 150 MB); a full trie is dropped and grown again, which changes no count
TRIE_NODES = 700_000


class CountingTrie:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.tails = vocabulary, piece_tails(vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0], [0]
        self.counts: dict[str, int] = {}

    def insert(self, word: str) -> None:
        """Adds a pre-token; only the nodes behind the known prefix are computed."""
        node, path, child = 0, [0], self.child
        for char in word:
            node = child.get((node, char))
            if node is None:
                break
            path.append(node)
        known = len(path) - 1
        score, tokens = self.score, self.tokens
        fallback, tail = self.vocabulary.fallback, self.tails.get
        for end in range(known + 1, len(word) + 1):
            char, up = word[end - 1], path[end - 1]
            # a character by its bytes, unless a piece does better; longer pieces later, so they win ties
            top, count = score[up] + fallback, 0
            for start in range(end - 1, -1, -1):
                found = tail(word[start:end], 0)
                if found:
                    if score[path[start]] + found[1] >= top:
                        top, count = score[path[start]] + found[1], tokens[path[start]] + 1
                elif found == 0:
                    break
            if not count:
                count = tokens[up] + len((MARK if char == LITERAL_MARK else char).encode("utf-8"))
            child[up, char] = len(score)
            path.append(len(score))
            score.append(top)
            tokens.append(count)
        self.counts[word] = self.tokens[path[-1]]

    def learn(self, words: Iterable[str]) -> None:
        for word in words:
            self.insert(word)

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and pre-tokens per text."""
        parts = [marked_words(t or "") for t in texts]
        if len(self.score) > TRIE_NODES:
            self._clear()
        self.learn(set().union(*parts) - self.counts.keys())
        get = self.counts.__getitem__
        return np.array([sum(map(get, p)) for p in parts], np.int64), np.array([len(p) for p in parts], np.int64)


def token_counts(docs: DataFrame, columns: list[str], vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``columns`` of every row with ``n_tokens`` and ``n_pretokens``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the model's pieces, whatever the input

    def compute():
        trie = CountingTrie(shared.value)
        return lambda texts: [pa.array(x, pa.int64()) for x in trie.count(texts)]

    return map_texts(docs, columns, "n_tokens long, n_pretokens long", compute, text)
