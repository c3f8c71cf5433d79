"""Token counts by greedy longest match, in linear time and without building tokens.

The vocabulary's pieces form a trie of bytes. Each node has a failure link and the number of
tokens that taking the link emits: if the text cannot go on from a node, the node's bytes are
cut greedily into that many tokens, and what remains of them leads to the node the link names.
So a word's number of tokens is a sum over the links taken, each byte moves the automaton at
most once forward, and no token is ever compared or stored.

A word is matched from `first` nodes for its first token (pieces that begin a word) and from
`rest` nodes afterwards (pieces that continue one). Words that cannot be cut count as one
unknown token. Counts of words seen before come from a bounded cache in the task.

The vocabulary is a byte-pair vocabulary whose pieces with a leading space begin a word; its
file is a parameter and is read on the driver. It is shipped as pieces, and the automaton is
built once per worker.

Defined results: a null or empty text has no words and no tokens; rows that repeat a doc_id are
counted one by one; a word of any length is one word; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CACHE = 1 << 18


class Automaton:
    """Longest-match automaton over `first` and `rest` pieces (bytes)."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}, {}]
        self.is_piece = [False, False]
        #: Nodes 0 and 1 are the roots of pieces that begin and that continue a word.
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    nxt = self.children[node].get(byte)
                    if nxt is None:
                        nxt = len(self.children)
                        self.children.append({})
                        self.is_piece.append(False)
                        self.children[node][byte] = nxt
                    node = nxt
                if node > 1:
                    self.is_piece[node] = True
        self._link()

    def _link(self) -> None:
        """Failure links and tokens emitted by taking them, breadth first; -1 where nothing can be cut off."""
        self.link = [-1] * len(self.children)
        self.popped = [0] * len(self.children)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for byte, child in self.children[node].items():
                    below.append(child)
                    if self.is_piece[child]:
                        self.link[child], self.popped[child] = 1, 1
                        continue
                    # The longest piece on the way is cut off; the bytes behind it are matched anew.
                    at, tokens = self.link[node], self.popped[node]
                    while at >= 0 and byte not in self.children[at]:
                        at, tokens = self.link[at], tokens + self.popped[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.children[at][byte], tokens
            level = below

    def count(self, word: bytes) -> int | None:
        """Number of tokens of one word, or None if it cannot be cut."""
        children, link, popped = self.children, self.link, self.popped
        node, tokens = 0, 0
        for byte in word:
            nxt = children[node].get(byte)
            while nxt is None:
                tokens += popped[node]
                node = link[node]
                if node < 0:
                    return None
                nxt = children[node].get(byte)
            node = nxt
        while node > 1:
            tokens += popped[node]
            node = link[node]
        return tokens if node >= 0 else None


class Counter(dict):
    """Tokens of a word, unknown words as one; forgets everything when CACHE words are held."""

    def __init__(self, automaton: Automaton, prefix: bytes = b" "):
        super().__init__()
        self.automaton, self.prefix = automaton, prefix

    def __missing__(self, word: bytes) -> int:
        count = self.automaton.count(self.prefix + word)
        count = 1 if count is None else count
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = count
        return count


def pieces_of_ranks(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word (they carry the leading space) and pieces that continue one, of a ranks file."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    first = [p for p in pieces if p.startswith(b" ")]
    rest = [p for p in pieces if not p[:1].isspace()]
    return first, rest


@lru_cache(maxsize=2)
def _automaton(first: tuple[bytes, ...], rest: tuple[bytes, ...]) -> Automaton:
    return Automaton(first, rest)


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes) of every document; `vocabulary` is the path of a ranks file."""
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(map(tuple, pieces_of_ranks(vocabulary))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(_automaton(*shipped.value))
        for batch in batches:
            n = batch.num_rows
            words, tokens, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            column = batch.column(1)
            for i in range(n):
                value = column[i].as_py()
                if value:
                    raw = value.encode()
                    found = raw.split()  # at U+0020, U+0009 to U+000D
                    words[i], size[i] = len(found), len(raw)
                    tokens[i] = sum(map(counter.__getitem__, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(tokens), pa.array(size)],
                names=["doc_id", "n_words", "n_tokens", "n_bytes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_bytes bigint"
    )
