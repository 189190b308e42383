"""Counts of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie with failure links. A word is read once, byte by byte: where the trie has no way on, the longest
pieces that the read bytes must begin with are popped, and their number is all that is kept of them: it is known
beforehand for each node, as is the node that stands for the bytes left over. No piece is built or looked up.

Words are runs of bytes other than ASCII white space. A first piece carries a leading space, as in the public byte-level
vocabularies; a word that the vocabulary can't spell counts as one unknown piece.

Defined results: a null or empty text has no words; a null identifier keeps its row; repeated rows are counted each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, texts_of

#: Words whose count a worker remembers, and the longest such word.
CACHE_WORDS, CACHE_BYTES = 500_000, 64
#: Bytes of a text that are split into words at a time.
SLICE_BYTES = 4 << 20
ROOT, NONE = 0, -1

RESULT = "doc_id long, n_bytes long, n_words long, n_tokens long"


class Automaton(dict):
    """Maps a word (bytes) to its number of pieces; remembers short ones."""

    def __init__(self, vocabulary: Iterable[bytes], prefix: bytes = b" "):
        self.prefix = prefix
        self.step: dict[int, int] = {}
        piece, order = [False], [(ROOT, ROOT, 0)]
        for token in vocabulary:
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                child = self.step.get(key)
                if child is None:
                    child = self.step[key] = len(piece)
                    piece.append(False)
                    order.append((child, node, byte))
                node = child
            if node:
                piece[node] = True
        depth = [0] * len(piece)
        for child, parent, _ in order[1:]:  # parents come first
            depth[child] = depth[parent] + 1
        #: For each node: pieces popped when the trie ends there, and the node of the bytes left over.
        self.pops, self.fail = [0] * len(piece), [NONE] * len(piece)
        for node, parent, byte in sorted(order[1:], key=lambda x: depth[x[0]]):
            if piece[node]:
                self.pops[node], self.fail[node] = 1, ROOT
                continue
            at, n = self.fail[parent], self.pops[parent]
            while at != NONE and (at << 8 | byte) not in self.step:
                n += self.pops[at]
                at = self.fail[at]
            if at != NONE:
                self.pops[node], self.fail[node] = n, self.step[at << 8 | byte]

    def count(self, word: bytes) -> int:
        node, n, step, fail, pops = ROOT, 0, self.step, self.fail, self.pops
        for byte in self.prefix + word:
            while (child := step.get(node << 8 | byte)) is None:
                n += pops[node]
                node = fail[node]
                if node == NONE:
                    return 1
            node = child
        while node != ROOT:
            n += pops[node]
            node = fail[node]
            if node == NONE:
                return 1
        return n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self.count(word)
        if len(word) <= CACHE_BYTES:
            self[word] = n
        return n


@lru_cache(2)
def automaton(ranks_path: str) -> Automaton:
    with open(ranks_path, "rb") as lines:
        return Automaton(base64.b64decode(line.split()[0]) for line in lines if line.strip())


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words, in lists that end between words."""
    at = 0
    while at < len(raw):
        stop = at + SLICE_BYTES
        while stop < len(raw) and not raw[stop : stop + 1].isspace():
            stop += 1
        yield raw[at:stop].split()
        at = stop


def count_tokens(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of every text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = automaton(ranks_path).__getitem__
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1)):
                raw = text.as_py().encode()
                out[0, i] = len(raw)
                for words in words_of(raw):
                    out[1, i] += len(words)
                    out[2, i] += sum(map(pieces, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    return texts_of(docs, id_col, text_col).mapInArrow(lean(run), RESULT)
