"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

*Terms.* A text's bytes fall into sixteen classes (lower case, upper case, digits, kinds of punctuation, ...); runs of one
class collapse, and the terms are the trigrams of what is left. Further terms say how many words repeat the word
before, occur again, or stand on repeated lines, and how long the text is. Nothing else is looked at: no labels, language,
source or identifier.
*Weights.* Square roots of relative frequencies times inverse document frequencies; these are counted over all
documents, in one pass that sends a vector of fixed length for each task.
*Space.* A truncated singular value decomposition of a bounded sample of labelled texts (``max_labelled`` rows with the
smallest hashes of their identifiers) gives ``dimensions`` axes. Their labelled vectors, of a size fixed by the two
parameters, are broadcast.
*Vote.* Every document is projected and compared with all labelled vectors in blocks of exact cosine products; its
``neighbours`` most similar ones vote with weights that fall with their distance from the closest.

Defined results: a null or empty text has the term of its length only, and a score like any other; without labelled rows, or
without any positive similarity, the score is the share of label 1 (one half if there are no labels); labels
that are null are no labels, several labels of an identifier are averaged; a null identifier counts as the
text "null" for the fold; repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, texts_of

MAX_LABELLED, DIMENSIONS, NEIGHBOURS = 4_096, 48, 25
#: How fast a neighbour's weight falls as its cosine falls behind the best one.
SHARPNESS = 20.0
#: Bytes and texts whose terms are counted at a time.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 256
CLASSES = 16
TRIGRAMS = CLASSES**3
#: After the trigrams: repeats of the word before, words seen before, lines seen before; then one for each length in powers of two.
EXTRA, LENGTHS = 3, 40
TERMS = TRIGRAMS + EXTRA + LENGTHS
#: Of a term's share of a text's squared weight.
EXTRA_WEIGHT, LENGTH_WEIGHT = 1.5, 0.05


def _classes() -> np.ndarray:
    named = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",", "!", "?", "|", "'\"-", "$%&*#", "()[]{}<>", "@:/\\_;=+~^`"]
    out = np.full(256, 14, np.uint8)  # controls
    out[128:] = 15
    for k, chars in enumerate(named):
        out[np.frombuffer(chars.encode(), np.uint8)] = k
    return out


CLASS_OF = _classes()


def counted(texts: list[bytes]) -> np.ndarray:
    """Term frequencies, relative to the text, one row for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    kinds = CLASS_OF[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    new = np.ones(len(kinds), bool)
    new[1:] = (kinds[1:] != kinds[:-1]) | (owner[1:] != owner[:-1])
    kinds, owner = kinds[new], owner[new]
    if len(kinds) > 2:
        whole = owner[2:] == owner[:-2]
        codes = ((kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:])[whole] + owner[2:][whole] * TRIGRAMS
        n = np.bincount(codes, minlength=len(texts) * TRIGRAMS).reshape(-1, TRIGRAMS)
        out[:, :TRIGRAMS] = n / np.maximum(1, n.sum(1, keepdims=True))
    for row, text, size in zip(out, texts, sizes.tolist(), strict=True):
        words, lines = text.split(), text.split(b"\n")
        n = max(1, len(words))
        row[TRIGRAMS] = sum(map(eq, words, words[1:])) / n
        row[TRIGRAMS + 1] = 1 - len(set(words)) / n if words else 0
        row[TRIGRAMS + 2] = 1 - len(set(lines)) / len(lines)
        row[TRIGRAMS + EXTRA + min(LENGTHS - 1, size.bit_length())] = 1
    return out


def blocks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    total = 0
    for text in texts:
        if held and (total + len(text) > BLOCK_BYTES or len(held) >= BLOCK_TEXTS):
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


@dataclass
class Model:
    """Of fixed size: TERMS x (dimensions + 1) and max_labelled x (dimensions + 1) numbers."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def weigh(self, frequencies: np.ndarray) -> np.ndarray:
        return weighted(frequencies, self.idf)

    def score(self, texts: Iterable[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for block in blocks(texts):
            near = unit(self.weigh(counted(block)) @ self.axes) @ self.vectors.T
            out.append(self._vote(near))
        return np.concatenate(out)

    def _vote(self, near: np.ndarray) -> np.ndarray:
        k = min(self.neighbours, near.shape[1])
        if not k:
            return np.full(len(near), self.prior)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        cos = np.take_along_axis(near, top, 1).astype(np.float64)
        best = cos.max(1, keepdims=True)
        weights = np.where(cos > 0, np.exp(SHARPNESS * (cos - best)), 0)
        total = weights.sum(1)
        return np.where(total > 0, (weights * self.labels[top]).sum(1) / np.maximum(total, 1e-300), self.prior)


def weighted(frequencies: np.ndarray, idf: np.ndarray) -> np.ndarray:
    scale = np.ones(TERMS, np.float32)
    scale[TRIGRAMS : TRIGRAMS + EXTRA] = EXTRA_WEIGHT
    scale[TRIGRAMS + EXTRA :] = LENGTH_WEIGHT
    scale[:TRIGRAMS] = idf[:TRIGRAMS]
    return np.sqrt(frequencies) * scale


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def axes_of(rows: np.ndarray, dimensions: int, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    k = min(dimensions + 8, *rows.shape) if rows.size else 0
    if not k:
        return np.zeros((rows.shape[1], 0), np.float32)
    basis = np.random.default_rng(seed).standard_normal((rows.shape[1], k)).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :dimensions], dtype=np.float32)


def held_out(doc_id: Column) -> Column:
    """The fold that labels are not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 3 == 1


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """(TERMS + 1): documents that have each term, and all documents. One vector for each task comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for block in blocks(t.as_py().encode() for t in batch.column(1)):
                total[:TERMS] += (counted(block) > 0).sum(0)
                total[TERMS] += len(block)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    out = np.zeros(TERMS + 1)
    for term, n in texts.mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    texts = texts_of(docs, id_col, text_col)
    counts = document_frequencies(texts)
    idf = np.log((1 + counts[TERMS]) / (1 + counts[:TERMS])).astype(np.float32) + 1
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label].cast("double").alias("label")).where(~held_out(F.col("doc_id"))).dropna()
    sample = marks.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("label", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weighted(counted(block), idf) for block in blocks(t.as_py().encode() for t in batch.column(1))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.astype("<f2").tobytes() for b in found for r in b], pa.binary())], names=["label", "row"])

    got = rows.mapInArrow(lean(vectors), "label double, row binary").orderBy(F.xxhash64("row", "label")).toArrow()
    marks_of = got.column(0).to_numpy()
    matrix = np.frombuffer(b"".join(got.column(1).to_pylist()), "<f2").reshape(-1, TERMS).astype(np.float32)
    axes = axes_of(matrix, dimensions)
    return Model(idf, axes, unit(matrix @ axes), marks_of, neighbours, float(marks_of.mean()) if len(marks_of) else 0.5)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(t.as_py().encode() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = texts_of(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` less those with a score below one half; all columns stay."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score((t.as_py() or "").encode() for t in batch.column(at))
            yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
