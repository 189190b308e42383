"""Benchmark decontamination by an FM-index for each shard of the training texts.

Documents of one task, SHARD_BYTES at a time, are a shard. Its words become integers: those of the test phrases a number each, all others
a separator, since no phrase holds them; runs too short to hold the shortest phrase are left out. An FM-index over the
shard answers all phrases at once by backward search through wavelet-matrix ranks; occurrences are located from sampled
suffix positions and merged into removal spans. Documents are never shuffled.

Phrases are broadcast. Their size is measured first: beyond ``block_bytes`` they are searched in blocks of about
that size, one after the other, each against all documents; what a block finds is written before the next is made, and the spans of all
blocks are merged. A block takes about a hundred times its text in the driver's memory, seventeen times it in a worker's.

Defined results: a null or empty text has no words; a null or empty item has no phrases; an item of fewer words than the
window is one phrase; a null identifier keeps its row, a null item_id counts as the empty string; repeated rows are
judged each; either table may be empty; other columns are ignored by ``find`` and kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, packed, texts_of, written
from .fm_index import FMIndex

WINDOW = 10
#: Of item texts that are broadcast at a time.
BLOCK_BYTES = 1 << 20
#: Of the texts of a shard.
SHARD_BYTES = 8 << 20
#: Of a text that is cut into words at a time.
SLICE_BYTES = 4 << 20
#: Bytes that are not part of words become spaces, A to Z lower case.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

FOUND = "rid long, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of ``text``, from slices cut between words."""
    at = 0
    while at < len(text):
        part = text[at : at + SLICE_BYTES].translate(WORD_BYTES)
        if at + SLICE_BYTES < len(text):
            while (stop := part.rfind(b" ") + 1) == 0:
                more = text[at + len(part) : at + 2 * len(part)].translate(WORD_BYTES)
                part += more
                if not more:
                    stop = len(part)
                    break
            part = part[:stop]
        at += len(part)
        yield part.split()


def places_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``text`` start and stop, in bytes."""
    word = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


class Phrases:
    """Windows of the items' words, each once, and whose they are."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for part in words_of(text.encode()) for w in part]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(number[name])
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.phrases = np.zeros((len(owners), window), np.int32)
        for row, phrase in zip(self.phrases, owners, strict=True):
            row[window - len(phrase) :] = phrase
        self.owners = [np.array(sorted(o), np.int64) for o in owners.values()]

    def scan(self, texts: Iterable[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: number of words, merged spans of hit words, items with occurrences; shard by shard."""
        results, shard, size = [], [], 0
        for text in texts:
            shard.append(text)
            size += len(text)
            if size >= SHARD_BYTES:
                results += self._scan(shard)
                shard, size = [], 0
        return results + self._scan(shard)

    def _scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        get, parts, counts = self.vocabulary.get, [], []
        for text in texts:
            n = 0
            for words in words_of(text):
                parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
                n += len(words)
            parts.append(np.zeros(1, np.int32))  # no match crosses documents
            counts.append(n)
        results: list[tuple[int, list[tuple[int, int]], list[str]]] = [(n, [], []) for n in counts]
        if not len(self.phrases) or not parts:
            return results
        ids = np.concatenate(parts)
        begins = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
        # Runs of known words at least as long as the shortest phrase, one separator after each.
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids != 0).view(np.int8), [0]])))
        first, stop = edges[::2], edges[1::2]
        long = stop - first >= self.shortest
        first, sizes = first[long], (stop - first)[long] + 1
        if not len(first):
            return results
        places = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        index = FMIndex(ids[places], len(self.vocabulary))
        low, high = index.search(self.phrases, self.lengths)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = places[index.locate(rows)]
        cover = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + self.lengths[which], minlength=len(ids) + 1)
        hit = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8), [0]])))
        for a, b in zip(hit[::2].tolist(), hit[1::2].tolist(), strict=True):
            doc = int(np.searchsorted(begins, a, "right")) - 1
            results[doc][1].append((a - int(begins[doc]), b - int(begins[doc])))
        docs = np.searchsorted(begins, at, "right") - 1
        pairs = np.unique(docs * np.int64(len(n)) + which)
        for doc in np.unique(docs).tolist():
            windows = pairs[np.searchsorted(pairs, doc * len(n)) : np.searchsorted(pairs, (doc + 1) * len(n))] % len(n)
            results[doc][2].extend(self.names[i] for i in np.unique(np.concatenate([self.owners[w] for w in windows.tolist()])).tolist())
        return results


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _found(batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
    spans = pa.array([[{"start": a, "stop": b} for a, b in r[1]] for r in results], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in results], pa.int64()), spans, pa.array([r[2] for r in results], pa.list_(pa.string()))], names=["rid", "doc_id", "n_words", "spans", "items"])


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item_id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text"))


def _blocks(items: DataFrame, block_bytes: int, window: int) -> tuple[int, Iterator[Phrases]]:
    """The number of blocks of about ``block_bytes`` of item texts, and their phrases; each is small enough to be broadcast."""
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    parts = (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) for block in range(n))
    return n, (Phrases([tuple(r) for r in part.collect()], window) for part in parts)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts_of(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text")


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: rid, doc_id, n_words, spans of hit words (merged, by word number), items."""
    return _find(_keyed(docs, id_col, text_col), benchmark, window, block_bytes, item_col, item_text_col)


def _find(keyed: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, item_col: str, item_text_col: str) -> DataFrame:
    context = keyed.sparkSession.sparkContext

    def search(shared: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _found(batch, shared.value.scan(t.as_py().encode() for t in batch.column(2)))

        return keyed.mapInArrow(lean(scan), FOUND)

    n, blocks = _blocks(_items(benchmark, item_col, item_text_col), block_bytes, window)
    if n == 1:
        return search(context.broadcast(next(blocks)))
    keyed, every = written(keyed, "keyed"), None  # each block reads the same numbers of rows
    for phrases in blocks:
        shared = context.broadcast(phrases)
        found = written(search(shared), "found")
        shared.destroy()
        every = found if every is None else every.unionByName(found)
    grouped = every.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [(n, _merge([(s["start"], s["stop"]) for s in spans]), items) for n, spans, items in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield _found(batch, results)

    return grouped.mapInArrow(lean(merge), FOUND)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the words of ``spans`` and what lies between them."""
    raw = text.encode()
    starts, stops = places_of(raw)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(stops[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the hit words cut out of the texts; texts without hits stay as they are, null included.

    One pass without shuffles if the phrases are one block; else the spans of all blocks meet the texts in a join.
    """
    names = docs.columns
    at = names.index(text_col)

    def emit(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts = [without(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    items = _items(benchmark, "item_id", "text")
    n, blocks = _blocks(items, block_bytes, window)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(blocks))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield emit(batch, [r[1] for r in shared.value.scan((t.as_py() or "").encode() for t in batch.column(at))])

        return docs.mapInArrow(lean(cut), docs.schema)

    keyed = written(packed(docs, rid=F.monotonically_increasing_id()), "keyed")
    found = _find(keyed.select("rid", F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")).alias("text")), benchmark, window, block_bytes, "item_id", "text")
    spans = written(found.where(F.size("spans") > 0).select("rid", "spans"), "spans")

    def cut_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield emit(batch, [[(x["start"], x["stop"]) for x in s or ()] for s in batch.column(len(names)).to_pylist()])

    joined = keyed.join(spans, "rid", "left").select("row", "spans")
    # Spans come last, under a name that no other column has.
    last = "spans" + "_" * max(map(len, names))
    return joined.select("row.*", F.col("spans").alias(last)).mapInArrow(lean(cut_joined), docs.schema)
