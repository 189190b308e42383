"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Chunks are pre-tokenised on their own, in parallel and on
any executor, and their pieces encoded. Neighbours are stitched at the first position of the overlap
where both see a pre-token boundary: the pattern looks ahead only, so from a shared boundary on both
cut alike. Where an overlap has no such position (one pre-token fills it), pre-tokenising goes on from
the last sure boundary until it meets one of a later chunk.

Defined results: a null or empty text has no tokens; a null identifier keeps its row; repeated rows are
encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, texts_of

#: Characters of a chunk's own, and those it shares with the next one.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 1_024
#: A boundary this close to the end of a chunk may depend on what follows (contractions look three characters ahead).
LOOKAHEAD = 8
#: Pre-tokens remembered by a worker.
CACHE_PIECES = 120_000

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec(dict):
    """Maps a pre-token to its ids as little-endian 32-bit bytes; remembers what it has encoded."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pieces = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = np.asarray(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [self[piece] for piece in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(start, characters, last) of each chunk; each but the last reaches ``overlap`` characters into the next."""
    start = 0
    while True:
        last = start + chunk + overlap >= len(text)
        yield start, text[start : len(text) if last else start + chunk + overlap], last
        if last:
            return
        start += chunk


def pre_tokenise(code: Codec, text: str) -> tuple[np.ndarray, list[bytes]]:
    """Where the pieces of ``text`` end, and the ids of each."""
    pieces = code.pieces(text)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    return ends, code.encode_pieces(pieces)


class Stitcher:
    """Takes the chunks of one text in order and gives the ids of its pieces in order."""

    def __init__(self, code: Codec):
        self.code = code
        self.sure = 0  #: the boundary up to which ids are out
        self.held: tuple[int, str, np.ndarray, list[bytes]] | None = None

    def add(self, start: int, chars: str, ends: np.ndarray, ids: list[bytes], last: bool) -> Iterator[bytes]:
        """``ends``: where the chunk's pieces end, counted from its start; ``ids``: of each piece."""
        if self.held is not None:
            own, text, own_ends, _ = self.held
            mine = np.concatenate([[0], own_ends]) + own
            mine = mine[(mine <= own + len(text) - LOOKAHEAD) & (mine >= self.sure)]
            shared = np.intersect1d(mine[mine >= start], np.concatenate([[0], ends]) + start)
            if len(shared):
                yield self._flush(int(shared[0]))
            else:  # go on from the last sure boundary, over what is left of both texts
                if len(mine):
                    yield self._flush(int(mine[-1]))
                chars = text[self.sure - own :] + chars[own + len(text) - start :]
                start = self.sure
                ends, ids = pre_tokenise(self.code, chars)
        self.held = (start, chars, ends, ids)
        if last:
            yield self._flush(start + len(chars))

    def _flush(self, upto: int) -> bytes:
        start, _, ends, ids = self.held
        first, stop = np.searchsorted(ends, [self.sure - start, upto - start], "right")
        self.sure = upto
        return b"".join(ids[first:stop])


class _Digest:
    """Counts and hashes the ids of one text as they come, and the bytes they decode to."""

    def __init__(self, code: Codec):
        self.code, self.n, self.ids, self.raw = code, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: bytes) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.raw.update(self.code.decode(ids))

    def row(self, doc_id: int | None) -> tuple:
        return doc_id, self.n, self.ids.hexdigest(), self.raw.hexdigest()


def _results(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, n, a, b), kinds, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per text: number of tokens, digest of its ids, digest of the bytes they decode to.

    Texts of one chunk are done where they lie. Chunks of longer ones are dealt out one by one, so that one huge
    text keeps many executors busy; the ids then meet by text, sorted, and are stitched and hashed as a stream.
    """
    texts = texts_of(docs, id_col, text_col)
    most = chunk + overlap
    short, long = texts.where(F.octet_length("text") <= most), texts.where(F.octet_length("text") > most)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks_path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stitch, digest = Stitcher(code), _Digest(code)
                text = text.as_py()
                for ids in stitch.add(0, text, *pre_tokenise(code, text), True):
                    digest.add(ids)
                rows.append(digest.row(doc_id))
            yield _results(rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                start, chars, last = zip(*cut(text.as_py(), chunk, overlap), strict=True)
                n = len(start)
                yield pa.RecordBatch.from_arrays([pa.array([rid.as_py()] * n, pa.int64()), pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(start, pa.int64()), pa.array(last), pa.array(chars, pa.string())], names=["rid", "doc_id", "start", "last", "chars"])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks_path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ends, ids = pre_tokenise(code, row.column(4)[0].as_py())
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                extra = [pa.array([x], pa.binary()) for x in (ends.astype("<u4").tobytes(), (sizes // 4).astype("<u4").tobytes(), b"".join(ids))]
                yield pa.RecordBatch.from_arrays([*row.columns, *extra], names=["rid", "doc_id", "start", "last", "chars", "ends", "sizes", "ids"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks_path, pattern)
        join = digest = None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                _, doc_id, start, last, chars, ends, sizes, ids = (c[i].as_py() for c in batch.columns)
                if join is None:
                    join, digest = Stitcher(code), _Digest(code)
                at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64) * 4)]).tolist()
                pieces = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
                for done in join.add(start, chars, np.frombuffer(ends, "<u4").astype(np.int64), pieces, last):
                    digest.add(done)
                if last:
                    rows.append(digest.row(doc_id))
                    join = digest = None
            yield _results(rows)

    chunks = long.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text").mapInArrow(lean(deal), "rid long, doc_id long, start long, last boolean, chars string")
    encoded = chunks.repartition(F.col("rid"), F.col("start")).mapInArrow(lean(encode_chunks), "rid long, doc_id long, start long, last boolean, chars string, ends binary, sizes binary, ids binary")
    stitched = encoded.repartition("rid").sortWithinPartitions("rid", "start").mapInArrow(lean(stitch), RESULT)
    return short.mapInArrow(lean(whole), RESULT).unionByName(stitched)


def encode_text(text: str | None, ranks_path: str, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of one text, by the same chunks and stitches."""
    code = codec(ranks_path, pattern)
    join = Stitcher(code)
    ids = b"".join(done for start, chars, last in cut(text or "", chunk, overlap) for done in join.add(start, chars, *pre_tokenise(code, chars), last))
    return np.frombuffer(ids, "<u4").tolist()
