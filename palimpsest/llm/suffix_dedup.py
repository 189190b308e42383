"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller document, or earlier in
the same. Every window of ``length`` bytes has an anchor, the gram of GRAM bytes with the smallest hash in it; equal windows
have equal anchors at equal places. Consecutive windows with one anchor are handled together.

1. *Blocks.* Texts are written once as compressed blocks; longer ones in pieces that share ``length - 1`` bytes.
2. *Duplicate detection.* Each block sends its anchors' hashes; those that occur once in the corpus can't be part of
   a repeat and are out. (Hash collisions let through too much, never too little.)
3. *Runs.* Each block sorts the suffixes at its remaining anchors, keeps the earliest of equal entries and marks the
   others, and sends the sorted runs front-coded: length of the prefix shared with the suffix before, and the rest.
4. *Merge.* The runs of one range of hashes meet and are merged by a loser tree that keeps, for each candidate, the
   prefix it is known to share with the last winner: longer known prefixes win without a look at the strings, and only
   from there on are bytes compared. The merge yields the prefixes shared by neighbours.
5. *Marks.* Windows of equal bytes are those in one stretch of shared prefixes to the right of the anchor that
   also agree to its left; all but the earliest are marked. Marks return to their blocks, which cut the bytes.

An anchor with more than ``hot`` different surroundings (a short line of a third of all documents, say) would put them all into one
merge. Its windows are sent one by one instead, each to the range of its own bytes' hash; equal ones are still combined by block
first. Nothing is dropped. The bound is the same at all sizes, and each range has a task of its own.

Everything is compared byte by byte in the end; hashes only decide what meets where.

Defined results: a null text counts as empty; a null identifier is smaller than any other; repeated rows, and rows that
share an identifier, are documents of their own in an arbitrary but fixed order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, texts_of, written

LENGTH, GRAM = 100, 32
#: Bytes of text in a block, and of a long text in a piece.
BLOCK_BYTES = 4 << 20
#: Bytes of text for each range of hashes.
RANGE_BYTES = 32 << 20
#: Different surroundings of an anchor above which its windows go their own ways.
HOT = 1_500
#: Merged suffixes that are marked at a time; more if one stretch of equal grams is longer.
BATCH = 150_000
FIRST = -(1 << 63)  #: stands for a null identifier

BLOCK = "block long, split boolean, data binary, doc_ids array<long>, rids array<long>, offsets array<long>, sizes array<long>, lasts array<boolean>"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


# --- blocks ---


def _blocks(length: int, block_bytes: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(pieces: list[tuple], split: bool) -> pa.RecordBatch:
            doc_ids, rids, offsets, lasts, raws = zip(*pieces, strict=True)
            return _batch(BLOCK, [(uuid.uuid4().int >> 65, split, _squeeze(b"".join(raws)), doc_ids, rids, offsets, [len(r) for r in raws], lasts)])

        for batch in batches:
            for rid, doc_id, text in zip(*batch.columns, strict=True):
                rid, doc_id, raw = rid.as_py(), doc_id.as_py(), text.as_py().encode()
                if len(raw) > block_bytes + length:
                    for start in range(0, len(raw), block_bytes):
                        yield flush([(doc_id, rid, start, start + block_bytes >= len(raw), raw[start : start + block_bytes + length - 1])], True)
                    continue
                held.append((doc_id, rid, 0, True, raw))
                size += len(raw)
                if size >= block_bytes:
                    yield flush(held, False)
                    held, size = [], 0
        if held:
            yield flush(held, False)

    return make


# --- anchors ---


MIX = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Windows whose anchors are chosen at a time: their arrays stay in a core's cache.
TILE = 16_384


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Of the ``gram`` (a power of two) bytes at each place, by doubling."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * MIX[0]
    h ^= h >> np.uint64(32)
    step = 1
    while step < gram:
        k = step.bit_length()
        ahead = h[step:] * MIX[2 * k + 1]
        h = h[: len(h) - step] * MIX[2 * k]
        h += ahead
        h ^= h >> np.uint64(29)
        step *= 2
    h *= MIX[63]
    return h


def _chosen(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, its hash) of the window at each place of ``raw``: the leftmost of the smallest hashes' upper halves."""
    n = len(raw) - length + 1
    at, hashes = np.empty(n, np.int64), np.empty(n, np.uint64)
    width = length - gram + 1
    for start in range(0, n, TILE):
        stop = min(n, start + TILE)
        own = gram_hashes(raw[start : stop + length - 1], gram)
        low = own & np.uint64(0xFFFFFFFF00000000)
        low |= np.arange(len(own), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: span - width], low[width - span :])
        low &= np.uint64(0xFFFFFFFF)
        place = low.view(np.int64)
        np.take(own, place, out=hashes[start:stop])
        np.add(place, start, out=at[start:stop])
    return at, hashes


def anchors(raw: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, anchor's hash) of stretches of windows with one anchor; none crosses a text."""
    n = len(raw) - length + 1
    ends, long = np.cumsum(sizes), sizes >= length
    if not long.any():
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    at, hashes = _chosen(raw, length, gram)
    begins, stops = (ends - sizes)[long], (ends - length + 1)[long]
    inside = np.zeros(n + 1, np.int8)
    inside[begins] += 1
    inside[stops] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[begins] = True
    first = np.flatnonzero(new & inside)
    over = np.empty(n, bool)
    over[-1] = True
    over[:-1] = new[1:]
    over[stops - 1] = True
    last = np.flatnonzero(over & inside)
    return first, last, at[first], hashes[first]


class Pieces:
    """A block's bytes and texts."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.raw = _expand(row["data"])
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc_ids = np.array([FIRST if d is None else d for d in row["doc_ids"]], np.int64)
        self.rids, self.offsets = np.array(row["rids"], np.int64), np.array(row["offsets"], np.int64)

    def anchors(self, length: int, gram: int) -> tuple[np.ndarray, ...]:
        return anchors(np.frombuffer(self.raw, np.uint8), self.sizes, length, gram)

    def owner(self, at: np.ndarray) -> np.ndarray:
        # Empty texts share their start with the next one, which is the owner.
        return np.searchsorted(self.starts, at, "right") - 1


def _slots(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` ranges a key that hash partitioning into ``n`` puts into a partition of its own."""
    keys = spark.range(24 * n).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part"))
    found = dict(map(tuple, keys.groupBy("part").agg(F.min("key")).toLocalIterator()))
    return [found.get(p, 24 * n + p) for p in range(n)]  # one in e^24 has none and shares a partition


def _ranges(values: np.ndarray, n: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """Order by range of hashes, and (range, from, to) in it."""
    part = (values % np.uint64(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]])
    return order, ((int(part[order[a]]), int(a), int(b)) for a, b in pairwise(edges) if b > a)


# --- duplicate detection ---

PRINTS = "part int, block long, prints binary, several binary"
CODES = "block long, part int, codes binary"


def _prints(slots: Broadcast, length: int, gram: int):
    n_parts = len(slots.value)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pieces = Pieces(row)
                first, last, _, hashes = pieces.anchors(length, gram)
                values, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
                # Different surroundings within the block, of those that occur more than once in it.
                kinds = np.ones(len(values), np.int64)
                again = np.flatnonzero(n[inverse] > 1)
                seen: dict[int, set[bytes]] = {}
                for i in again.tolist():
                    seen.setdefault(int(inverse[i]), set()).add(pieces.raw[first[i] : last[i] + length])
                for k, texts in seen.items():
                    kinds[k] = len(texts)
                several = np.where(n > 1, kinds + 1, 1).astype("<u4")  # 1: once; else one more than the surroundings
                order, parts = _ranges(values, n_parts)
                prints = (values >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                yield _batch(PRINTS, [(slots.value[p], pieces.block, prints[order[a:b]].tobytes(), _squeeze(several[order[a:b]].tobytes())) for p, a, b in parts])

    return send


def _codes(hot: int):
    """0: occurs once; 1: more often; 2: in too many surroundings for one merge."""

    def count(table: pa.Table) -> pa.Table:
        sizes, prints, several = [], [], []
        for p, s in zip(table["prints"].to_pylist(), table["several"].to_pylist(), strict=True):
            five = np.frombuffer(p, np.uint8).reshape(-1, 5)
            wide = np.zeros((len(five), 8), np.uint8)
            wide[:, :5] = five
            prints.append(wide.view("<u8").ravel())
            several.append(np.frombuffer(_expand(s), "<u4").astype(np.int64))
            sizes.append(len(five))
        marks = np.concatenate(several)
        _, inverse = np.unique(np.concatenate(prints), return_inverse=True)
        occurs = np.bincount(inverse, np.where(marks > 1, 2, 1))[inverse]
        around = np.bincount(inverse, np.maximum(1, marks - 1))[inverse]
        codes = np.where(occurs < 2, 0, np.where(around > hot, 2, 1)).astype(np.uint8)
        at = np.cumsum([0, *sizes])
        return pa.Table.from_batches([_batch(CODES, [(b, p, _squeeze(codes[i:j].tobytes())) for b, p, i, j in zip(table["block"].to_pylist(), table["part"].to_pylist(), at, at[1:], strict=False)])])

    return count


# --- runs ---

RUNS = "part int, block long, run binary"
_RUN_ARRAYS = (("lcp", "<u2"), ("tail", "<u2"), ("left", "<u2"), ("least", "<u2"), ("doc_id", "<i8"), ("rid", "<i8"), ("at", "<i8"), ("place", "<i8"))


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes already."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


class Run:
    """Sorted suffixes of one block: to the right of the anchor, and what stands to its left.

    ``least``: how far before the anchor the last window starts. ``place``: of the anchor in the block. (doc_id, rid, at):
    where the anchor stands in the corpus, which tells what is earlier.
    """

    def __init__(self, rights: list[bytes], lefts: list[bytes], lcp: np.ndarray, **arrays: np.ndarray):
        self.rights, self.lefts, self.lcp, self.arrays = rights, lefts, lcp, arrays

    def pack(self) -> bytes:
        """Front-coded."""
        tails = [r[n:] for r, n in zip(self.rights, self.lcp.tolist(), strict=True)]
        values = self.arrays | {"lcp": self.lcp, "tail": np.array([len(t) for t in tails]), "left": np.array([len(x) for x in self.lefts])}
        head = b"".join(np.asarray(values[name]).astype(kind).tobytes() for name, kind in _RUN_ARRAYS)
        return _squeeze(len(tails).to_bytes(4, "little") + head + b"".join(tails) + b"".join(self.lefts))

    @classmethod
    def unpack(cls, data: bytes) -> Run:
        data = _expand(data)
        n, at, values = int.from_bytes(data[:4], "little"), 4, {}
        for name, kind in _RUN_ARRAYS:
            values[name] = np.frombuffer(data, kind, n, at).astype(np.int64)
            at += n * np.dtype(kind).itemsize
        rights, last = [], b""
        for shared, size in zip(values["lcp"].tolist(), values["tail"].tolist(), strict=True):
            last = last[:shared] + data[at : at + size]
            rights.append(last)
            at += size
        lefts = []
        for size in values["left"].tolist():
            lefts.append(data[at : at + size])
            at += size
        return cls(rights, lefts, values["lcp"], **{k: values[k] for k in ("least", "doc_id", "rid", "at", "place")})


def _intervals(block: int, first: np.ndarray, last: np.ndarray) -> bytes:
    return _squeeze(np.concatenate([first, last]).astype("<i8").tobytes())


def _entries(pieces: Pieces, codes: np.ndarray, length: int, gram: int, n_parts: int) -> tuple[list[tuple[int, Run]], np.ndarray, np.ndarray]:
    """(range, run) of a block's repeated anchors; first and last windows that an earlier entry of the block repeats."""
    first, last, anchor, hashes = pieces.anchors(length, gram)
    values, inverse = np.unique(hashes, return_inverse=True)
    order, parts = _ranges(values, n_parts)
    kind = np.zeros(len(values), np.uint8)
    kind[order] = codes
    kind = kind[inverse]
    part_of = (hashes % np.uint64(n_parts)).astype(np.int64)
    some = kind == 1
    first, last, anchor, part, hot = first[some], last[some], anchor[some], part_of[some], (first[kind == 2], last[kind == 2])
    if len(hot[0]):  # each window by itself, anchored at its start, in the range of its own hash
        n = hot[1] - hot[0] + 1
        windows = np.repeat(hot[0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        grams = gram_hashes(np.frombuffer(pieces.raw, np.uint8), gram)
        own = np.zeros(len(windows), np.uint64)
        for shift in [*range(0, length - gram, gram), length - gram]:
            own = (own ^ (own >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + grams[windows + shift]
        first, last, anchor = (np.concatenate([x, windows]) for x in (first, last, anchor))
        part = np.concatenate([part, ((own ^ (own >> np.uint64(33))) % np.uint64(n_parts)).astype(np.int64)])
    owner = pieces.owner(anchor)
    doc_id, rid, at = pieces.doc_ids[owner], pieces.rids[owner], pieces.offsets[owner] + anchor - pieces.starts[owner]
    age = np.empty(len(anchor), np.int64)
    age[np.lexsort((at, rid, doc_id))] = np.arange(len(anchor))
    raw = pieces.raw
    rights = [raw[q : b + length] for q, b in zip(anchor.tolist(), last.tolist(), strict=True)]
    lefts = [raw[a:q] for a, q in zip(first.tolist(), anchor.tolist(), strict=True)]
    kept: dict[tuple[bytes, bytes], int] = {}
    marked = []
    for i in np.argsort(age).tolist():
        if kept.setdefault((rights[i], lefts[i]), i) != i:
            marked.append(i)
    by_part: dict[int, list[int]] = {}
    for i in sorted(kept.values(), key=rights.__getitem__):
        by_part.setdefault(int(part[i]), []).append(i)
    runs = []
    for p, members in by_part.items():
        own = [rights[i] for i in members]
        lcp = np.array([0, *(shared_prefix(a, b, 0) for a, b in pairwise(own))], np.int64)
        which = np.array(members)
        runs.append((p, Run(own, [lefts[i] for i in members], lcp, least=(anchor - last)[which], doc_id=doc_id[which], rid=rid[which], at=at[which], place=anchor[which])))
    return runs, first[marked], last[marked]


def _runs(slots: Broadcast, length: int, gram: int):
    n_parts = len(slots.value)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {slot: p for p, slot in enumerate(slots.value)}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pieces = Pieces(row)
                codes = b"".join(_expand(c["codes"]) for c in sorted(row["codes"] or (), key=lambda c: place[c["part"]]))
                runs, first, last = _entries(pieces, np.frombuffer(codes, np.uint8), length, gram, n_parts)
                rows = [(slots.value[p], pieces.block, run.pack()) for p, run in runs]
                if len(first):  # marks pass the merge by, spread like the ranges
                    rows.append((-1 - pieces.block % n_parts, pieces.block, _intervals(pieces.block, first, last)))
                yield _batch(RUNS, rows)

    return send


# --- merge ---


def merge_runs(runs: list[list[bytes]], lcps: list[list[int]]) -> tuple[list[int], list[int]]:
    """(run of each, prefix shared with the one before) in sorted order; each run is sorted, with its own prefixes."""
    k = 1
    while k < len(runs):
        k *= 2
    ends = [len(r) for r in runs] + [0] * (k - len(runs))
    at = [0] * k
    current = [r[0] if r else b"" for r in runs] + [b""] * (k - len(runs))
    # A candidate's known prefix; -1 once its run has ended, which loses to any other.
    known = [0 if n else -1 for n in ends]
    loser, out_run, out_lcp = [0] * k, [], []

    def play(a: int, b: int) -> int:
        """The winner of two runs; the loser's known prefix becomes what it shares with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return a if x > y else b
        if x < 0:
            return a
        s, t = current[a], current[b]
        n = shared_prefix(s, t, x)
        if s[n:] <= t[n:]:
            known[b] = n
            return a
        known[a] = n
        return b

    winners = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node] = w = play(a, b)
        loser[node] = b if w == a else a
    w = winners[1] if k > 1 else 0
    for _ in range(sum(ends)):
        out_run.append(w)
        out_lcp.append(known[w])
        at[w] += 1
        i = at[w]
        if i < ends[w]:
            current[w] = runs[w][i]
            known[w] = lcps[w][i]
        else:
            known[w] = -1
        node = (w + k) >> 1
        while node:
            other = loser[node]
            x, y = known[w], known[other]
            if x < y or (x == y and x >= 0 and play(w, other) == other):
                loser[node], w = w, other
            node >>= 1
    return out_run, out_lcp


def repeats(lcp: np.ndarray, lefts: list[bytes], least: np.ndarray, age: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, int]]:
    """(entries, how far before their anchors) of windows that an older entry has too; entries are in sorted order."""
    n = len(lefts)
    sizes = np.array([len(x) for x in lefts], np.int64)
    width = max(1, int(sizes.max(initial=0)))
    table = np.zeros((n, width), np.uint8)
    for row, left in zip(table, lefts, strict=True):
        row[: len(left)] = np.frombuffer(left, np.uint8)[::-1]
    order = np.argsort(sizes, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(table[order]).view(f"S{width}").ravel(), kind="stable")]
    sorted_rows = table[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    agree = np.where(differ.any(1), differ.argmax(1), width)
    agree = np.minimum(agree, np.minimum(sizes[order][1:], sizes[order][:-1]))
    oldest = np.argsort(age, kind="stable")
    for back in range(length - gram + 1):
        right = np.cumsum(np.concatenate([[True], lcp[1:] < length - back]))
        fits = (least <= back) & (back <= sizes)
        n_right = np.bincount(right, fits, n + 1)
        use = oldest[(fits & (n_right[right] > 1))[oldest]]
        if not len(use):
            continue
        left = np.empty(n, np.int64)
        left[order] = np.cumsum(np.concatenate([[True], agree < back]))
        key = right[use] * np.int64(n + 1) + left[use]
        by = np.argsort(key, kind="stable")
        again = by[1:][key[by][1:] == key[by][:-1]]
        if len(again):
            yield use[again], back


def _stretches(source: np.ndarray, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(source, first, last) of the stretches of windows of each source; one sort, however many sources there are."""
    order = np.lexsort((windows, source))
    source, windows = source[order], windows[order]
    for a, b in pairwise(np.concatenate([np.flatnonzero(np.diff(source, prepend=-1)), [len(source)]]).tolist()):
        own = np.unique(windows[a:b])
        new = np.flatnonzero(np.diff(own) != 1)
        yield int(source[a]), own[np.concatenate([[0], new + 1])], own[np.concatenate([new, [len(own) - 1]])]


MARKS = "block long, marks binary"


def _merge(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        blocks, packed = table["block"].to_pylist(), table["run"].to_pylist()
        if not blocks or table["part"][0].as_py() < 0:
            return pa.Table.from_batches([_batch(MARKS, list(zip(blocks, packed, strict=True)))])
        runs = [Run.unpack(p) for p in packed]
        which, lcp = merge_runs([r.rights for r in runs], [r.lcp.tolist() for r in runs])
        which, lcp = np.array(which, np.int64), np.array(lcp, np.int64)
        # Merging takes each run in its own order.
        base = np.cumsum([0, *(len(r.rights) for r in runs)])
        order = np.empty(len(which), np.int64)
        by = np.argsort(which, kind="stable")
        order[by] = np.arange(len(which))
        columns = {k: np.concatenate([r.arrays[k] for r in runs])[order] for k in runs[0].arrays}
        lefts = [left for r in runs for left in r.lefts]
        source = np.repeat(np.arange(len(runs)), np.diff(base))[order]
        sources, windows_of = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        cuts = np.concatenate([np.flatnonzero(lcp < gram), [len(lcp)]])
        start = 0
        while start < len(lcp):  # batches end where a stretch of equal grams ends
            stop = int(cuts[min(np.searchsorted(cuts, start + BATCH), len(cuts) - 1)])
            part = slice(start, stop)
            near = np.maximum(np.concatenate([[0], lcp[start + 1 : stop]]), np.concatenate([lcp[start + 1 : stop], [0]])) >= gram
            some = np.flatnonzero(near)
            if len(some):
                age = np.empty(len(some), np.int64)
                age[np.lexsort(tuple(columns[k][part][some] for k in ("at", "rid", "doc_id")))] = np.arange(len(some))
                shared = np.concatenate([[0], lcp[start + 1 : stop]])[some]  # those left out share less than a gram with any
                for entries, back in repeats(shared, [lefts[i] for i in order[part][some]], columns["least"][part][some], age, length, gram):
                    rows = some[entries] + start
                    sources.append(source[rows].astype(np.int32))
                    windows_of.append(columns["place"][rows] - back)
            start = stop
        out = [(blocks[s], _intervals(blocks[s], first, last)) for s, first, last in _stretches(np.concatenate(sources), np.concatenate(windows_of))]
        return pa.Table.from_batches([_batch(MARKS, out)])

    return run


# --- cutting ---


def removed(marks: list[bytes], pieces: Pieces, length: int) -> list[list[tuple[int, int]]]:
    """For each piece the merged spans of bytes to remove, counted from its start."""
    out: list[list[tuple[int, int]]] = [[] for _ in pieces.sizes]
    if not marks:
        return out
    pairs = np.concatenate([np.frombuffer(_expand(m), "<i8").reshape(2, -1) for m in marks], axis=1)
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    owner = pieces.owner(pairs[0]).tolist()
    for j, a, b in zip(owner, pairs[0].tolist(), (pairs[1] + length).tolist(), strict=True):
        a, b = a - int(pieces.starts[j]), b - int(pieces.starts[j])
        spans = out[j]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return out


class _Cut:
    """Hashes what is left of one text, given piece by piece with spans in the text's own bytes."""

    def __init__(self):
        self.kept, self.n, self.removed, self.spans, self.until = hashlib.sha256(), 0, 0, 0, -1

    def add(self, raw: bytes, start: int, spans: list[tuple[int, int]], stop: int) -> None:
        """``raw``: the bytes from ``start``; those before ``stop`` are this piece's own."""
        at = start
        for a, b in spans:
            if a > self.until:
                self.spans += 1
            a, b = max(a, self.until, at), max(b, self.until)
            self._keep(raw, start, max(at, min(self.until, stop)), min(a, stop))
            self.until, at = b, max(at, min(b, stop))
        self._keep(raw, start, max(at, min(self.until, stop)), stop)
        self.n += stop - start

    def _keep(self, raw: bytes, start: int, a: int, b: int) -> None:
        if b > a:
            self.kept.update(raw[a - start : b - start])
            self.removed -= b - a

    def row(self, doc_id: int | None) -> tuple:
        return doc_id, self.n, self.n + self.removed, self.spans, self.kept.hexdigest()


def _cut_whole(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pieces, rows = Pieces(row), []
                for doc_id, start, size, spans in zip(row["doc_ids"], pieces.starts.tolist(), row["sizes"], removed(row["marks"] or [], pieces, length), strict=True):
                    done = _Cut()
                    done.add(pieces.raw[start : start + size], 0, spans, size)
                    rows.append(done.row(doc_id))
                yield _batch(RESULT, rows)

    return cut


SPLIT = "rid long, doc_id long, start long, last boolean, data binary, spans binary"


def _spread(length: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                spans = np.array(removed(row["marks"] or [], Pieces(row), length)[0], "<i8").reshape(-1, 2) + row["offsets"][0]
                yield _batch(SPLIT, [(row["rids"][0], row["doc_ids"][0], row["offsets"][0], row["lasts"][0], row["data"], _squeeze(spans.astype("<i8").tobytes()))])

    return spread


def _cut_split(block_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                done, raw, start = done or _Cut(), _expand(row["data"]), row["start"]
                spans = np.frombuffer(_expand(row["spans"]), "<i8").reshape(-1, 2).tolist()
                done.add(raw, start, spans, start + (len(raw) if row["last"] else block_bytes))
                if row["last"]:
                    yield _batch(RESULT, [done.row(row["doc_id"])])
                    done = None

    return cut


def cut_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    if gram & (gram - 1) or not gram <= length < 1 << 15:
        raise ValueError("gram has to be a power of two and no longer than length, length below 32768")
    texts = texts_of(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text")
    blocks = written(texts.mapInArrow(lean(_blocks(length, block_bytes)), BLOCK), "blocks")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0]
    n_parts = 1 + int((total or 0) // range_bytes)
    spark = docs.sparkSession
    slots = spark.sparkContext.broadcast(_slots(spark, n_parts))

    prints = blocks.mapInArrow(lean(_prints(slots, length, gram)), PRINTS).repartition(n_parts, "part")
    codes = written(prints.groupBy("part").applyInArrow(_codes(hot), CODES), "codes")
    coded = blocks.join(codes.groupBy("block").agg(F.collect_list(F.struct("part", "codes")).alias("codes")), "block", "left")

    runs = coded.mapInArrow(lean(_runs(slots, length, gram)), RUNS).repartition(n_parts, "part")
    marks = written(runs.groupBy("part").applyInArrow(_merge(length, gram), MARKS), "marks")
    marked = blocks.join(marks.groupBy("block").agg(F.collect_list("marks").alias("marks")), "block", "left")

    whole = marked.where("NOT split").mapInArrow(lean(_cut_whole(length)), RESULT)
    pieces = marked.where("split").mapInArrow(lean(_spread(length)), SPLIT)
    return whole.unionByName(pieces.repartition("rid").sortWithinPartitions("rid", "start").mapInArrow(lean(_cut_split(block_bytes)), RESULT))
