"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits, padded to 69, are three words of 23 bits. The anchors are the triples of codewords of
the binary Golay code, whose balls of radius 3 cover all words of 23 bits exactly once. Each fingerprint has one
home, its nearest anchor; it is replicated to every anchor that may be the home of a fingerprint within the
threshold: those within 3 + t1, 3 + t2 and 3 + t3 bits of its words, t1 + t2 + t3 being the threshold. Which they
are depends on the three syndromes only. Homes and replicas meet by anchor and are compared exactly.

Equal fingerprints are one node throughout, so copies cost nothing; a fingerprint has at most 2080 others
within two bits, however many rows there are. Links are joined into components by rounds of written tables.

``similar_groups`` links texts by the Jaccard similarity of their shingle sets, for which no few bits are enough: at a
similarity of 0.8 a seventh of all bits differ. No code covers such a distance with a bearable number of anchors, so the
anchors are all points of many words of bits drawn from a wider fingerprint. Their length follows the number of texts, so
that about GROUP share an anchor by chance; their number is such that all but MISS of the pairs at the
threshold share one. What shares an anchor is compared by all bits; texts that are joined by steps of at most FAR bits are a
cluster, of which each anchor sends a spanning forest and not all pairs. In a cluster the sets themselves are compared, each sent there
once, and only a forest of the links leaves it. Anchors of more than HOT texts, and clusters of more than HOT_SHINGLES, are dealt
out as pairs of blocks, so that no task's share grows with its group.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other;
a null identifier keeps its row and is never a component's identifier unless all of its members lack one;
repeated rows are members each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bits_for, discard, lean, marked, texts_of, written
from .components import components

#: The Golay code's generator polynomial, its word length and covering radius.
GENERATOR, WORD, RADIUS = 0xAE3, 23, 3
#: Hashes whose bits are counted at a time.
BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the hashes of the word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(text.as_py(), shingle, seed) for text in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(lean(compute), "doc_id long, fp long")


@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndromes of all words; for each syndrome the top bits of its only pattern of at most RADIUS bits; and for one
    and two bits more the first place, number and list of what other anchors' top bits differ by."""
    check = WORD - 12
    single = np.empty(WORD, np.int64)
    for bit in range(WORD):
        rest = 1 << bit
        for at in range(WORD - 1, check - 1, -1):
            if rest >> at & 1:
                rest ^= GENERATOR << (at - check)
        single[bit] = rest
    syndrome = np.zeros(1, np.int64)
    for bit in range(WORD):
        syndrome = np.concatenate([syndrome, syndrome ^ single[bit]])

    def patterns(weight: int) -> np.ndarray:
        places = np.array(list(combinations(range(WORD), weight)), np.int64)
        return (np.int64(1) << places).sum(1)

    near = np.concatenate([patterns(w) for w in range(RADIUS + 1)])
    leader = np.zeros(1 << check, np.int64)
    leader[syndrome[near]] = near >> check
    others = []
    for extra in (1, 2):
        far = np.concatenate([patterns(RADIUS + t) for t in range(1, extra + 1)])
        far = far[np.argsort(syndrome[far], kind="stable")]
        n = np.bincount(syndrome[far], minlength=1 << check)
        others.append((np.cumsum(n) - n, n, (far >> check) ^ leader[syndrome[far]]))
    return syndrome, leader, others


def _words(fps: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << WORD) - 1)
    return [((fps >> np.uint64(WORD * i)) & mask).astype(np.int64) for i in range(3)]


def homes(fps: np.ndarray) -> np.ndarray:
    """The nearest anchor of each fingerprint (unsigned), as an integer of 36 bits."""
    syndrome, leader, _ = _code()
    out = np.zeros(len(fps), np.int64)
    for i, word in enumerate(_words(fps)):
        out |= ((word >> 11) ^ leader[syndrome[word]]) << (12 * i)
    return out


def replicas(fps: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``fps``, anchor) for every anchor within radius plus ``threshold``, the home included."""
    syndrome, _, others = _code()
    classes, home = [syndrome[w] for w in _words(fps)], homes(fps)

    def widen(at: np.ndarray, anchors: np.ndarray, i: int, extra: int) -> tuple[np.ndarray, np.ndarray]:
        first, n, flips = others[extra - 1]
        s = classes[i][at]
        which = np.repeat(np.arange(len(at)), n[s])
        k = np.arange(len(which)) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
        return at[which], anchors[which] ^ (flips[first[s][which] + k] << (12 * i))

    every = np.arange(len(fps))
    out = [(every, home)]
    if threshold >= 1:
        out += [widen(every, home, i, min(threshold, 2)) for i in range(3)]
    if threshold >= 2:
        out += [widen(*widen(every, home, i, 1), j, 1) for i, j in combinations(range(3), 2)]
    at, anchors = (np.concatenate(x) for x in zip(*out, strict=True))
    return at, anchors


def links(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """(u, v) with u < v: distinct fingerprints of ``nodes`` (fp) that differ in at most ``threshold`` (0 to 2) bits."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds of 0, 1 and 2 bits")

    def unsigned(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    def to_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(homes(unsigned(batch)), pa.int64()), batch.column(0)], names=["anchor", "u"])

    def to_replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                fps = unsigned(batch.slice(start, 2_000))
                at, anchors = replicas(fps, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(fps.view(np.int64)[at], pa.int64())], names=["anchor", "v"])

    left = nodes.select("fp").mapInArrow(lean(to_homes), "anchor long, u long")
    right = nodes.select("fp").mapInArrow(lean(to_replicas), "anchor long, v long")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold
    return right.join(left, "anchor").where((F.col("u") < F.col("v")) & near).select("u", "v")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, threshold: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest identifier reachable)."""
    prints = written(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(written(links(nodes, threshold), "links"))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# --- by the similarity of shingle sets ---

#: Bits of the wide fingerprint, and those in which neighbours in a cluster may differ: at a similarity of 0.8 one pair in some thousands has more,
#: and of pairs of unrelated texts one in 10^17 has no more.
WIDE, FAR = 256, 58
#: Columns of the wide fingerprint.
QUARTERS = ["a", "b", "c", "d"]
#: Texts that share an anchor by chance, about; share of the pairs at the threshold that may have no anchor in common.
GROUP, MISS = 64, 0.01
#: Texts at an anchor, and shingles of a cluster's texts, beyond which they are dealt out in blocks of that many.
HOT, HOT_SHINGLES = 20_000, 1 << 20
#: Rows sent to the engine at a time.
ROWS = 500

PRINT = "doc_id long, h long, n int, a long, b long, c long, d long"
ANCHORED = "anchor long, id long, n int, a long, b long, c long, d long"


def _hashes(text: str | None, shingle: int, seeds: list[int]) -> tuple[bytes, Iterator[np.ndarray]]:
    """The words in lower case, a space apart, and the hashes of their shingles as rows of sixteen bytes for each seed, BLOCK at a time."""
    from xxhash import xxh3_128_digest

    words = (text or "").encode().lower().split()
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1) if words else 0
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts, stops = ends - sizes, ends[min(shingle, len(words)) - 1 :] - 1

    def blocks() -> Iterator[np.ndarray]:
        for at in range(0, n, BLOCK):
            parts = [joined[a:b] for a, b in zip(starts[at : min(n, at + BLOCK)].tolist(), stops[at : at + BLOCK].tolist(), strict=True)]
            yield np.hstack([np.frombuffer(b"".join([xxh3_128_digest(x, seed) for x in parts]), np.uint8).reshape(-1, 16) for seed in seeds])

    return joined, blocks()


def _set(blocks: Iterator[np.ndarray]) -> np.ndarray:
    """The distinct hashes, sorted; half of their bits tells shingles apart."""
    parts = [np.ascontiguousarray(block[:, :8]).view("<i8").ravel() for block in blocks]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def wide_print(text: str | None, shingle: int, seed: int) -> tuple[int, ...]:
    """(hash of the words, number of distinct shingles, and the quarters of the fingerprint), all signed."""
    from xxhash import xxh3_64_intdigest

    joined, blocks = _hashes(text, shingle, [seed, seed + 1])
    counts, n, parts = np.zeros(WIDE, np.int64), 0, []
    for block in blocks:
        counts += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
        n += len(block)
        parts.append(block)
    h = xxh3_64_intdigest(joined, seed)
    return h - (1 << 64) if h >> 63 else h, len(_set(iter(parts))), *np.packbits(2 * counts > n).view("<i8").tolist()


def _prints(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [wide_print(text.as_py(), shingle, seed) for text in batch.column(1)]
            h, n, *quarters = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64()), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in quarters)], names=["doc_id", "h", "n", *QUARTERS])

    return texts.mapInArrow(lean(compute), PRINT)


def words_for(n: int, share: Fraction) -> tuple[int, int]:
    """(bits in a word, number of words) for ``n`` texts."""
    bits = min(44, max(8, math.ceil(math.log2(max(2, n) / GROUP))))
    # A bit differs as often as the angle between the sets' indicator vectors is part of a half turn.
    same = 1 - math.acos(2 * share / (1 + share)) / math.pi
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))) if same < 1 else 1


def _anchored(nodes: DataFrame, bits: int, words: int, seed: int) -> DataFrame:
    """A row for each anchor of each of ``nodes`` (id, n, a, b, c, d)."""
    draw = np.random.default_rng(seed)
    places = np.stack([draw.choice(WIDE, bits, replace=False) for _ in range(words)])
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                halves = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)], axis=1).astype("<i8")
                own = np.unpackbits(halves.view(np.uint8).reshape(len(halves), -1), axis=1)
                anchors = np.stack([(own[:, p].astype(np.int64) * weights).sum(1) + (np.int64(w) << bits) for w, p in enumerate(places)])
                each = pa.array(np.tile(np.arange(len(halves)), words))
                yield pa.RecordBatch.from_arrays([pa.array(anchors.ravel()), *(batch.column(i).take(each) for i in range(6))], names=[f.split(" ")[0] for f in ANCHORED.split(", ")])

    return nodes.select("id", "n", *QUARTERS).mapInArrow(lean(replicate), ANCHORED)


def _dealt(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """``rows`` with columns s (its own block), i and j: a row goes to every pair of blocks that holds its own.

    ``blocks``: (key, m) of the keys that have more than one block."""
    split = rows.join(blocks, key, "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    every = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return every.withColumns({"i": F.least("s", "o"), "j": F.greatest("s", "o")}).drop("m", "o")


def _met(anchored: DataFrame) -> DataFrame:
    """The rows of ``anchored``, those of one (anchor, i, j) together in a partition."""
    hot = written(anchored.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("anchor", F.ceil(F.col("c") / HOT).cast("int").alias("m")), "hot")
    dealt = anchored.withColumns({c: F.lit(0) for c in "sij"}) if hot.isEmpty() else _dealt(anchored, "anchor", hot)
    return dealt.select("anchor", "i", "j", "s", "id", "n", *QUARTERS).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each (anchor, i, j), which may span batches."""
    kept: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {k: np.concatenate([x[k] for x in kept]) for k in kept[0]}

    for batch in batches:
        rows = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        new = (np.diff(rows["anchor"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for at, (x, y) in enumerate(pairwise(edges)):
            part = {k: v[x:y] for k, v in rows.items()}
            if kept and (at or any(kept[-1][k][-1] != part[k][0] for k in ("anchor", "i", "j"))):
                yield joined()
                kept = []
            kept.append(part)
    if kept:
        yield joined()


def _near(g: dict[str, np.ndarray], rows: np.ndarray, others: np.ndarray, share: Fraction) -> np.ndarray:
    """Which of ``others`` in the group differ from ``rows`` in at most FAR bits and are of fitting size."""
    # Unsigned: of a negative number the bits of its absolute value would be counted.
    differ = sum(np.bitwise_count((g[c][rows, None] ^ g[c][others]).view(np.uint64)).astype(np.int16) for c in QUARTERS)
    n, m = g["n"].astype(np.int64)[rows, None], g["n"].astype(np.int64)[others]
    return (differ <= FAR) & (np.minimum(n, m) * share.denominator >= np.maximum(n, m) * share.numerator)


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[np.ndarray]]:
    """A spanning forest of ``n`` things, as those visited and what each of them found; ``near`` tells which of the unvisited are neighbours of one."""
    left, sources, found = np.arange(n), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(at, left)
            if hit.any():
                sources.append(at)
                found.append(left[hit])
                queue += left[hit].tolist()
                left = left[~hit]
    return sources, found


def _edges(met: DataFrame, share: Fraction) -> DataFrame:
    """(u, v): of the texts of each anchor, a spanning forest of those near each other."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            size = len(g["id"])
            every = np.arange(size)
            if size <= 2_048:
                table = _near(g, every, every, share)
                u, v = np.nonzero(np.triu(table, 1))
                if len(u) > 2 * size:
                    sources, found = _forest(size, lambda at, left, table=table: table[at, left])
            else:
                u, (sources, found) = range(3 * size), _forest(size, lambda at, left, g=g: _near(g, np.array([at]), left, share)[0])
            if len(u) > 2 * size:
                u = np.repeat(np.array(sources, np.int64), [len(x) for x in found])
                v = np.concatenate(found) if found else u
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(g["id"][u]), pa.array(g["id"][v])], names=["u", "v"])

    return met.mapInArrow(lean(join), "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _links(share: Fraction):
    """Of the texts of a cluster (or of two blocks of it), a spanning forest of those whose sets are similar."""

    def run(table: pa.Table) -> pa.Table:
        sets = table["hashes"].combine_chunks()
        ids, sizes = table["id"].to_numpy(), np.diff(sets.offsets.to_numpy())
        _, words = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(sizes)
        own, marked_ = np.split(words, ends[:-1]), np.zeros(len(words) + 1, bool)
        held: dict = {"left": None}

        def near(at: int, left: np.ndarray) -> np.ndarray:
            if held["left"] is None or len(held["left"]) != len(left):
                held.update(left=left, flat=np.concatenate([own[x] for x in left.tolist()]), starts=np.cumsum(sizes[left]) - sizes[left])
            marked_[own[at]] = True
            common = np.add.reduceat(marked_[held["flat"]], held["starts"], dtype=np.int64)
            marked_[own[at]] = False
            return common * (share.numerator + share.denominator) >= (sizes[at] + sizes[left]) * share.numerator

        sources, found = _forest(len(ids), near)
        u = np.repeat(np.array(sources, np.int64), [len(x) for x in found])
        v = np.concatenate(found) if found else u
        return pa.table({"u": pa.array(ids[u], pa.int64()), "v": pa.array(ids[v], pa.int64())})

    return run


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(id, cluster, hashes) of ``wanted`` (id, cluster, h, low: an identifier of a document that has those words)."""
    from xxhash import xxh3_64_intdigest

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                own = [_hashes(text.as_py(), shingle, [seed]) for text in batch.column(1)]
                h = np.array([xxh3_64_intdigest(joined, seed) for joined, _ in own], np.uint64).view(np.int64)
                sets = [_set(blocks) for _, blocks in own]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["low", "h", "hashes"])

    bits = bits_for(wanted.count())
    some = marked(texts, bitmap(wanted, "low", bits), F.col("doc_id"), "may", bits).where("may").select("doc_id", "text")
    found = some.mapInArrow(lean(compute), "low long, h long, hashes array<long>").groupBy("low", "h").agg(F.first("hashes").alias("hashes"))
    return found.join(wanted, found.low.eqNullSafe(wanted.low) & (found.h == wanted.h)).select("id", "cluster", "hashes")


def similar_groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id (smallest identifier reachable through texts of that Jaccard similarity)."""
    share = Fraction(str(similarity))
    if not 0 < share <= 1:
        raise ValueError("the similarity has to be above 0 and at most 1")
    texts = texts_of(docs, id_col, text_col)
    prints = written(_prints(texts, shingle, seed), "prints")
    nodes = prints.groupBy("h", *QUARTERS).agg(F.min("doc_id").alias("low"), F.first("n").alias("n"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    bits, words = words_for(nodes.count(), share)

    edges = written(_edges(_met(_anchored(nodes, bits, words, seed)), share), "edges")
    clusters = components(edges).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    clustered = written(clusters.join(nodes, "id"), "clustered")
    discard(edges)
    sets = written(_sets(texts, clustered, shingle, seed), "sets")
    sizes = clustered.groupBy("cluster").agg(F.ceil(F.sum("n") / HOT_SHINGLES).cast("int").alias("m")).where("m > 1")
    dealt = _dealt(sets, "cluster", written(sizes, "sizes"))
    links = written(dealt.groupBy("cluster", "i", "j").applyInArrow(_links(share), "u long, v long"), "links")
    discard(sets, clustered)
    roots = components(links)
    named = written(nodes.join(roots, nodes.id == roots.node, "left").select("h", *QUARTERS, "low", F.coalesce("root", "id").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.join(lowest, "root").select("h", *QUARTERS, "component_id")
    return prints.join(labels, ["h", *QUARTERS]).select("doc_id", "component_id")
