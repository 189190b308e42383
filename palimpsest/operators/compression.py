"""Near-duplicate pairs, projections, spectral forms and decompositions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.paging import running_starts
from ..sources.store import dropped, kept
from .hierarchy import canonical_signs

#: A matrix whose shorter side is longer than this is known by its LEADING singular values: those whose energy counts as the whole.
DENSE, LEADING = 500, 100
#: Numbers of the right vectors that the driver may hold.
MOST_NUMBERS = 1 << 25
#: Of a spectrum without its vectors: directions beyond the leading ones, directions of a task, rows of a chunk, and the change of a value at which it is settled.
SPARE, WIDTH, CHUNK, SETTLED = 28, 8, 1 << 14, 1e-6
#: Numbers of all its directions that a task holds, but one direction at least.
ROOM = 1 << 22
#: Entries of a row that may become one with others; hubs have more, and more than one in so many of all entries.
LIST, HUBS = 64, 1000
#: Numbers of a matrix of vectors that goes to every task, and of the rows that meet it at a time.
HELD = 1 << 20
#: Vectors of a bucket that are compared with as many others in one task, so many of them at a time. A vector is sent once for each block of its bucket.
BLOCK_ROWS, STRIP = 32_768, 256

PAIRS = "a long, b long, cos double"


def near_pairs(table: DataFrame, d: int, threshold: float = 0.95, m: int = 4, w: float = 10.0, seed: int = 42, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(a, b, cos) with a < b: vectors of one bucket whose cosine reaches the threshold; vectors without a norm have no pairs.

    Norms are taken once. A bucket is dealt out as pairs of blocks, each a product of two matrices in a task of its own, so no
    bucket is too large for a task. Pairs go on strip by strip: a task doesn't hold all that it finds.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), vectors.bucket(F.col(vector_col), d, m, w, seed).alias("bucket"))
    rows = rows.withColumn("norm", vectors.norm(F.col("x"))).where("norm >= 1e-10").select("id", "bucket", F.transform("x", lambda v: v / F.col("norm")).alias("x"))
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("m"))
    placed = rows.join(blocks, "bucket").withColumn("s", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("bucket", F.least("s", "o").alias("p"), F.greatest("s", "o").alias("q"), "s", "id", "x")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        p, q = int(pdf.p.iloc[0]), int(pdf.q.iloc[0])
        left, right = pdf[pdf.s == p], pdf[pdf.s == q]
        if len(left) and len(right):
            x, y, a_ids, b_ids = np.stack(left.x.to_numpy()), np.stack(right.x.to_numpy()), left.id.to_numpy(), right.id.to_numpy()
            del pdf, left, right
            for start in range(0, len(x), STRIP):
                cos = x[start : start + STRIP] @ y.T
                i, j = np.nonzero(cos >= threshold)
                a, b = a_ids[start + i], b_ids[j]
                use = a < b if p == q else a != b
                yield pd.DataFrame({"a": np.minimum(a, b)[use], "b": np.maximum(a, b)[use], "cos": cos[i, j][use]})

    return dealt.groupBy("bucket", "p", "q").applyInPandas(compare, PAIRS)


def projected(table: DataFrame, d: int, k: int = 16, seed: int = 42, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    return table.select(F.col(id_col).alias("id"), vectors.project(F.col(vector_col), d, k, seed).alias("vector"))


def unprojected(table: DataFrame, d: int, k: int = 16, seed: int = 42, vector_col: str = "vector") -> DataFrame:
    """Back to ``d`` dimensions by the projection's pseudo-inverse."""
    inverse = np.linalg.pinv(vectors.projection(d, k, seed))
    return table.select("id", F.array(*[vectors.dot(F.col(vector_col), vectors.literal(col)) for col in inverse.T]).alias("vector"))


def group_eigen(entries: DataFrame, k: int = 5) -> DataFrame:
    """(key, eigenvalues): the ``k`` smallest by magnitude of each key's small symmetric matrix (key, i, j, v)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf.i.max(), pdf.j.max())) + 1
        if k >= n:
            raise ValueError("k has to be smaller than the matrix")
        matrix = np.zeros((n, n))
        matrix[pdf.i, pdf.j] = pdf.v
        values, u = np.linalg.eigh(matrix)
        pick = np.argsort(np.abs(values), kind="stable")[:k]
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "eigenvalues": [values[pick].tolist()], "eigenvectors": [canonical_signs(u[:, pick]).tolist()]})

    return entries.groupBy("key").applyInPandas(run, "key long, eigenvalues array<double>, eigenvectors array<array<double>>")


def from_spectrum(values: np.ndarray, u: np.ndarray, sigma: float = 1.0, threshold: float = 1e-6) -> np.ndarray:
    """Similarities exp(-|x_i - x_j|^2 / 2 sigma^2) of coordinates u / sqrt(value); no diagonal, small ones dropped."""
    scale = np.where(values > 1e-10, 1 / np.sqrt(np.maximum(values, 1e-10)), 0)
    x = u * scale
    out = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * sigma**2))
    np.fill_diagonal(out, 0)
    return np.where(out >= threshold, out, 0)


def rank_of(values: np.ndarray, m: int, n: int, rank: int | None, ratio: float | None, explained: float) -> int:
    if rank is not None and ratio is not None:
        raise ValueError("give a rank or a ratio")
    if rank is not None:
        if not 1 <= rank <= min(m, n):
            raise ValueError("rank out of range")
        return rank
    if ratio is not None:
        if ratio < 1:
            raise ValueError("ratio below 1")
        return max(1, int(min(m, n) / ratio / 2))
    share = np.cumsum(values**2) / max((values**2).sum(), 1e-300)
    return int(np.searchsorted(share, explained) + 1)


@dataclass(frozen=True)
class Decomposition:
    """Singular values, right vectors (k, j, v), the compression ratio, and the share of all energy that the values explain."""

    values: np.ndarray
    right: DataFrame
    ratio: float
    share: float
    #: The right vectors as a matrix (j, k) of HELD numbers at most, if they are those of the shorter side.
    held: np.ndarray | None = None


def svd(entries: DataFrame, rank: int | None = None, ratio: float | None = None, explained: float = 0.95) -> Decomposition:
    """Of a matrix (i, j, v); entries of one place are summed.

    Without ``rank`` and ``ratio`` the rank is the smallest that explains ``explained`` of the energy: of all of it if the shorter side has at most
    DENSE, else of that of the LEADING largest values, by definition; ``share`` tells the part of all energy in either case. A rank that
    can't be had is an error. Products are taken on the executors; the driver holds the right vectors, MOST_NUMBERS at most.
    """
    spark = entries.sparkSession
    summed = kept(entries.groupBy("i", "j").agg(F.sum("v").alias("v")), "summed")
    m, n, energy = summed.agg(F.max("i") + 1, F.max("j") + 1, F.sum(F.col("v") * F.col("v"))).first()
    if not m:
        raise ValueError("empty matrix")
    m, n = int(m), int(n)
    wide = n > m  # the longer side is that of the rows
    short = min(m, n)
    wanted = None if rank is None and ratio is None else rank_of(np.zeros(0), m, n, rank, ratio, explained)
    k = wanted or (short if short <= DENSE else LEADING)
    if k * short > MOST_NUMBERS:
        raise ValueError(f"{k} vectors of {short} numbers are more than the driver may hold")
    row, col = ("j", "i") if wide else ("i", "j")
    if short <= DENSE:
        values, v = _of_gram(summed.select(F.col(row).alias("i"), F.col(col).alias("j"), "v"), short, k)
    else:
        vectors_of = summed.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(col).cast("int").alias("j"), "v"))).alias("x"))
        rows = vectors_of.select("x.j", "x.v").rdd.map(lambda r: OldVectors.sparse(short, r[0], r[1])).persist(StorageLevel.MEMORY_AND_DISK)  # read by every iteration
        done = RowMatrix(rows, max(m, n), short).computeSVD(k, False)
        values, v = done.s.toArray(), done.V.toArray()
        rows.unpersist()
    if wanted is not None and len(values) < wanted:
        raise ValueError(f"the matrix has no more than {len(values)} singular values that differ from zero")
    r = wanted or min(rank_of(values, m, n, None, None, explained), len(values))
    values, v = values[:r], canonical_signs(v[:, :r].copy())
    near = spark.createDataFrame(pd.DataFrame({"k": np.tile(np.arange(r, dtype=np.int32), short), "j": np.repeat(np.arange(short, dtype=np.int64), r), "v": v.ravel()}), "k int, j long, v double").where("v <> 0")
    right = near if not wide else _carried(summed.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), near, values).select("k", F.col("i").alias("j"), "v")
    held = v if not wide and v.size <= HELD else None
    return Decomposition(values, right, m * n / (m * r + r + r * n), float((values**2).sum() / energy) if energy else 0.0, held)


def _dense(places: pa.Array, numbers: pa.Array, width: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of lists of places and numbers as rows of a matrix, ``most`` numbers or one row at a time."""
    ends, at, x = places.offsets.to_numpy(), places.values.to_numpy(), numbers.values.to_numpy()
    strip = max(1, most // width)
    for a in range(0, len(places), strip):
        e = ends[a : a + strip + 1]
        out = np.zeros((len(e) - 1, width))
        np.add.at(out, (np.repeat(np.arange(len(e) - 1), np.diff(e)), at[e[0] : e[-1]]), x[e[0] : e[-1]])
        yield a, out


def _rows(entries: DataFrame) -> DataFrame:
    """(i, j, v) with the places and numbers of a row in lists."""
    return entries.groupBy("i").agg(F.collect_list(F.struct(F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))).alias("x")).select("i", F.col("x.j").alias("j"), F.col("x.v").alias("v"))


def _of_gram(entries: DataFrame, short: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values, as many as differ from zero, and their right vectors by the matrix's product with itself, a part from each task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((short, short))
        for batch in batches:
            for _, x in _dense(batch.column(1), batch.column(2), short, HELD):
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"gram": [total.tobytes()]})

    gram = np.zeros((short, short))
    for r in _rows(entries).mapInArrow(part, "gram binary").toLocalIterator():
        gram += np.frombuffer(r.gram).reshape(short, short)
    squares, v = np.linalg.eigh(gram)
    values = np.sqrt(np.maximum(squares[::-1], 0))[:k]
    some = values > 1e-9 * max(values[0], 0.0)
    return values[some], v[:, ::-1][:, :k][:, some]


def _times(entries: DataFrame, matrix: np.ndarray, name: str) -> DataFrame:
    """(i, ``name``, v): entries (i, j, v) times a matrix that every task holds; rows meet once, products are taken where they are."""
    height, width = matrix.shape
    kind = pa.int32() if name == "k" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, x in _dense(batch.column(1), batch.column(2), height, HELD):
                step = max(1, HELD // width)
                for b in range(0, len(x), step):
                    out = x[b : b + step] @ matrix
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a + b : a + b + len(out)], width)), pa.array(np.tile(np.arange(width), len(out)), kind), pa.array(out.ravel())], names=["i", name, "v"])

    return _rows(entries).mapInArrow(run, f"i long, {name} {'int' if name == 'k' else 'long'}, v double")


@dataclass(frozen=True)
class Spectrum:
    """Singular values, the compression ratio, and the share of all energy that the values explain."""

    values: np.ndarray
    ratio: float
    share: float


def spectrum(entries: DataFrame, explained: float = 0.95) -> Spectrum:
    """As ``svd`` without rank and ratio, but without vectors: where the driver may not hold those, no task and no driver holds all of them."""
    summed = kept(entries.groupBy("i", "j").agg(F.sum("v").alias("v")), "summed")
    m, n, energy = summed.agg(F.max("i") + 1, F.max("j") + 1, F.sum(F.col("v") * F.col("v"))).first()
    if not m or min(m, n) <= DENSE or LEADING * min(m, n) <= MOST_NUMBERS:
        done = svd(summed, explained=explained)
        return Spectrum(done.values, done.ratio, done.share)
    core, known = _reduced(summed, LEADING)
    height, width = (int(core.agg(F.max(c) + 1).first()[0]) for c in "ij")
    turned = core if height >= width else _turned(core)
    values = _leading(turned, max(height, width), min(height, width), LEADING, explained, known)
    r = min(rank_of(values, m, n, None, None, explained), len(values))
    return Spectrum(values[:r], m * n / (m * r + r + r * n), float((values[:r] ** 2).sum() / energy) if energy else 0.0)


def _turned(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _merged(entries: DataFrame, hubs: list[int]) -> DataFrame:
    """(i, j, v) with one column for each set of equal columns of LIST entries or fewer, times the root of their number; hubs stay as they are."""
    lists = entries.where(~F.col("j").isin(hubs)).groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    # Long ones differ by their own number.
    same = lists.groupBy("x", F.when(F.size("x") > LIST, F.col("j")).alias("own")).agg(F.min("j").alias("j"), F.sqrt(F.count("*")).alias("root"))
    one = same.select("j", "root", F.explode("x").alias("e")).select("e.i", "j", (F.col("e.v") * F.col("root")).alias("v"))
    return one.unionByName(entries.where(F.col("j").isin(hubs)).select("i", "j", "v"))


def _dense_numbers(entries: DataFrame, column: str) -> DataFrame:
    """Entries with the numbers of a column replaced by dense ones from 0."""
    numbers = running_starts(entries.select(column).distinct().withColumn("n", F.lit(1).cast("long")), [column]).select(column, F.col("start").alias("place"))
    # Numbers are hashed, one row for each: those of hubs would else be sorted in one task.
    return entries.join(numbers.hint("shuffle_hash"), column).withColumn(column, F.col("place")).drop("place")


def _reduced(entries: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """A smaller matrix (i, j, v), numbered densely, and values: its singular values and these are the matrix's ``k`` largest, with all zeros left out.

    Turning rows or columns among themselves changes no singular value. So n equal columns are one, times the root of n, and rows likewise. Then a row and a
    column that but for hubs have just the entry in which they meet are a pair. n pairs with the same value and the same entries at hubs are one, with
    its entries at hubs times the root of n, and n - 1 rows and columns that have the value and nothing else. Most of a graph of names met once is such pairs.
    """
    least = max(LIST, entries.count() // HUBS)
    hubs = {c: [r[0] for r in entries.groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") > least).select(c).collect()] for c in "ij"}  # HUBS at most
    merged = kept(_turned(_merged(_turned(_merged(entries, hubs["j"])), hubs["i"])), "merged")
    of_hub = {c: F.col(c).isin(hubs[c]) for c in "ij"}

    def alone(own: str, other: str) -> DataFrame:
        """Rows (or columns) with one entry that is no hub's: its place and value, and their entries at hubs."""
        at_hubs = F.array_sort(F.collect_list(F.when(of_hub[other], F.struct(F.col(other).alias("at"), "v")))).alias(f"{own}_hubs")
        met = [F.max(F.when(~of_hub[other], F.col(c))).alias(c) for c in (other, "v")]
        return merged.where(~of_hub[own]).groupBy(own).agg(at_hubs, F.count_if(~of_hub[other]).alias("n"), *met).where("n = 1").drop("n")

    pairs = kept(alone("i", "j").join(alone("j", "i").drop("v"), ["i", "j"]), "pairs")
    classes = kept(pairs.groupBy("v", "i_hubs", "j_hubs").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count("*").alias("n")), "classes")
    root = F.sqrt("n")
    ones = [classes.select("i", "j", "v")]
    ones.append(classes.select("i", F.explode("i_hubs").alias("e"), root.alias("root")).select("i", F.col("e.at").alias("j"), (F.col("e.v") * F.col("root")).alias("v")))
    ones.append(classes.select("j", F.explode("j_hubs").alias("e"), root.alias("root")).select(F.col("e.at").alias("i"), "j", (F.col("e.v") * F.col("root")).alias("v")))
    # An entry of a pair is known by its row, or, in a hub's row, by its column.
    rest = [merged.where(~of_hub["i"]).join(pairs.select("i"), "i", "left_anti"), merged.where(of_hub["i"] & ~of_hub["j"]).join(pairs.select("j"), "j", "left_anti"), merged.where(of_hub["i"] & of_hub["j"])]
    core = kept(reduce(DataFrame.unionByName, [t.select("i", "j", "v") for t in (*rest, *ones)]), "core")
    most = classes.where("n > 1 AND v <> 0").groupBy(F.abs("v").alias("v")).agg(F.sum(F.col("n") - 1).alias("n")).orderBy(F.desc("v")).limit(k).collect()
    numbered = kept(_dense_numbers(_dense_numbers(core, "i"), "j").select("i", "j", "v"), "numbered")
    for table in (merged, pairs, classes, core):
        dropped(table)
    return numbered, np.repeat([float(r.v) for r in most], [min(k, int(r.n)) for r in most])[:k]


def _leading(entries: DataFrame, m: int, n: int, k: int, explained: float, known: np.ndarray) -> np.ndarray:
    """The ``k`` largest of the singular values of a sparse matrix (i, j, v) and of those ``known`` besides, fewer if there are no more.

    Settled are those that explain ``explained`` of the energy of all ``k``, and how many these are.

    Subspace iteration: a task takes the matrix through A'A for WIDTH directions or as many as it may hold, a column at a time; chunks of all directions'
    rows then give their products, a small matrix that the driver sums and turns into new directions. The last products are of unrounded directions.
    """
    own = max(1, min(WIDTH, ROOM // max(m, n)))
    groups = -(-(k + SPARE) // own)
    size, place = groups * own, np.int32 if max(m, n) < 1 << 31 else np.int64
    both = lambda values: np.sort(np.concatenate([values, known]))[::-1][:k]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([-1], pa.int64()), "a": [i.astype(place).tobytes()], "b": [j.astype(place).tobytes()], "c": [v.astype(np.float64).tobytes()]})

    matrix = kept(entries.select("i", "j", F.col("v").cast("double").alias("v")).mapInArrow(packed, "chunk long, a binary, b binary, c binary"), "matrix")
    # Each group of directions needs the whole matrix: twelve or sixteen bytes an entry, once a group and step.
    sent = matrix.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "chunk", "a", "b", "c")

    def directions(z: DataFrame, turn: np.ndarray, given: type, made: type) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = (np.frombuffer(rows.as_buffer(), given).reshape(-1, size).astype(np.float64) @ turn).astype(made)
                    parts = [np.ascontiguousarray(x[:, g * own : (g + 1) * own]).tobytes() for g in range(groups)]
                    yield pa.RecordBatch.from_pydict({"g": pa.array(range(groups), pa.int32()), "chunk": [chunk] * groups, "a": parts, "b": pa.nulls(groups, pa.binary()), "c": pa.nulls(groups, pa.binary())})

        return z.select("chunk", "z").mapInArrow(run, "g int, chunk long, a binary, b binary, c binary")

    def step(x: DataFrame | None, times: int, given: type, made: type) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """(chunk, z) of (A'A)^times x, singular values of x's projection, and what turns z into its orthonormal singular directions."""

        fresh = x is None

        def through(pdf: pd.DataFrame) -> pd.DataFrame:
            g, held, start = int(pdf.g.iloc[0]), pdf[pdf.chunk < 0], pdf[pdf.chunk >= 0]
            i, j, v = (np.concatenate([np.frombuffer(b, t) for b in held[c]]) for c, t in (("a", place), ("b", place), ("c", np.float64)))
            parts = {int(c): np.frombuffer(b, given).reshape(-1, own) for c, b in zip(start.chunk, start.a, strict=True)}
            out, random = np.zeros((n, own), made), np.random.default_rng(g)
            for w in range(own):
                y = random.standard_normal(n) if fresh else np.zeros(n)
                for c, part in parts.items():
                    y[c * CHUNK : c * CHUNK + len(part)] = part[:, w]
                for _ in range(times):
                    y = np.bincount(j, v * np.bincount(i, v * y[j], m)[i], n)
                out[:, w] = y
            at = range(0, n, CHUNK)
            return pd.DataFrame({"chunk": [c // CHUNK for c in at], "g": [g] * len(at), "z": [out[c : c + CHUNK].tobytes() for c in at]})

        def products(pdf: pd.DataFrame) -> pd.DataFrame:
            z = np.concatenate([np.frombuffer(b, made).reshape(-1, own) for b in pdf.sort_values("g").z], axis=1)
            wide = z.astype(np.float64)
            return pd.DataFrame({"chunk": [int(pdf.chunk.iloc[0])], "z": [z.tobytes()], "gram": [(wide.T @ wide).tobytes()]})

        rows = sent if fresh else sent.unionByName(x)
        gone = rows.groupBy("g").applyInPandas(through, "chunk long, g int, z binary")
        z = kept(gone.groupBy("chunk").applyInPandas(products, "chunk long, z binary, gram binary"), "directions")
        gram = np.zeros((size, size))
        for r in z.select("gram").toLocalIterator():
            gram += np.frombuffer(r.gram).reshape(size, size)
        # Columns are brought to one length first: their lengths differ by powers of the singular values.
        length = np.sqrt(np.diag(gram))
        scale = np.divide(1.0, length, out=np.zeros(size), where=length > 0)
        parts, u = np.linalg.eigh(scale[:, None] * gram * scale)
        some = parts > 1e-12 * max(parts[-1], 0.0)
        root, u = np.sqrt(parts[some]), u[:, some]
        p, s, _ = np.linalg.svd(root[:, None] * u.T * length, full_matrices=False)
        turn = np.zeros((size, size))
        turn[:, : len(root)] = (scale[:, None] * u / root) @ p
        return z, s ** (0.5 / times), turn

    z, _, turn = step(None, 1, np.float64, np.float32)
    before, settled, times = np.zeros(0), False, 1
    while True:
        made = np.float64 if settled else np.float32
        last, (z, values, turn) = z, step(directions(z, turn, np.float32, made), times, made, made)
        dropped(last)
        if settled:
            break
        # Values only rise. Those beyond the rank count by the sum of their energy: ten times its last rise may not change the rank.
        values, settled = both(values), False
        if len(values) == len(before):
            rise = 10 * max(0.0, (values**2).sum() - (before**2).sum())
            r = rank_of(values, m, n, None, None, explained)
            most = int(np.searchsorted(np.cumsum(values**2), explained * ((values**2).sum() + rise)) + 1)
            settled = r == most and bool((np.abs(values[:r] - before[:r]) <= SETTLED * values[:r]).all())
        times, before = 1 if settled else 2, values
    dropped(z)
    dropped(matrix)
    values = both(values)
    return values[values > 1e-9 * values[0]] if len(values) else values


def _carried(entries: DataFrame, near: DataFrame, values: np.ndarray) -> DataFrame:
    """(i, k, v): entries times the vectors ``near`` (k, j, v), each divided by its singular value."""
    scale = F.element_at(vectors.literal(1 / values), F.col("k") + 1)
    return entries.join(near.withColumnRenamed("v", "x"), "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("x")).alias("v")).withColumn("v", F.col("v") * scale)


def left_vectors(entries: DataFrame, done: Decomposition) -> DataFrame:
    """(i, k, v): the left singular vectors of the matrix that was decomposed."""
    if done.held is not None:
        return _times(entries, done.held / done.values, "k")
    return _carried(entries, done.right, done.values)


def reconstructed(left: DataFrame, done: Decomposition) -> DataFrame:
    """(i, j, v): the matrix of left vectors, values and right vectors."""
    if done.held is not None:
        some = np.flatnonzero((done.held != 0).any(1))
        back = _times(left.withColumnRenamed("k", "j"), (done.held * done.values).T[:, some], "j")
        return back if len(some) == len(done.held) else back.withColumn("j", F.element_at(F.lit([int(x) for x in some]).cast("array<long>"), (F.col("j") + 1).cast("int")))
    scaled = left.select("i", "k", (F.col("v") * F.element_at(vectors.literal(done.values), F.col("k") + 1)).alias("u"))
    return scaled.join(done.right, "k").groupBy("i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("v"))
