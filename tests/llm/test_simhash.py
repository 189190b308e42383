import numpy as np
import xxhash

from palimpsest.llm import simhash
from palimpsest.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(((d, f"{fps[i]:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_anchors_cover_every_pair_within_two_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    bits = np.sort(rng.integers(0, 64, (4000, 2)), axis=1)
    y = x ^ (np.uint64(1) << bits[:, 0].astype(np.uint64)) ^ np.where(bits[:, 0] == bits[:, 1], np.uint64(0), np.uint64(1) << bits[:, 1].astype(np.uint64))
    at, anchors = simhash.replicas(y)
    reached = set(zip(at.tolist(), anchors.tolist(), strict=True))
    assert all(pair in reached for pair in enumerate(simhash.homes(x).tolist()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocabulary, 150))
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            words[rng.integers(0, 150)] = "changed"
            rows.append((10 * i + k, " ".join(words).upper()))
    rows += [(9001, None), (9002, ""), (9003, "one"), (9003, "one"), (None, "two words"), (9005, "é" * 30_000 + " x"), (9006, "two words")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, low long")
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}
