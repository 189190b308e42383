import hashlib
import random
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import suffix_dedup as sd


def brute(rows, length):
    """Rows in corpus order: smaller identifiers first, none before any; equal ones as they come."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        edges = np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1
        out.append((doc_id, len(raw), int(gone.sum()), int(edges.sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), min_size=1, max_size=9))
def test_merge_of_runs(runs):
    runs = [sorted(r) for r in runs]
    lcps = [[0, *(sd.shared_prefix(a, b, 0) for a, b in pairwise(r))][: len(r)] for r in runs]
    which, lcp = sd.merge_runs(runs, lcps)
    ways = [iter(r) for r in runs]
    merged = [next(ways[w]) for w in which]
    assert merged == sorted(x for r in runs for x in r)
    assert lcp[1:] == [sd.shared_prefix(a, b, 0) for a, b in pairwise(merged)]


def test_runs_are_front_coded():
    rights = [b"abc", b"abcd", b"b", b"b\x00"]
    n = np.arange(4)
    run = sd.Run(rights, [b"", b"x", b"yy", b""], np.array([0, 3, 0, 1]), least=n, doc_id=n, rid=n, at=n, place=n)
    back = sd.Run.unpack(run.pack())
    assert (back.rights, back.lefts, back.lcp.tolist()) == (run.rights, run.lefts, run.lcp.tolist())


@pytest.mark.parametrize(("hot", "block_bytes", "range_bytes", "alphabet"), [(1000, 1 << 22, 1 << 25, "ab"), (0, 300, 500, "ab"), (2, 64, 100, "abé\x00"), (1000, 200, 400, "abcdefgh")])
def test_against_brute_force(spark, hot, block_bytes, range_bytes, alphabet):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [text(40) for _ in range(4)]
    rows = [(i, text(rng.randrange(60)) + rng.choice(passages)[rng.randrange(10) :] + text(rng.randrange(30))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "a" * 700), (203, rows[3][1]), (None, rows[4][1]), (204, rows[5][1] * 9), (205, text(2_000)), (206, "x" + rows[5][1] * 9)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", b"") for r in rows], "doc_id long, text string, block string, data binary").repartition(3)
    got = sd.cut_repeats(df, length=12, gram=4, block_bytes=block_bytes, range_bytes=range_bytes, hot=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 12)


def test_strings_of_a_hundred_bytes(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(60) for _ in range(3)]
    rows = [(i, prose(40) + (rng.choice(shared)[i % 7 :] if i % 3 else "") + prose(20)) for i in range(80)]
    rows += [(100, rows[7][1]), (100, rows[7][1]), (101, "same line " * 50), (102, shared[0][:99]), (103, shared[0][:100])]
    got = sd.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2_000).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 100)


def test_empty_table(spark):
    assert sd.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
