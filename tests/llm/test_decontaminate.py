import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import decontaminate
from palimpsest.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items, window):
    windows = {}
    for name, text in items:
        words = WORD.findall(lower(text or ""))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + window]), set()).add(str(name) if name is not None else "")
    out = []
    for doc_id, text in docs:
        words = WORD.findall(lower(text or ""))
        hit, found = [False] * len(words), set()
        for i in range(len(words)):
            for n in {len(w) for w in windows}:
                if i + n <= len(words) and tuple(words[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[tuple(words[i : i + n])]
        out.append((doc_id, len(words), sum(hit), sorted(found)))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=5))
def test_index_finds_every_occurrence(text, phrases):
    text = np.array([*text, 0], np.int32)
    index = FMIndex(text, 3, rate=3)
    table = np.zeros((len(phrases), 5), np.int32)
    for row, phrase in zip(table, phrases, strict=True):
        row[5 - len(phrase) :] = phrase
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for phrase, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(text)) if text[i : i + len(phrase)].tolist() == phrase]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffixes_are_sorted():
    text = np.array([2, 1, 2, 1, 0, 2, 1, 0], np.int32)
    assert suffix_array(text)[:2].tolist() == [4, 7]


DOCS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until night"),
    (2, "a QUICK, brown-fox jumps; over the lazy dog again!"),
    (3, None),
    (4, ""),
    (5, "... --- ..."),
    (6, "tiny item\x00here tiny item"),
    (6, "tiny item\x00here tiny item"),
    (None, "quick brown fox jumps over"),
    (7, "é" * 50_000 + " quick brown fox jumps over the" + " pad" * 50_000),
]
ITEMS = [(1, "quick brown fox jumps over the lazy dog"), (2, "Tiny item"), (3, None), (4, "   "), (5, "fox jumps over the lazy dog again and"), (None, "until night"), (10, "brown fox jumps over the lazy")]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 40])
def test_against_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find(docs, items, window=5, block_bytes=block_bytes).collect()
    rows = [(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), sorted(r["items"])) for r in got]
    assert sorted(rows, key=str) == brute(DOCS, ITEMS, 5)
    cleaned = decontaminate.remove(docs, items, window=5, block_bytes=block_bytes)
    assert cleaned.columns == docs.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[1] == "The  again " and texts[2] == "a !" and texts[3] is None and texts[5] == "... --- ..."
    assert decontaminate.find(cleaned.where("doc_id <= 3"), items, window=5).where("size(spans) > 0").count() == 0


def test_words_across_slices(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 7)
    text = "one two threeandmoreandmore é four".encode()
    assert [w for part in decontaminate.words_of(text) for w in part] == text.split()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find(none, items).count() == 0
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert decontaminate.find(docs, items.limit(0)).where("size(spans) > 0").count() == 0
