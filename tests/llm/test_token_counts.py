import base64

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import token_counts as tc

PATH = P.path("byte_bpe_50k.tiktoken")


def greedy(word, vocabulary, prefix=b" "):
    """Takes the longest piece that fits, again and again."""
    rest, n, longest = prefix + word, 0, max(map(len, vocabulary), default=0)
    while rest:
        size = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in vocabulary), 0)
        if not size:
            return 1
        rest, n = rest[size:], n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 if x % 7 else 32 for x in b)), max_size=14), st.lists(st.text("abc", max_size=14), max_size=6))
def test_counts_are_those_of_greedy_matching(vocabulary, words):
    automaton = tc.Automaton(vocabulary)
    for word in words:
        assert automaton.count(word.encode()) == greedy(word.encode(), vocabulary)


ROWS = [(1, "The quick brown fox"), (2, None), (3, ""), (4, " \t\n"), (None, "Zoë's naïve café!!"), (5, "x" * 30_000), (5, "x" * 30_000), (6, "ab " * 50_000)]


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(tc, "SLICE_BYTES", 1_000)
    vocabulary = {base64.b64decode(line.split()[0]) for line in open(PATH, "rb")}
    want = []
    for doc_id, text in ROWS:
        words = (text or "").encode().split()
        pieces = {w: greedy(w, vocabulary) for w in set(words)}  # once for each different word
        want.append((doc_id, len((text or "").encode()), len(words), sum(pieces[w] for w in words)))
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, n_words int")
    assert sorted(map(tuple, tc.count_tokens(df, PATH).collect()), key=str) == sorted(want, key=str)


def test_slices_end_between_words(monkeypatch):
    monkeypatch.setattr(tc, "SLICE_BYTES", 3)
    raw = b" one twothree  four\x0bfive "
    assert [w for words in tc.words_of(raw) for w in words] == raw.split()


def test_empty_table(spark):
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
