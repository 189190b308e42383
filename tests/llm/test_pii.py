import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.sampled_from("ab.@-1é %+"), max_size=60), st.text(st.sampled_from("0123456789 -.+()"), max_size=60), st.text(max_size=40)))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999.", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "x" * 100_000 + "@", "1" * 50_000, "+" * 1000])
def test_base_spans_by_example(text):
    assert pii.base_spans(text) == (plain(text) if len(text) < 2_000 else [])


def brute(rows, threshold):
    """The whole method, document by document."""
    texts = [t or "" for _, t in rows]
    n, n_e, n_t, n_te = len(set(texts)), {}, {}, {}
    for text in set(texts):  # copies count once
        spans = pii.base_spans(text)
        for e in {pii.entity_of(k, text[a:b]) for k, a, b in spans}:
            n_e[e] = n_e.get(e, 0) + 1
        for pair in {(e, t) for e, terms in pii.contexts(text, spans) for t in terms}:
            n_te[pair] = n_te.get(pair, 0) + 1
        for w in set(text.encode().translate(pii.TERM_BYTES).split()):
            n_t[w.decode()] = n_t.get(w.decode(), 0) + 1
    flagged = {t for (e, t), k in n_te.items() if pii.information(n, n_e[e], n_t[t], k) >= threshold}
    out = []
    for (doc_id, _), text in zip(rows, texts, strict=True):
        spans = pii.base_spans(text)
        blank = pii.masked(text, spans)
        places = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[A-Z]", blank)]
        words = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", blank)]
        assert places or not words
        lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
        out.append((doc_id, spans, sorted((m.start(), m.end(), lower(m[0])) for m in words if lower(m[0]) in flagged and len(m[0].encode()) >= 3)))
    return out, flagged


ROWS = [(i, f"Filler number{i} of talk. " + ("Zephyrine Quux writes from zq@mail.example.com about item" + str(i) if i % 5 == 0 else "the mail about other item of talk")) for i in range(60)]
ROWS += [(100, None), (101, ""), (None, "Zephyrine alone, é ZEPHYRINE 4111 1111 1111 1111"), (102, "w " * 60_000 + "quux"), (102, "w " * 60_000 + "quux")]


# Entities with one mention, alone or in copies: what stands near them and hardly anywhere else gives them away.
ROWS += [(200 + i, "Ask Wilhelmina on +49 30 1234567 about the mail.") for i in range(5)] + [(210, "Barnaby has 10.1.2.3 and filler."), (211, "talk of mail")]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", b"") for r in ROWS], "doc_id long, text string, term string, digest binary")
    got = [(r.doc_id, r.base, [(t.start, t.end, t.term) for t in r.terms or ()]) for r in pii.find(df).collect()]
    want, flagged = brute(ROWS, pii.THRESHOLD)
    assert {"zephyrine", "quux", "barnaby", "wilhelmina"} <= flagged and not {"talk", "about", "filler", "mail"} & flagged
    assert sorted(got, key=str) == sorted(((d, pii._joined(s), t) for d, s, t in want), key=str)


def test_sanitised_text():
    text = "Zoë at a@b.co, quux 7x"
    assert pii.sanitise_text(text, [(15, 19, "quux", 1.0), (20, 22, "7x", 0.85)]) == "Zoë at [email],  [number]"


def test_sanitised_table(spark):
    df = spark.createDataFrame([(*r, "x", b"") for r in ROWS], "doc_id long, text string, row string, terms binary")
    got = sorted(((r.doc_id, r.text, r.row, r.terms) for r in pii.sanitise(df).collect()), key=str)
    terms = {r.doc_id: r.terms or [] for r in pii.find(df).collect()}  # equal identifiers have equal texts here
    want = [(i, None if t is None else pii.sanitise_text(t, [(x.start, x.end, x.term, x.disclosure) for x in terms[i]]), "x", b"") for i, t in ROWS]
    assert got == sorted(want, key=str)
    whole = " ".join(t or "" for _, t, _, _ in got)
    assert "zq@mail" not in whole and "10.1.2.3" not in whole and "Barnaby" not in whole and "Zephyrine" not in whole and "talk" in whole


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.sanitise(empty).count() == 0
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_columns(spark):
    from palimpsest.llm import registry

    row = registry.op9_pii(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 0").first().text
    base = pii._joined(plain(text))
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and row.spans.startswith(base)
