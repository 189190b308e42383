"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give them away.

*Base.* E-mail addresses, IPv4 addresses, card and telephone numbers are the protected entities.
*Disclosure.* For an entity e and a term t of the words around it, the corpus gives their pointwise mutual information
``log(n_te N / (n_t n_e))``, from numbers of different texts (copies count once): of all, with e, with t anywhere, with t near e. Its share of
the entity's own information ``log(N / n_e)`` is the part of it that the term discloses. A meeting may be chance, the more so the fewer there
are: ``DISCOUNT`` of one is taken off ``n_te``. A term that stands near e alone discloses nearly all, however often e is met.
*Sanitisation.* A term that discloses at least ``threshold`` of some entity is a span of kind ``term``
wherever it stands; ``sanitise`` generalises it to its kind of word, or removes it from ``removal`` on.

All counts are over all documents. Term counts are kept only of words that a bitmap filter of fixed size
(``FILTER_BITS``) lets through: those that may be a candidate; a full filter costs time, not results. Entities, terms
and their pairs are combined before each shuffle.

Defined results: a null or empty text has no spans; a null identifier keeps its row; repeated rows are judged each (but count
once); an empty table gives an empty result; ``find`` ignores other columns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, ROW_BITS, bitmap, bits_for, lean, marked, packed, texts_of, written

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information from which a term is a span, and from which it is removed rather than generalised.
THRESHOLD, REMOVAL = 0.8, 0.95
#: Of a text, taken off the number of texts in which a term is met near an entity.
DISCOUNT = 0.5
#: Words on each side of an entity that count as near, characters looked at for them, and the least bytes of a term.
NEAR_WORDS, NEAR_CHARS, LEAST_BYTES = 8, 400, 3
#: Words whose place in the filter a worker remembers.
CACHE_WORDS = 500_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits can't start a match in its middle, so these look at each run once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
#: Bytes that are not part of terms become spaces, A to Z lower case.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: linear however long the words are."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def entity_of(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else NOT_DIGIT.sub('', value)}"


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with its base spans blanked; places stay."""
    for _, a, b in spans:
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def terms_of(words: list[bytes]) -> list[bytes]:
    return [w for w in words if len(w) >= LEAST_BYTES and not w.isdigit()]


def contexts(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[str]]]:
    """(entity, terms near it) for each base span."""
    blank = masked(text, spans)
    for kind, a, b in spans:
        left = blank[max(0, a - NEAR_CHARS) : a].encode().translate(TERM_BYTES).split()
        right = blank[b : b + NEAR_CHARS].encode().translate(TERM_BYTES).split()
        # The slices may cut a word at their far ends.
        near = left[1 if a > NEAR_CHARS else 0 :][-NEAR_WORDS:] + right[: -1 if len(blank) > b + NEAR_CHARS else None][:NEAR_WORDS]
        yield entity_of(kind, text[a:b]), sorted({w.decode() for w in terms_of(near)})


def digest_of(text: str) -> bytes:
    """That of the engine's own function sha2."""
    return hashlib.sha256(text.encode()).digest()


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


BASE = "doc_id long, digest binary, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<entity:string,term:string>>, entities array<string>"


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py()
            spans = base_spans(text)
            n = Counter(k for k, _, _ in spans)
            near = [{"entity": e, "term": t} for e, t in sorted({(e, t) for e, terms in contexts(text, spans) for t in terms})] if spans else []
            rows.append((digest_of(text), *(n[k] for k in KINDS), _joined(spans), near, sorted({entity_of(k, text[a:b]) for k, a, b in spans})))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), pair, pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "digest", "n_email", "n_ip", "n_card", "n_phone", "base", "near", "entities"])


def bitmap_of(rows: DataFrame, column: str) -> bytes:
    """Filter over a column of strings; FILTER_BITS long whatever the number of rows."""
    out = bytearray(FILTER_BITS // 8)
    for bucket, bits in bitmap(rows, column).collect():
        out[bucket * ROW_BITS // 8 : (bucket + 1) * ROW_BITS // 8] = bits
    return bytes(out)


class Filter(dict):
    """word -> whether the bitmap may have it."""

    def __init__(self, bitmap: bytes):
        import xxhash

        self.bitmap, self.hash = bitmap, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= CACHE_WORDS:
            self.clear()
        has = self[word] = self.has(word)
        return has

    def has(self, word: bytes) -> bool:
        at = self.hash(word, 42) % FILTER_BITS
        return bool(self.bitmap[at >> 3] >> (at & 7) & 1)


@lru_cache(3)
def _filter(bitmap: bytes) -> Filter:
    return Filter(bitmap)


def term_counts(texts: DataFrame, candidates: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, n_t): different texts with the term anywhere, of all words that may be candidates.

    ``copies`` (digest, n, low): each different text, its rows and smallest identifier. Texts that a filter has for single are counted in
    their task; of the others, rows that a second filter may have for that with the smallest identifier send their terms, once a text.
    """
    context = texts.sparkSession.sparkContext
    first = F.concat_ws(":", F.hex("digest"), F.col("low").cast("string"))
    shared = context.broadcast((bitmap_of(candidates, "term"), bitmap_of(copies.where("n > 1").select(F.hex("digest").alias("digest")), "digest"), bitmap_of(copies.select(first.alias("first")), "first")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, copied, reps), total, again = map(_filter, shared.value), Counter(), {}
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                digest = digest_of(text)
                name = digest.hex().upper()
                single = not copied.has(name.encode())
                if single or reps.has((name if doc_id is None else f"{name}:{doc_id}").encode()):
                    words = filter(known.__getitem__, set(text.encode().translate(TERM_BYTES).split()))
                    if single:
                        total.update(words)
                    else:
                        again[digest] = [w.decode() for w in words]
            if len(total) + sum(map(len, again.values())) > CACHE_WORDS:
                yield emit(total, again)
                total, again = Counter(), {}
        yield emit(total, again)

    def emit(total: Counter, again: dict[bytes, list[str]]) -> pa.RecordBatch:
        n, m = len(total), len(again)
        columns = [pa.array([*(w.decode() for w in total), *[None] * m], pa.string()), pa.array([*[None] * n, *again], pa.binary()), pa.array([*total.values(), *[1] * m], pa.int64()), pa.array([*[None] * n, *again.values()], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "digest", "n", "terms"])

    found = texts.select("doc_id", "text").mapInArrow(lean(count), "term string, digest binary, n long, terms array<string>")
    # A row is a term's number in a task, or the terms of a text; the latter count once.
    each = found.groupBy("term", "digest").agg(F.sum("n").alias("n"), F.first("terms").alias("terms"))
    rows = each.select(F.explode(F.when(F.col("digest").isNull(), F.array("term")).otherwise(F.col("terms"))).alias("term"), F.when(F.col("digest").isNull(), F.col("n")).otherwise(1).alias("n"))
    return rows.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(base: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, discount: float = DISCOUNT) -> DataFrame:
    """(term, disclosure): the terms that disclose at least ``threshold`` of some entity, and the most that they disclose."""
    copies = written(base.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "copies")
    n = copies.count()
    once = base.where(F.size("entities") > 0).groupBy("digest").agg(F.first("near").alias("near"), F.first("entities").alias("entities"))
    once = written(once.select("near", "entities"), "once")
    near = once.select(F.explode("near").alias("x")).select("x.entity", "x.term").groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    of_entity = once.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    candidates = written(near.join(of_entity, "entity"), "candidates")
    counts = term_counts(texts, candidates, copies)
    mutual = F.log((F.col("n_te") - F.lit(discount)) * F.lit(float(n)) / (F.col("n_t") * F.col("n_e")))
    share = F.when(F.col("n_e") < n, mutual / F.log(F.lit(float(n)) / F.col("n_e"))).otherwise(F.lit(0.0))
    found = candidates.join(counts, "term").withColumn("disclosure", share)
    return found.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= threshold)


TERM_SPANS = "digest binary, term string, starts array<long>, ends array<long>"


def term_places(text: str, known) -> dict[bytes, list[tuple[int, int]]]:
    """Places, in code points and outside base spans, of the words that ``known`` has."""
    raw = text.encode()
    lowered = raw.translate(TERM_BYTES)
    if not any(map(known.__getitem__, terms_of(list(set(lowered.split()))))):
        return {}
    blank = masked(text, base_spans(text)).encode().translate(TERM_BYTES)
    word = np.frombuffer(blank, np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    before = np.concatenate([[0], np.cumsum((np.frombuffer(blank, np.uint8) & 0xC0) != 0x80)])
    out: dict[bytes, list[tuple[int, int]]] = {}
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= LEAST_BYTES and known[w := blank[a:b]] and not w.isdigit():
            out.setdefault(w, []).append((int(before[a]), int(before[b])))
    return out


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(digest, spans): of each different text with disclosing terms, where they stand (start, end, term, disclosure)."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap_of(terms, "term"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _filter(shared.value)
        for batch in batches:
            rows = {}
            for text in batch.column(0):
                text = text.as_py()
                for term, places in term_places(text, known).items():
                    rows[digest_of(text), term.decode()] = places
            columns = [[k[0] for k in rows], [k[1] for k in rows], [[a for a, _ in p] for p in rows.values()], [[b for _, b in p] for p in rows.values()]]
            kinds = [pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "term", "starts", "ends"])

    places = texts.select("text").mapInArrow(lean(locate), TERM_SPANS).dropDuplicates(["digest", "term"]).join(terms, "term")
    rows = places.select("digest", F.explode(F.arrays_zip("starts", "ends")).alias("p"), "term", "disclosure")
    return rows.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct(F.col("p.starts").alias("start"), F.col("p.ends").alias("end"), "term", "disclosure"))).alias("terms"))


def find(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans as kind:start:end), terms (start, end, term, disclosure)."""
    texts = texts_of(docs, id_col, text_col)
    base = written(texts.mapInArrow(lean(_base), BASE), "entities")
    terms = written(disclosing(base, texts, threshold), "terms")
    return base.join(written(term_spans(texts, terms), "spans"), "digest", "left").drop("digest", "near", "entities")


def sanitise_text(text: str, terms: list[tuple[int, int, str, float]], removal: float = REMOVAL) -> str:
    """Entities give way to their kind; disclosing terms to theirs, or to nothing."""
    marks = [(a, b, f"[{k}]") for k, a, b in base_spans(text)]
    marks += [(a, b, "" if d >= removal else "[number]" if t[0].isdigit() else "[word]") for a, b, t, d in terms]
    out, at = [], 0
    for a, b, new in sorted(marks):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, threshold: float = THRESHOLD, removal: float = REMOVAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised texts; null stays null, other columns stay whatever their names.

    Only texts in which a filter may have a disclosing term meet their spans in a join.
    """
    texts = texts_of(docs, id_col, text_col)
    base = written(texts.mapInArrow(lean(_base), BASE), "entities")
    spans = written(term_spans(texts, written(disclosing(base, texts, threshold), "terms")), "spans")
    bits = bits_for(spans.count())
    own = F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256))
    flagged = marked(packed(docs, digest=own), bitmap(spans, "digest", bits), F.col("digest"), "may", bits)
    named = spans.select(F.col("digest").alias("__digest"), "terms")
    doubtful = flagged.where("may").join(named, F.col("digest") == F.col("__digest"), "left").select("row", "terms")
    every = flagged.where("NOT may").select("row", F.lit(None).cast(spans.schema["terms"].dataType).alias("terms")).unionByName(doubtful)
    names = docs.columns
    at, last = names.index(text_col), "terms" + "_" * max(map(len, names))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [[(x["start"], x["end"], x["term"], x["disclosure"]) for x in m or ()] for m in batch.column(len(names)).to_pylist()]
            new = [None if t is None else sanitise_text(t, m, removal) for t, m in zip(batch.column(at).to_pylist(), marks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return every.select("row.*", F.col("terms").alias(last)).mapInArrow(lean(clean), docs.schema)


def information(n: int, n_e: int, n_t: int, n_te: int, discount: float = DISCOUNT) -> float:
    """Share of an entity's information that a term discloses."""
    return math.log((n_te - discount) * n / (n_t * n_e)) / math.log(n / n_e) if n_e < n else 0.0
