"""Triples, entities, relations and facts of texts, by string rules in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

#: Texts longer than this are refused by ``triples`` if it is strict.
MAX_CHARS = 1_000_000
W = text.WORD
#: The same matches without going back into a word or a gap: what has to follow is of another kind.
OF_ONCE = rf"(?i)(?<!{W})({W}++(?:\s++{W}++){{0,2}})\s++of\s++({W}++(?:\s++{W}++){{0,2}})"
OF_PATTERN = rf"(?i)({W}+(?:\s+{W}+){{0,2}})\s+of\s+({W}+(?:\s+{W}+){{0,2}})"
#: Boundaries by letters and digits of any script: of "Chloé" no part is a name.
ENTITY_PATTERN = rf"(?U)(?<!{W})([A-Z][a-z]+(?:{fixed.WHITE}+[A-Z][a-z]+)*)(?!{W})"
RELATION_PATTERN = rf"(?i)(?<!{W})({W}+(?:\s+{W}+){{0,3}}?)\s+({'|'.join(fixed.RELATION_VERBS)})\s+({W}+)(?!{W})"
HAS_PATTERN = rf"(?i)(?<!{W})({W}+(?:\s+{W}+){{0,2}}?)\s+(?:has|have|had)\s+({W}+)(?!{W})"
IS_PATTERN = rf"(?i)(?<!{W})({W}+(?:\s+{W}+){{0,2}}?)\s+is\s+(?:(?:a|an|the)\s+)?({W}+)(?!{W})"
#: Takes an article off the front of a word, too.
STRICT_IS_PATTERN = rf"(?i)(?<!{W})({W}+(?:\s+{W}+){{0,2}}?)\s+is\s+(?:a|an|the)?\s*({W}+)(?!{W})"


def _groups(source: Column, pattern: str, *groups: int) -> Column:
    """An array of structs of the pattern's groups g1, g2, ...; the text is searched once, then only its matches."""
    found = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(f"g{g}") for g in groups]))


def verb_triples(pages: DataFrame) -> DataFrame:
    """(page_seq, ord, subject, predicate, object): each sentence of up to thirty words split once at each verb.

    The subject loses one leading article or pronoun, the object all but its first five words.
    """
    articles = text.words(*fixed.ARTICLES)
    # Verbs are looked for by compiled code, before words are counted: most sentences have none.
    holds = [F.contains(F.col("sentence"), F.lit(f" {verb} ")) for verb in fixed.VERBS]
    rows = pages.select("page_seq", F.posexplode(text.sentences(F.col("text"))).alias("s", "sentence")).where(reduce(Column.__or__, holds)).where(F.size(text.tokens(F.col("sentence"))) <= 30)
    hits = F.array_compact(F.array(*[F.when(held, F.struct(F.lit(i).alias("v"), F.lit(verb).alias("verb"))) for i, (verb, held) in enumerate(zip(fixed.VERBS, holds, strict=True))]))
    split = rows.select("page_seq", "s", "sentence", F.explode(hits).alias("h")).select("page_seq", "s", F.col("h.v").alias("v"), F.col("h.verb").alias("predicate"), "sentence")
    at = F.expr("instr(sentence, concat(' ', predicate, ' '))")
    left = text.phrase(F.col("sentence").substr(F.lit(1), at - 1))
    right = text.phrase(F.col("sentence").substr(at + F.length("predicate") + 2, F.length("sentence")))
    split = split.select("page_seq", "s", "v", "predicate", left.alias("left"), right.alias("right")).withColumn("lt", text.tokens(F.col("left"))).withColumn("rt", text.tokens(F.col("right")))
    subject = F.when(F.array_contains(articles, F.get("lt", F.lit(0))), F.array_join(F.slice("lt", 2, 1_000), " ")).otherwise(F.col("left"))
    obj = F.rtrim(F.when(F.size("rt") > 5, F.array_join(F.slice("rt", 1, 5), " ")).otherwise(F.col("right")), F.lit(fixed.TRAILING))
    out = split.select("page_seq", (F.col("s") * 100 + F.col("v")).cast("long").alias("ord"), subject.alias("subject"), "predicate", obj.alias("object"))
    for side in ("subject", "object"):
        out = out.where(text.is_concept(F.col(side)) & ~F.array_contains(articles, F.col(side)))
    return out


def of_triples(pages: DataFrame) -> DataFrame:
    """(page_seq, ord, subject, predicate, object): "X of Y" as (Y, has, X), one to three words each side."""
    # No match begins within a word; said so, a long word is looked at once.
    rows = pages.select("page_seq", F.posexplode(_groups(F.col("text"), OF_ONCE, 1, 2)).alias("m", "g"))
    out = rows.select("page_seq", (F.lit(1 << 40) + F.col("m")).alias("ord"), text.phrase(F.col("g.g2")).alias("subject"), F.lit("has").alias("predicate"), text.phrase(F.col("g.g1")).alias("object"))
    return out.where(text.is_concept(F.col("subject")) & text.is_concept(F.col("object")))


def triples(pages: DataFrame, strict: bool = False) -> DataFrame:
    """(page_seq, ord, subject, predicate, object): both kinds, each triple once a page, at its first place.

    ``strict``: the job fails at a text of more than MAX_CHARS.
    """
    ok = pages.where(F.expr(f"assert_true(length(text) <= {MAX_CHARS}, 'text too long') IS NULL")) if strict else pages
    every = verb_triples(ok).unionByName(of_triples(ok))
    return every.groupBy("page_seq", "subject", "predicate", "object").agg(F.min("ord").alias("ord"))


#: Extractors by name: each makes triples (page_seq, ord, subject, predicate, object) of pages.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"rules": triples}


def register(name: str, extractor: Callable[[DataFrame], DataFrame]) -> None:
    EXTRACTORS[name] = extractor


def extract(pages: DataFrame, name: str = "rules") -> DataFrame:
    if name not in EXTRACTORS:
        raise ValueError(f"no extractor {name}; there are {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name](pages).select("page_seq", "ord", "subject", "predicate", "object")


def of_function(function: Callable[[str], list[tuple[str, str, str]]]) -> Callable[[DataFrame], DataFrame]:
    """An extractor of a Python function from a text to its triples, run on batches of pages; each triple once a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page, i, *t) for page, text_ in zip(batch.page_seq, batch.text, strict=True) for i, t in enumerate(dict.fromkeys(map(tuple, function(text_ or ""))))]
            yield pd.DataFrame(rows, columns=["page_seq", "ord", "subject", "predicate", "object"])

    return lambda pages: pages.select("page_seq", "text").mapInPandas(run, "page_seq long, ord long, subject string, predicate string, object string")


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, name): capitalised words and phrases, one row a mention."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY_PATTERN), F.lit(1))).alias("ord", "name"))
    return rows.where(F.length("name") >= 2)


def relations(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, subject, predicate, object) in lower case, one row a mention; sides that are articles or pronouns are out."""
    articles = text.words(*fixed.ARTICLES)
    rows = docs.select("doc_id", F.posexplode(_groups(F.col("text"), RELATION_PATTERN, 1, 2, 3)).alias("ord", "g"))
    out = rows.select("doc_id", "ord", *[F.lower(text.strip_white(F.col(f"g.g{i}"))).alias(n) for i, n in ((1, "subject"), (2, "predicate"), (3, "object"))])
    return out.where(~F.array_contains(articles, F.col("subject")) & ~F.array_contains(articles, F.col("object")))


def facts(docs: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, ord, entity, attribute, value): "X has Y", then "X is Y", both of at least two characters."""
    parts = []
    for k, pattern in enumerate((HAS_PATTERN, STRICT_IS_PATTERN if strict else IS_PATTERN)):
        rows = docs.select("doc_id", F.posexplode(_groups(F.col("text"), pattern, 1, 2)).alias("m", "g"))
        parts.append(rows.select("doc_id", (F.lit(k << 40) + F.col("m")).alias("ord"), *[F.lower(text.strip_white(F.col(f"g.g{i}"))).alias(n) for i, n in ((1, "entity"), (2, "value"))]))
    out = parts[0].unionByName(parts[1]).where((F.length("entity") >= 2) & (F.length("value") >= 2))
    return out.select("doc_id", "ord", "entity", F.lit("attribute").alias("attribute"), "value")


def extraction_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_entities, n_relations, n_facts) for every document; zeros for blank ones."""
    parts = [d.groupBy("doc_id").agg(F.count("*").alias(n)) for d, n in ((entities(docs), "n_entities"), (relations(docs), "n_relations"), (facts(docs), "n_facts"))]
    out = docs.select("doc_id")
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return out.na.fill(0)
