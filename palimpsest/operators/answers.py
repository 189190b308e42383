"""A short answer to a question from the sentences of retrieved pages, in column expressions.

The sentence that holds most of the question's content words is searched for what the kind of question asks for: a name, a place after a
preposition, a year, an amount, a yes or no, or what stands after a copula. What is named in the question itself is no answer.
Without any, the first words of that sentence which the question doesn't have are the answer; empty without such a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed, text

W = text.WORD
#: Words of the answer at most.
MOST_WORDS, FALLBACK_WORDS = 10, 8
#: What makes a question one of a kind, in this order; anything else asks for a thing.
KINDS = [
    ("person", rf"(?i)(?<!{W})(who|whom|whose)(?!{W})"),
    ("place", rf"(?i)(?<!{W})(where|which (city|country|town|place))(?!{W})"),
    ("time", rf"(?i)(?<!{W})(when|(what|which) (year|date|century))(?!{W})"),
    ("amount", rf"(?i)(?<!{W})(how (many|much|old|long|tall|far))(?!{W})"),
    ("polar", rf"(?i)^\s*(is|are|was|were|do|does|did|has|have|had|can|could)(?!{W})"),
]
CAPITAL = r"\p{Lu}\p{L}+"
FULL_NAME = rf"(?<!{W}){CAPITAL}(?: {CAPITAL})+(?!{W})"
PLACE = rf"(?<!{W})(?:in|at|near|from|to) (?:the )?({CAPITAL}(?:,? {CAPITAL})*)"
YEAR = r"(?<![\d,.])([12]\d{3})(?![\d,])"
AMOUNT = r"(?<![\d.,])\d+(?:[.,]\d+)*(?: (?:hundred|thousand|million|billion|percent))?"
AFTER_COPULA = rf"(?i)(?<!{W})(?:is|are|was|were|means)(?!{W}) (?:(?:a|an|the) )?([^,;:()]+)"
NEGATION = rf"(?i)(?<!{W})(not|no|never|none|neither)(?!{W})|n't(?!{W})"


def kind_of(question: Column) -> Column:
    out = F.lit("thing")
    for kind, pattern in reversed(KINDS):
        out = F.when(question.rlike(pattern), kind).otherwise(out)
    return out


def content_words(question: Column) -> Column:
    return text.clean_entities(question, fixed.STOP_CLEAN)


def _sentences(pages: Column) -> Column:
    """Split after a terminator that is followed by white space; squeezed to single spaces, without the terminator."""
    split = F.split(F.array_join(pages, " "), r"(?<=[.!?])\s+")
    return F.transform(split, lambda s: F.rtrim(F.array_join(text.tokens(s), " "), F.lit(".!?")))


def _own_words(sentence: Column) -> Column:
    return F.filter(F.transform(text.tokens(F.lower(sentence)), lambda t: text.strip(t)), lambda t: t != "")


def best_sentence(pages: Column, question: Column) -> Column:
    """The earliest of the sentences with the most content words of the question; null if none has any."""
    wanted = content_words(question)
    scored = F.transform(_sentences(pages), lambda s, i: F.struct(F.size(F.array_intersect(wanted, _own_words(s))).alias("score"), (-i).alias("place"), s.alias("sentence")))
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["sentence"])


def _first(sentence: Column, pattern: str, group: int, question: Column) -> Column:
    """The first match that the question doesn't hold; null without one."""
    found = F.filter(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(group)), lambda x: ~F.contains(F.lower(question), F.lower(x)))
    return F.get(found, F.lit(0))


def _cut(value: Column, most: int) -> Column:
    return F.array_join(F.slice(text.tokens(value), 1, most), " ")


def answers(pages: Column, question: Column) -> Column:
    """Of an array of page texts and a question; nulls count as empty."""
    pages, question = F.coalesce(pages, F.array().cast("array<string>")), F.coalesce(question, F.lit(""))
    s, kind = best_sentence(pages, question), kind_of(question)
    # A lone capitalised word that begins the sentence may be capitalised for that only.
    name = F.coalesce(_first(s, FULL_NAME, 0, question), _first(s, rf"(?<=[^.!?] )({CAPITAL})(?!{W})", 1, question))
    missing = F.size(F.array_except(content_words(question), _own_words(s)))
    polar = F.when(s.rlike(NEGATION), "no").when(missing == 0, "yes")
    thing = F.nullif(_cut(F.regexp_extract(s, AFTER_COPULA, 1), MOST_WORDS), F.lit(""))
    found = F.when(kind == "person", name).when(kind == "place", _first(s, PLACE, 1, question)).when(kind == "time", _first(s, YEAR, 1, question))
    found = found.when(kind == "amount", _first(s, AMOUNT, 0, question)).when(kind == "polar", polar).otherwise(thing)
    asked = _own_words(question)
    rest = F.array_join(F.slice(F.filter(text.tokens(s), lambda t: ~F.array_contains(asked, text.strip(F.lower(t)))), 1, FALLBACK_WORDS), " ")
    return F.coalesce(found, rest, F.lit(""))


def prompt(pages: Column, question: Column, most: int = 5) -> Column:
    """What a language model would be asked: numbered pages, then the question. No model is called here."""
    numbered = F.transform(F.slice(pages, 1, most), lambda p, i: F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("] "), p))
    head = F.lit("Answer with a span of the pages and nothing else; yes or no if the question asks for that.\n\n")
    return F.concat(head, F.array_join(numbered, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))
