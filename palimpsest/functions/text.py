"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WORD = r"[\p{L}\p{N}_]"


def quoted(text: str) -> str:
    """As a SQL string literal, in Spark and DuckDB alike."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Runs of characters other than white space; those of printed ASCII are told first, by one comparison."""
    return F.filter(F.split(text, f"(?U)[[^!-~]&&{fixed.WHITE}]+"), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """Words times 1.1, rounded down; at least 1."""
    return F.greatest(F.lit(1), F.floor(F.size(tokens(text)) * F.lit(1.1)).cast("int"))


def strip(text: Column, chars: str = fixed.PUNCTUATION) -> Column:
    return F.btrim(text, F.lit(chars))


def strip_white(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{fixed.WHITE}+|{fixed.WHITE}+$", "")


def embedding_terms(text: Column) -> Column:
    """Distinct lower-case words of at least three characters, punctuation stripped afterwards; the first fifty."""
    long = F.filter(tokens(F.lower(text)), lambda t: F.length(t) >= fixed.LEAST_TERM)
    return F.slice(F.array_distinct(F.transform(long, lambda t: strip(t))), 1, fixed.MAX_TERMS)


def phrase(text: Column) -> Column:
    """Lower case, without white space and punctuation at the ends."""
    return strip(F.lower(strip_white(text)))


def is_concept(text: Column) -> Column:
    """At least two characters, and a word of at least two letters and nothing else."""
    other = f"[^{fixed.WHITE[1:-1]}]"
    return (F.length(text) >= 2) & text.rlike(rf"(?U)(?<!{other})\p{{L}}{{2,}}+(?!{other})")


def sentences(text: Column) -> Column:
    """Up to a terminator each; what follows the last one is dropped. None begins within another: a long text is looked at once."""
    return F.regexp_extract_all(text, F.lit(r"(?<![^.!?])[^.!?]++[.!?]"), F.lit(0))


def beacon_id(prefix: str, n: Column) -> Column:
    return F.format_string(prefix + "_%07d", n)


def short_md5(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12))


def entity_key(name: Column) -> Column:
    return short_md5("e", strip_white(F.lower(name)))


def query_tokens(query: Column) -> Column:
    return tokens(F.lower(query))


def raw_entities(query: Column) -> Column:
    """Distinct raw tokens of at least four characters that are not stop words."""
    stop = words(*fixed.STOP_RAW)
    return F.array_distinct(F.filter(query_tokens(query), lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t)))


def clean_entities(query: Column, stop: list[str]) -> Column:
    """Distinct stripped tokens of at least three characters that are not in ``stop``."""
    listed = words(*stop)
    return F.array_distinct(F.filter(F.transform(query_tokens(query), lambda t: strip(t)), lambda t: (F.length(t) >= 3) & ~F.array_contains(listed, t)))


def contains_any(text: Column, parts: Column) -> Column:
    lower = F.lower(text)
    return F.exists(parts, lambda p: F.contains(lower, p))


def normalised_answer(text: Column) -> Column:
    """Lower case, without articles and punctuation, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), rf"(?<!{WORD})(a|an|the)(?!{WORD})", " "), rf"(?U)[^\p{{L}}\p{{N}}_\s\x1c-\x1f]", "")
    return F.array_join(tokens(bare), " ")
