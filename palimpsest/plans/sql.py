"""DuckDB SQL of the registered queries, from the same fixed values."""

from __future__ import annotations

from ..functions import fixed, vectors
from ..operators import extraction


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else f"{float(v)!r}::DOUBLE" for v in values) + "]"


W = r"[\p{L}\p{N}_]"
PUNCT = q(fixed.PUNCTUATION)
#: RE2 has no lookaround; leftmost matches of whole words start and end alike without.
RELATION = rf"(?i)({W}+(?:\s+{W}+){{0,3}}?)\s+({'|'.join(fixed.RELATION_VERBS)})\s+({W}+)"
HAS = rf"(?i)({W}+(?:\s+{W}+){{0,2}}?)\s+(?:has|have|had)\s+({W}+)"
IS = rf"(?i)({W}+(?:\s+{W}+){{0,2}}?)\s+is\s+(?:(?:a|an|the)\s+)?({W}+)"

TOKENS = "list_filter(string_split_regex({}, '\\s+'), lambda t: t <> '')"


def tokens(x: str) -> str:
    return TOKENS.format(x)


def marked(x: str) -> str:
    """Each word between two control characters: RE2 has no lookaround, and its word boundaries know ASCII only."""
    return f"regexp_replace({x}, '({W}+)', chr(1) || '\\1' || chr(2), 'g')"


def unmarked(x: str) -> str:
    return f"translate({x}, chr(1) || chr(2), '')"


#: White space of all scripts.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NAMES = rf"\x01[A-Z][a-z]+\x02(?:{WHITE}+\x01[A-Z][a-z]+\x02)*"


def answer_tokens(x: str) -> str:
    bare = f"regexp_replace({unmarked(f"regexp_replace({marked(f'lower({x})')}, '\\x01(a|an|the)\\x02', ' ', 'g')")}, '[^\\p{{L}}\\p{{N}}_\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', '', 'g')"
    return f"list_filter(string_split_regex({bare}, '{WHITE}+'), lambda t: t <> '')"


def phrase(x: str) -> str:
    return f"trim(lower(trim({x}, ' ' || chr(9) || chr(10) || chr(13))), {PUNCT})"


def is_concept(x: str) -> str:
    return f"(length({x}) >= 2 AND len(list_filter(string_split_regex({x}, '\\s+'), lambda w: regexp_full_match(w, '\\p{{L}}{{2,}}'))) > 0)"


def estimate(x: str) -> str:
    return f"greatest(1, floor(len({tokens(x)}) * 1.1::DOUBLE)::INT)"


def hash31(x: str) -> str:
    return f"(('0x' || right(md5({x}), 8))::BIGINT & 2147483647)"


def entity_id(x: str) -> str:
    return f"'e_' || substr(md5(lower(trim({x}))), 1, 12)"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


PAGES = f"""
words AS (SELECT doc_id, {tokens("text")} AS ts FROM documents),
stream AS (SELECT token, row_number() OVER (ORDER BY doc_id, i) - 1 AS place FROM (SELECT doc_id, unnest(ts) AS token, unnest(range(1, len(ts) + 1)) AS i FROM words)),
pages_of AS (SELECT place // {fixed.PAGE_SIZE} AS page_seq, string_agg(token, ' ' ORDER BY place) AS text, count(*) AS token_count FROM stream GROUP BY 1)"""

VERB_TRIPLES = f"""
sents AS (SELECT page_seq, sentence, i - 1 AS s FROM (SELECT page_seq, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_seq, regexp_extract_all(text, '[^.!?]+[.!?]') AS s FROM pages_of)) WHERE len({tokens("sentence")}) <= 30),
verbs AS (SELECT unnest({listed(fixed.VERBS)}) AS verb, unnest(range(0, {len(fixed.VERBS)})) AS v),
halves AS (SELECT page_seq, s * 100 + v AS ord, verb, {phrase("substr(sentence, 1, place - 1)")} AS l, {phrase("substr(sentence, place + length(verb) + 2)")} AS r
  FROM (SELECT *, instr(sentence, ' ' || verb || ' ') AS place FROM sents, verbs) WHERE place > 0),
sides AS (SELECT page_seq, ord, verb AS predicate,
    CASE WHEN list_contains({listed(fixed.ARTICLES)}, {tokens("l")}[1]) THEN array_to_string({tokens("l")}[2:], ' ') ELSE l END AS subject,
    rtrim(CASE WHEN len({tokens("r")}) > 5 THEN array_to_string({tokens("r")}[1:5], ' ') ELSE r END, {q(fixed.TRAILING)}) AS object FROM halves),
verb_rows AS (SELECT * FROM sides WHERE {is_concept("subject")} AND {is_concept("object")} AND NOT list_contains({listed(fixed.ARTICLES)}, subject) AND NOT list_contains({listed(fixed.ARTICLES)}, object))"""

OF = q(extraction.OF_PATTERN)
OF_TRIPLES = f"""
of_found AS (SELECT page_seq, regexp_extract_all(text, {OF}, 1) AS a, regexp_extract_all(text, {OF}, 2) AS b FROM pages_of),
of_split AS (SELECT page_seq, (1::BIGINT << 40) + i - 1 AS ord, {phrase("b[i]")} AS subject, 'has' AS predicate, {phrase("a[i]")} AS object FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM of_found)),
of_rows AS (SELECT * FROM of_split WHERE {is_concept("subject")} AND {is_concept("object")})"""

TRIPLES = f"""{PAGES},{VERB_TRIPLES},{OF_TRIPLES},
triples AS MATERIALIZED (SELECT page_seq, subject, predicate, object, min(ord) AS ord FROM (SELECT page_seq, subject, predicate, object, ord FROM verb_rows UNION ALL SELECT page_seq, subject, predicate, object, ord FROM of_rows) GROUP BY ALL)"""

GRAPH = f"""{TRIPLES},
slots AS (SELECT page_seq, ord, 0 AS slot, subject AS concept FROM triples UNION ALL SELECT page_seq, ord, 1, predicate FROM triples UNION ALL SELECT page_seq, ord, 2, object FROM triples),
concepts AS MATERIALIZED (SELECT concept, row_number() OVER (ORDER BY min((page_seq, ord, slot))) - 1 AS idx FROM slots GROUP BY concept),
edges AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT subject AS src, object AS dst, 1.0::DOUBLE AS w FROM triples UNION ALL SELECT subject, predicate, 0.5::DOUBLE FROM triples UNION ALL SELECT predicate, object, 0.5::DOUBLE FROM triples) GROUP BY ALL),
sym AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM edges UNION ALL SELECT dst, src, w FROM edges WHERE src <> dst) GROUP BY ALL),
degrees AS MATERIALIZED (SELECT src AS concept, sum(w) AS degree FROM sym GROUP BY 1),
postings AS MATERIALIZED (SELECT DISTINCT concept, page_seq + 1 AS b1_no FROM slots)"""

LAPLACIAN = """,
lap AS MATERIALIZED (SELECT src, dst, sum(v) AS v FROM (
  SELECT src, dst, -w / sqrt(a.degree * b.degree) AS v FROM sym JOIN degrees a ON a.concept = src JOIN degrees b ON b.concept = dst
  UNION ALL SELECT concept, concept, 1.0::DOUBLE FROM degrees) GROUP BY ALL)"""


def diffusion(active: str, steps: int = 3) -> str:
    """CTEs rho0 .. rho and the last, for one key; ``active``: a condition on the concept."""
    out = f",\nrho0 AS MATERIALIZED (SELECT concept, 1.0::DOUBLE / (SELECT count(*) FROM concepts) AS rho FROM concepts)"
    for k in range(steps):
        out += f""",
rho{k + 1} AS MATERIALIZED (SELECT n.concept, greatest(0.0::DOUBLE, n.rho + {fixed.ALPHA}::DOUBLE * coalesce(f.flow, 0) + {fixed.BETA}::DOUBLE * (CASE WHEN {active} THEN 1.0 ELSE 0.0 END)::DOUBLE * n.rho - {fixed.GAMMA}::DOUBLE * n.rho) AS rho
  FROM rho{k} n LEFT JOIN (SELECT src, sum(v * rho) AS flow FROM lap JOIN rho{k} ON concept = dst GROUP BY src) f ON f.src = n.concept)"""
    return out + f",\nrho AS MATERIALIZED (SELECT concept, rho / (SELECT sum(rho) FROM rho{steps}) AS rho FROM rho{steps})"


def terms(source: str, key: str) -> str:
    """CTEs ending in terms(key, pos, term)."""
    return f"""
raw_terms AS (SELECT {key}, list_transform(list_filter({tokens("lower(text)")}, lambda t: length(t) >= {fixed.LEAST_TERM}), lambda t: trim(t, {PUNCT})) AS ts FROM {source}),
seen_terms AS (SELECT {key}, term, min(i) AS first FROM (SELECT {key}, unnest(ts) AS term, unnest(range(1, len(ts) + 1)) AS i FROM raw_terms) GROUP BY ALL),
terms AS (SELECT {key}, term, pos FROM (SELECT {key}, term, row_number() OVER (PARTITION BY {key} ORDER BY first) AS pos FROM seen_terms) WHERE pos <= {fixed.MAX_TERMS})"""


def dims(d: int) -> str:
    return f"dims AS (SELECT unnest(range(0, {d})) AS j, unnest({listed(vectors.frequencies(d))}) AS w, unnest({listed(vectors.phases(d))}) AS b)"


def buckets(d: int, m: int, w: float = 10.0, seed: int = 42) -> str:
    a, b = vectors.lsh_planes(d, m, w, seed)
    parts = [f"floor(({dot('embedding', listed(row))} + {float(off)!r}::DOUBLE) / {w!r}::DOUBLE)::INT::VARCHAR" for row, off in zip(a, b, strict=True)]
    return " || ',' || ".join(parts)
