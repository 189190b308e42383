"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought to canonical form: copyright lines go, case and punctuation are levelled, equivalent spellings become
one. The digest of an entire canonical text is looked up by a hash join with those of the known licences. Lines that
may be notices are entire texts of their own and are looked up likewise, each document's lines within its row. Known
texts go through the same expressions, so one definition holds for both sides; long licences are known by the digest of that form. The table of
digests has as many rows as ``license_texts`` has texts, digests and notices, and is broadcast.

Defined results: a null or empty text has no licence and the digest of the empty text; a null identifier keeps its row;
repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts
from .common import texts_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of a copyright statement; "copyright notice" and the like don't begin one. For Java and RE2 alike.
COPYRIGHT_LINE = r"(?im)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|[<\[])|©|\(c\)[ \t]|all rights reserved)[^\n]*"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A line without this is no notice: each of them has one.
MAY_BE_NOTICE = r"(?i)licen[cs]|apache|mozilla|\b(mit|bsd|isc|mpl|a?l?gpl|cc0?)\b|gplv|creative commons"


def canonical(text: Column) -> Column:
    """Words in lower case, one space between them, without copyright lines, in one spelling."""
    words = F.regexp_replace(F.translate(F.regexp_replace(text, COPYRIGHT_LINE, ""), UPPER, LOWER), NOT_WORD, "  ")
    words = F.concat(F.lit(" "), words, F.lit(" "))
    for spelling, common in license_texts.SPELLINGS.items():
        words = F.replace(words, F.lit(f" {spelling} "), F.lit(f" {common} "))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def _known(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(digest, license) of known texts."""
    values = F.array(*[F.struct(F.lit(spdx).alias("license"), F.lit(text).alias("text")) for spdx, text in rows])
    table = spark.range(1).select(F.explode(values).alias("k")).select("k.license", F.sha2(canonical(F.col("k.text")), 256).alias("digest"))
    return table.groupBy("digest").agg(F.min("license").alias("license"))


def _entire(spark: SparkSession) -> DataFrame:
    """(digest, text_license) of all known texts, those included of which the digest alone is known."""
    known = _known(spark, [*license_texts.TEXTS.items(), *license_texts.notices()])
    listed = F.array(*[F.struct(F.lit(digest).alias("digest"), F.lit(spdx).alias("license")) for spdx, digests in license_texts.DIGESTS.items() for digest in digests])
    return known.unionByName(spark.range(1).select(F.explode(listed).alias("k")).select("k.digest", "k.license")).withColumnRenamed("license", "text_license")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_license (of the entire text, or null), n_notices, notice_licenses, canonical_sha256.

    ``notice_licenses``: identifiers of lines that are notices, each once, sorted, comma-joined.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    # As many entries as there are notices: a constant of the plan, whatever the documents.
    notices = F.create_map(*[F.lit(x) for r in _known(spark, license_texts.notices()).orderBy("digest").collect() for x in (r.digest, r.license)])
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(MAY_BE_NOTICE))
    names = F.transform(lines, lambda line: F.try_element_at(notices, F.sha2(canonical(line), 256)))
    found = F.when(F.col("text").rlike(MAY_BE_NOTICE), F.filter(names, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    digested = texts.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), found.alias("found"))
    joined = digested.join(F.broadcast(_entire(spark)), "digest", "left")
    return joined.select("doc_id", "text_license", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notice_licenses"), F.col("digest").alias("canonical_sha256"))


def oracle_sql() -> str:
    """The same in DuckDB; known texts in canonical form come from the same rules."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(text: str) -> str:
        inner = f"regexp_replace(translate(regexp_replace({text}, {quoted(COPYRIGHT_LINE)}, '', 'g'), '{UPPER}', '{LOWER}'), {quoted(NOT_WORD)}, '  ', 'g')"
        inner = f"(' ' || {inner} || ' ')"
        for spelling, common in license_texts.SPELLINGS.items():
            inner = f"replace({inner}, ' {spelling} ', ' {common} ')"
        return f"trim(replace({inner}, '  ', ' '))"

    texts = ", ".join(f"({quoted(s)}, {quoted(t)}, {str(notice).lower()})" for rows, notice in ((license_texts.TEXTS.items(), False), (license_texts.notices(), True)) for s, t in rows)
    digests = ", ".join(f"({quoted(d)}, {quoted(spdx)})" for spdx, every in license_texts.DIGESTS.items() for d in every)
    return f"""
WITH listed(license, text, notice) AS (VALUES {texts}),
known AS (SELECT sha256({form("text")}) AS digest, min(license) AS license FROM listed GROUP BY 1 UNION ALL VALUES {digests}),
named AS (SELECT {form("text")} AS form, min(license) AS license FROM listed WHERE notice GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
  FROM lines JOIN named ON {form("line")} = form WHERE regexp_matches(line, {quoted(MAY_BE_NOTICE)}) GROUP BY doc_id)
SELECT d.doc_id, known.license AS text_license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notice_licenses, sha256({form("d.text")}) AS canonical_sha256
FROM d LEFT JOIN known ON sha256({form("d.text")}) = known.digest LEFT JOIN hits ON d.doc_id = hits.doc_id
"""
