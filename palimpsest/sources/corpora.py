"""Made-up corpora, as DataFrames of (doc_id, text) computed from positions."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens as tokens_of

TOPICS = ["river delta", "tidal engine", "paper lantern", "glass archive", "copper signal", "winter harbour", "salt library", "silent orchard"]


def cross_references(spark: SparkSession, n_tokens: int, distance: int, line: int = 50) -> DataFrame:
    """Lines of filler; one in so many defines a topic, and ``distance`` tokens later another refers back to it."""
    lines, apart = max(1, n_tokens // line), max(1, distance // line)
    topic = F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.col("id") % len(TOPICS) + 1).cast("int"))
    filler = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(line - 20)), lambda i: F.concat(F.lit("filler_"), ((F.col("id") * line + i) % 9973).cast("string"))), " ")
    lead = F.when(F.col("id") < len(TOPICS), F.concat(F.lit("The "), topic, F.lit(" is a kept record of the place . "))).when((F.col("id") >= apart) & (F.col("id") < apart + len(TOPICS)), F.concat(F.lit("Recall that the "), F.element_at(F.array(*[F.lit(t) for t in TOPICS]), ((F.col("id") - apart) % len(TOPICS) + 1).cast("int")), F.lit(" was kept . "))).otherwise("")
    return spark.range(lines).select(F.col("id").alias("doc_id"), F.concat(lead, filler).alias("text"))


def repeated_concepts(spark: SparkSession, n_tokens: int, every: int = 500, referred: int = 100, line: int = 100) -> DataFrame:
    """A topic every 500 tokens, a reference to one every 100, filler between."""
    names = F.array(*[F.lit(t) for t in TOPICS])
    topic = F.element_at(names, (F.floor(F.col("id") * line / every) % len(TOPICS) + 1).cast("int"))
    lead = F.when((F.col("id") * line) % every == 0, topic).when((F.col("id") * line) % referred == 0, F.concat(F.lit("recall that the "), topic)).otherwise("")
    filler = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(line - 8)), lambda i: F.concat(F.lit("token_"), (F.col("id") * line + i).cast("string"))), " ")
    return spark.range(max(1, n_tokens // line)).select(F.col("id").alias("doc_id"), F.concat_ws(" ", lead, filler).alias("text"))


def needles(spark: SparkSession, n: int, filler: int, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """(corpus, needles): statements spread evenly through filler; each {id, text, subject, answer}."""
    draw = random.Random(seed)
    made = [{"id": i, "subject": f"the keeper of gate {i}", "answer": f"warden {draw.randrange(10**6):06d}"} for i in range(n)]
    for needle in made:
        needle["text"] = f"{needle['subject'].capitalize()} is {needle['answer']}."
    words = [w for t in TOPICS for w in t.split()]
    rows = []
    for i in range(n + 1):
        rows.append((2 * i, " ".join(draw.choice(words) for _ in range(filler // (n + 1)))))
        if i < n:
            rows.append((2 * i + 1, made[i]["text"]))
    return spark.createDataFrame(rows, "doc_id long, text string"), made


def hops(spark: SparkSession, chains: int, length: int, filler: int, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """(corpus, chains): links of each chain lie apart; the answer is the end of the chain."""
    draw = random.Random(seed)
    words = [w for t in TOPICS for w in t.split()]
    links, made = [], []
    for c in range(chains):
        names = [f"Node{c}x{i}" for i in range(length + 1)]
        steps = [{"subject": a, "object": b, "sentence": f"{a} leads to {b}."} for a, b in zip(names, names[1:], strict=False)]
        made.append({"chain_id": c, "hops": steps, "answer": names[-1]})
        links += steps
    draw.shuffle(links)
    rows = []
    for i, link in enumerate(links):
        rows += [(2 * i, " ".join(draw.choice(words) for _ in range(filler // len(links)))), (2 * i + 1, link["sentence"])]
    return spark.createDataFrame(rows, "doc_id long, text string"), made


def adversarial(spark: SparkSession, n: int, filler: int, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """(corpus, facts): each true statement has a false one about a namesake elsewhere."""
    draw = random.Random(seed)
    words = [w for t in TOPICS for w in t.split()]
    made = [{"fact_id": i, "correct": f"The bell of Tower{i} is bronze{i}.", "distractor": f"The bell of Chapel{i} is iron{i}.", "query": f"What is the bell of Tower{i}?", "answer": f"bronze{i}", "wrong_answer": f"iron{i}"} for i in range(n)]
    said = [s for f in made for s in (f["correct"], f["distractor"])]
    draw.shuffle(said)
    rows = []
    for i, sentence in enumerate(said):
        rows += [(2 * i, " ".join(draw.choice(words) for _ in range(filler // len(said)))), (2 * i + 1, sentence)]
    return spark.createDataFrame(rows, "doc_id long, text string"), made


def multi_hop(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A local copy of a multi-hop question set: JSON, one array or a line each, of {_id, question, answer, type, level, context: [[title, [sentences]]],
    supporting_facts: [[title, number of the sentence]]}.

    questions (id, question, answer, type, level), paragraphs (id, title, text), each title once by text for ``documents`` (doc_id, title, text),
    and facts (id, title, sentence). Nothing is fetched.
    """
    raw = spark.read.schema("value string").option("wholetext", True).text(path)
    rows = "array<struct<_id:string,question:string,answer:string,type:string,level:string,context:array<array<string>>,supporting_facts:array<array<string>>>>"
    lines = F.concat(F.lit("["), F.array_join(F.filter(F.split(F.trim("value"), r"\r?\n"), lambda x: F.trim(x) != ""), ","), F.lit("]"))
    # Elements of unlike kinds come as strings; lists of sentences are parsed again.
    each = raw.select(F.explode(F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(lines), rows)).alias("q")).select("q.*").withColumnRenamed("_id", "id")
    paragraph = each.select("id", "supporting_facts", F.explode("context").alias("c")).select("id", "supporting_facts", F.get("c", F.lit(0)).alias("title"), F.from_json(F.get("c", F.lit(1)), "array<string>").alias("sentences"))
    paragraphs = paragraph.select("id", "title", F.array_join("sentences", "").alias("text"))
    documents = paragraphs.select("title", "text").distinct().select(F.xxhash64("title", "text").alias("doc_id"), "title", "text")
    named = paragraph.select("id", "title", "sentences", F.explode(F.filter("supporting_facts", lambda f: F.get(f, F.lit(0)) == F.col("title"))).alias("f"))
    facts = named.select("id", "title", F.get("sentences", F.get("f", F.lit(1)).cast("int")).alias("sentence")).where("sentence IS NOT NULL")
    return {"questions": each.select("id", "question", "answer", "type", "level"), "paragraphs": paragraphs, "documents": documents, "facts": facts}


def articles(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """(doc_id, title, text, tokens) of a local copy of encyclopaedia articles, a JSON object {id, title, text} a line; those of at least ``least`` tokens."""
    rows = spark.read.schema("id string, title string, text string").json(path)
    return rows.select(F.coalesce(F.col("id").try_cast("long"), F.xxhash64("id")).alias("doc_id"), "title", "text", F.size(tokens_of(F.col("text"))).alias("tokens")).where(F.col("tokens") >= least)


def definition_query(concept: Column) -> Column:
    """A question for a concept whose words are set apart by underscores."""
    return F.concat(F.lit("What is the definition of "), F.replace(concept, F.lit("_"), F.lit(" ")), F.lit("?"))


def cloze_queries(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(doc_id, query, answer): of ``n`` documents a sentence of 11 to 29 words, asked up to its first copula (or third word).

    Documents and sentences are chosen by hash, so the choice is the same on any number of executors.
    """
    parts = F.filter(F.transform(F.split("text", r"[.!?]+"), lambda s: F.btrim(s)), lambda s: (F.size(F.split(s, r"\s+")) > 10) & (F.size(F.split(s, r"\s+")) < 30))
    rows = docs.select("doc_id", parts.alias("s")).where(F.size("s") > 0).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
    rows = rows.select("doc_id", F.split(F.element_at("s", (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.size("s")) + 1).cast("int")), r"\s+").alias("w"))
    verbs = F.array(*[F.lit(v) for v in ("is", "was", "are", "were")])
    first = F.array_min(F.filter(F.transform("w", lambda w, i: F.when(F.array_contains(verbs, F.lower(w)) & (i + 1 < F.size("w")), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("at", F.coalesce(first, F.lit(3))).withColumn("from", F.when(first.isNotNull(), F.col("at") + 1).otherwise(F.col("at")))
    left = F.lower(F.array_join(F.slice("w", F.lit(1), F.col("at")), " "))
    return rows.select("doc_id", F.concat(F.lit("What is "), F.rtrim(left, F.lit(",")), F.lit("?")).alias("query"), F.array_join(F.slice("w", F.col("from") + 1, F.size("w")), " ").alias("answer"))


def plain_tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\s\x1c-\x1f]+", text) if t]
