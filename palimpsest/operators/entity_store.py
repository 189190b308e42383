"""Entities, relations and facts with deterministic identifiers, and what is asked of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, vectors


def entities(mentions: DataFrame) -> DataFrame:
    """(entity_id, name, frequency) of mentions (name); names are equal up to case and white space at the ends."""
    named = mentions.select(text.strip_white(F.lower("name")).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("frequency")).select(text.entity_key(F.col("name")).alias("entity_id"), "name", "frequency")


def with_properties(mentions: DataFrame) -> DataFrame:
    """(name, properties) of mentions (ord, name, key, value): the last value of each key wins."""
    last = mentions.groupBy("name", "key").agg(F.max_by("value", "ord").alias("value"))
    return last.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))


def relations(found: DataFrame) -> DataFrame:
    """(relation_id, subject_id, predicate, object_id, frequency, weight) of (subject, predicate, object, weight): counted, the largest weight kept."""
    ids = found.select(text.entity_key(F.col("subject")).alias("subject_id"), text.strip_white(F.lower("predicate")).alias("predicate"), text.entity_key(F.col("object")).alias("object_id"), "weight")
    grouped = ids.groupBy("subject_id", "predicate", "object_id").agg(F.count("*").alias("frequency"), F.max("weight").alias("weight"))
    return grouped.select(text.short_md5("r", F.col("subject_id"), F.col("predicate"), F.col("object_id")).alias("relation_id"), "*")


def facts(found: DataFrame) -> DataFrame:
    """(fact_id, entity_id, attribute, value, confidence) of (ord, entity, attribute, value, confidence): each once, the first confidence kept."""
    ids = found.select("ord", text.entity_key(F.col("entity")).alias("entity_id"), text.strip_white(F.lower("attribute")).alias("attribute"), text.strip_white("value").alias("value"), "confidence")
    grouped = ids.groupBy("entity_id", "attribute", "value").agg(F.min_by("confidence", "ord").alias("confidence"))
    return grouped.select(text.short_md5("f", F.col("entity_id"), F.col("attribute"), F.col("value")).alias("fact_id"), "*")


def all_entities(*names: DataFrame) -> DataFrame:
    """Entities named by mentions, by either side of relations, or by facts: frames with one column, name."""
    every = names[0]
    for more in names[1:]:
        every = every.unionByName(more)
    return entities(every)


def adjacency(relation_table: DataFrame, entity_table: DataFrame) -> DataFrame:
    """(src, dst, w): summed weights of relations both of whose ends are stored."""
    ids = entity_table.select("entity_id")
    both = relation_table.join(ids, relation_table.subject_id == ids.entity_id, "left_semi").join(ids, relation_table.object_id == ids.entity_id, "left_semi")
    return both.groupBy(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).agg(F.sum("weight").alias("w"))


def relations_of(relation_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Relations on either side of which a wanted entity (entity_id) stands; ``role`` tells which."""
    parts = [wanted.join(relation_table, F.col("entity_id") == F.col(side)).withColumn("role", F.lit(role)) for side, role in (("subject_id", "subject"), ("object_id", "object"))]
    return parts[0].unionByName(parts[1])


def facts_of(fact_table: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(fact_table, "entity_id")


def predicate_index(relation_table: DataFrame) -> DataFrame:
    """(predicate, relation_id): its rows are the index; lists of unbounded length are not built."""
    return relation_table.select("predicate", "relation_id")


def keep_top(table: DataFrame, n: int, *by) -> DataFrame:
    """The ``n`` rows that stay when a store is full."""
    return table.orderBy(*by).limit(n)


def statistics(docs: DataFrame, entity_table: DataFrame, relation_table: DataFrame, fact_table: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and the ratio of characters to bytes that the store counts as; 4 bytes a weight and index, and a pointer an entity."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    row = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_text_chars"))
    for df, name in ((entity_table, "total_entities"), (relation_table, "total_relations"), (fact_table, "total_facts"), (edges, "n_edges")):
        row = row.crossJoin(n(df, name))  # one row each
    stored = F.col("total_entities") * fixed.ENTITY_BYTES + F.col("total_relations") * fixed.RELATION_BYTES + F.col("total_facts") * fixed.FACT_BYTES
    whole = stored + F.col("n_edges") * 8 + F.when(F.col("total_entities") > 0, (F.col("total_entities") + 1) * 4).otherwise(0)
    ratio = F.when(whole > 0, F.col("total_text_chars") / whole).otherwise(0.0)
    return row.select("total_text_chars", "total_entities", "total_relations", "total_facts", ratio.alias("compression_ratio"), (F.col("total_text_chars") / (1024 * 1024)).alias("estimated_original_mb"), (stored / 1024).alias("estimated_compressed_kb"))


def with_vectors(entity_table: DataFrame, d: int = 64, m: int = 4, w: float = 10.0, seed: int = 42) -> DataFrame:
    """``entity_table`` with columns embedding and bucket: what a store keeps for similarity, so that names are hashed once."""
    embedded = entity_table.withColumn("embedding", vectors.concept_embedding(F.col("name"), d))
    return embedded.withColumn("bucket", vectors.bucket(F.col("embedding"), d, m, w, seed))


def similar(vector_table: DataFrame, query: str, k: int = 10, d: int = 64, m: int = 4, w: float = 10.0, seed: int = 42) -> DataFrame:
    """(name, score): the ``k`` entities of the query's bucket, or of all if there is none, nearest by exp of the negative squared
    distance; ties by name. ``vector_table``: as ``with_vectors`` makes it; stored by bucket, only one bucket is read unless it is empty."""
    tokens = query.lower().split()
    if not tokens:
        return vector_table.sparkSession.createDataFrame([], "name string, score double")
    q = vectors.embed(tokens, d).mean(0)
    planes, offsets = vectors.lsh_planes(d, m, w, seed)
    own = F.array(*[F.lit(int(x)) for x in np.floor((planes @ q + offsets) / w)])
    inside = vector_table.where(F.col("bucket") == own)
    found = vector_table if inside.isEmpty() else inside
    near = found.select("name", vectors.square_distance(F.col("embedding"), vectors.literal(q)).alias("distance")).orderBy("distance", "name").limit(k)
    return near.select("name", F.exp(-F.col("distance")).alias("score"))


def np_similarity(names: list[str], query: str, d: int) -> np.ndarray:
    return np.exp(-((vectors.embed(names, d) - vectors.embed(query.lower().split(), d).mean(0)) ** 2).sum(1))
