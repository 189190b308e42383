"""Measures of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.paging import running_starts


def token_f1(pairs: DataFrame) -> DataFrame:
    """(id, f1, em) of pairs (id, prediction, gold): shared tokens counted with their multiplicity."""
    sides = pairs.select("id", *[text.normalised_answer(F.col(c)).alias(c) for c in ("prediction", "gold")])
    counts = []
    for side in ("prediction", "gold"):
        counts.append(sides.select("id", F.explode(text.tokens(F.col(side))).alias("token")).groupBy("id", "token").agg(F.count("*").alias(side)))
    shared = counts[0].join(counts[1], ["id", "token"], "full").na.fill(0).groupBy("id").agg(F.sum(F.least("prediction", "gold")).alias("common"), F.sum("prediction").alias("np"), F.sum("gold").alias("ng"))
    f1 = F.when(F.col("common") > 0, 2 * F.col("common") / (F.col("np") + F.col("ng"))).otherwise(0.0)
    return sides.join(shared, "id", "left").select("id", F.coalesce(f1, F.lit(0.0)).alias("f1"), (F.col("prediction") == F.col("gold")).cast("double").alias("em"))


def by_group(scores: DataFrame, group: str) -> DataFrame:
    return scores.groupBy(group).agg(F.avg("f1").alias("f1"), F.avg("em").alias("em"), F.count("*").alias("n"))


def ranking(results: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """One row of means over queries: results (query_id, rank, item), truth (query_id, item).

    Precision and recall at ``k``, hits at 1 and ``k``, reciprocal rank of the first true item.
    """
    hits = results.join(truth.withColumn("true", F.lit(1)), ["query_id", "item"], "left").na.fill(0, ["true"])
    one = hits.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, F.col("true"))).alias("at_k"), F.count(F.when(F.col("rank") <= k, 1)).alias("seen"), F.min(F.when(F.col("true") == 1, F.col("rank"))).alias("first"))
    per = truth.groupBy("query_id").agg(F.count("*").alias("wanted")).join(one, "query_id", "left")
    n = F.coalesce("at_k", F.lit(0))
    rates = [F.avg(F.when(F.col("seen") > 0, n / F.col("seen")).otherwise(0.0)).alias("precision"), F.avg(n / F.col("wanted")).alias("recall")]
    rates += [F.avg(F.coalesce((F.col("first") <= c).cast("double"), F.lit(0.0))).alias(name) for name, c in (("hits_1", 1), ("hits_k", k))]
    return per.agg(*rates, F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def supported(retrieved: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, recall): share of supporting sentences of whose words more than half stand in the retrieved pages.

    retrieved (query_id, text), facts (query_id, fact_id, sentence).
    """
    have = retrieved.select("query_id", F.explode(F.array_distinct(text.tokens(F.lower("text")))).alias("word")).distinct()
    want = facts.select("query_id", "fact_id", F.explode(F.array_distinct(text.tokens(F.lower("sentence")))).alias("word"))
    found = want.join(have.withColumn("hit", F.lit(1)), ["query_id", "word"], "left").groupBy("query_id", "fact_id").agg((F.sum("hit") > F.count("*") * 0.5).alias("found"))
    return found.groupBy("query_id").agg(F.avg(F.coalesce(F.col("found").cast("double"), F.lit(0.0))).alias("recall"))


def clean_rates(results: DataFrame) -> DataFrame:
    """Shares of queries whose pages hold the answer, hold it without the distractor, and hold the distractor.

    results (query_id, pages, answer, distractor).
    """
    has = lambda c: F.exists("pages", lambda p: F.contains(F.lower(p), F.lower(F.col(c))))
    return results.select(has("answer").alias("a"), has("distractor").alias("d")).agg(F.avg((F.col("a") & ~F.col("d")).cast("double")).alias("clean"), F.avg(F.col("a").cast("double")).alias("any"), F.avg(F.col("d").cast("double")).alias("distracted"))


def index_percentiles(values: DataFrame, group: str, column: str) -> DataFrame:
    """p50, p95, p99 by place in the sorted values, no interpolation; nulls come first.

    Equal values are counted first; places come from running sums by ranges, so that a group of any size is no single task's sort.
    """
    counts = values.groupBy(F.col(group).alias("group"), F.col(column).alias("x")).agg(F.count("*").alias("n"))
    placed = running_starts(counts, ["group", "x"])
    whole = placed.groupBy("group").agg(F.min("start").alias("first"), F.sum("n").alias("total"))
    rows = placed.join(whole.withColumnRenamed("group", "__group"), F.col("group").eqNullSafe(F.col("__group")))
    place = F.col("start") - F.col("first")
    pick = lambda share: F.max(F.when((place <= F.floor(F.col("total") * F.lit(share))) & (F.floor(F.col("total") * F.lit(share)) < place + F.col("n")), F.col("x")))
    return rows.groupBy(F.col("group").alias(group)).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))


def telemetry(results: DataFrame, seconds: float) -> DataFrame:
    """One row for a batch of answered queries that took so long: queries, failures, queries a second, tokens used, their mean and ratio to all
    candidates' tokens, mean confidence."""
    used, whole = F.sum("tokens_used"), F.sum("tokens_total")
    row = results.agg(F.count("*").alias("queries"), F.count("error").alias("failed"), used.alias("tokens_used"), F.avg("tokens_used").alias("mean_tokens"), F.avg("confidence").alias("mean_confidence"), F.when(used > 0, whole / used).otherwise(0.0).alias("compression_ratio"))
    return row.select("queries", "failed", (F.col("queries") / F.lit(float(seconds))).alias("queries_per_second"), "tokens_used", "mean_tokens", "mean_confidence", "compression_ratio")


def summary(values: DataFrame, group: str, column: str) -> DataFrame:
    """Mean, population deviation, median and interpolated percentiles."""
    c = F.col(column)
    return values.groupBy(group).agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.median(c).alias("median"), F.percentile(c, F.lit(0.95)).alias("p95"), F.percentile(c, F.lit(0.99)).alias("p99"))


def line_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    return points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def stored_bytes(pages: DataFrame, d: int, fan: int = 10, k: int = 5) -> DataFrame:
    """Bytes of text, and of beacons, patches (mean and precision) and signatures at two, four and eight bytes a number."""
    row = pages.agg(F.sum(F.octet_length("text")).alias("text_bytes"), F.count("*").alias("b1"))
    b2, b3 = F.ceil(F.col("b1") / fan), F.ceil(F.col("b1") / (fan * fan))
    return row.select("text_bytes", (F.col("b1") * 2 * d).alias("b1_bytes"), (b2 * (2 + 8) * d).alias("b2_bytes"), (b3 * 8 * (k + k * fan)).alias("b3_bytes"))
