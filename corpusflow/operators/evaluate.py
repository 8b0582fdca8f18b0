"""Evaluation of rankings, and of how far answers are grounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an average run must reach (precision, recall and uncertainty at least, hallucination at most).
LEAST_PRECISION, LEAST_RECALL, MOST_HALLUCINATION, LEAST_UNCERTAINTY = 0.80, 0.50, 0.10, 0.80


def relevant(item: Column, expected: Column) -> Column:
    """An expected name, blanks around it aside, stands somewhere in the item's id; case doesn't matter."""
    return F.exists(expected, lambda e: F.contains(F.lower(item), F.lower(F.trim(e))))


def ranking_metrics(ranked: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """ranked: query, position (from 1), relevant. Precision divides by k even if fewer were found; the ideal order of nDCG is that of what was found."""
    gain = F.when(F.col("relevant"), F.lit(1.0)).otherwise(0.0) / F.log2(F.col("position") + 1)
    top = F.col("position") <= k
    base = ranked.groupBy(query).agg(
        F.sum(F.when(top & F.col("relevant"), 1).otherwise(0)).cast("long").alias("hits"),
        F.sum(F.when(F.col("relevant"), 1).otherwise(0)).cast("long").alias("all_hits"),
        F.min(F.when(F.col("relevant"), F.col("position"))).alias("first"),
        F.sum(F.when(top, gain).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.when(F.col("all_hits") == 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.least(F.col("all_hits"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1)))
    return base.select(query, (F.col("hits") / k).alias("precision_at_k"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg_at_k"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision_at_k", "mrr", "ndcg_at_k")])


def coverage(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id and the share of its expected titles that stand in some retrieved title. expected: query_id, title; retrieved: query_id, found."""
    found = retrieved.groupBy("query_id").agg(F.collect_set(F.lower("found")).alias("found"))
    hit = F.exists("found", lambda f: F.contains(f, F.lower("title")))
    joined = expected.join(found, "query_id", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return joined.groupBy("query_id").agg(F.avg(F.col("hit").cast("double")).alias("coverage"))


def compare_runs(now: DataFrame, before: DataFrame) -> DataFrame:
    """Full outer join of two runs by query: metric now, before, and their difference (null where one is missing)."""
    a, b = now.select("query_id", F.col("ndcg_at_k").alias("now")), before.select("query_id", F.col("ndcg_at_k").alias("before"))
    return a.join(b, "query_id", "full_outer").select("query_id", "now", "before", (F.col("now") - F.col("before")).alias("change"))


def grounding(answers: DataFrame) -> DataFrame:
    """answers: answer_id, valid, invalid, manifest, cited_expected, expected (counts), banner, should_banner. Adds the four measures and a verdict."""
    valid, invalid = F.col("valid"), F.col("invalid")
    cites = valid + invalid
    precision = F.when(cites == 0, F.when(F.col("manifest") == 0, 1.0).otherwise(0.0)).otherwise(valid / cites)
    recall = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("cited_expected") / F.col("expected"))
    wrong = F.when(cites == 0, 0.0).otherwise(invalid / cites)
    out = answers.select("*", precision.alias("precision"), recall.alias("recall"), wrong.alias("hallucination"), (F.col("banner") == F.col("should_banner")).alias("uncertainty_match"))
    at_least = lambda p, r: (F.col("precision") >= p) & (F.col("recall") >= r)
    verdict = F.when(F.col("hallucination") > 0.25, "ungrounded").when(at_least(0.90, 0.60), "strong").when(at_least(0.70, 0.40), "acceptable").otherwise("weak")
    return out.withColumn("verdict", verdict)


def grounding_summary(graded: DataFrame) -> DataFrame:
    """Averages over all answers, and whether they pass."""
    row = graded.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("hallucination").alias("hallucination"), F.avg(F.col("uncertainty_match").cast("double")).alias("uncertainty_match"))
    passes = (F.col("precision") >= LEAST_PRECISION) & (F.col("recall") >= LEAST_RECALL) & (F.col("hallucination") <= MOST_HALLUCINATION) & (F.col("uncertainty_match") >= LEAST_UNCERTAINTY)
    return row.withColumn("passes", passes)


def report(compared: DataFrame) -> DataFrame:
    """One row, body: a Markdown table of two runs, as ``compare_runs`` has them, by query; what is missing in one is a dash."""
    number = lambda c: F.coalesce(F.format_number(c, 3), F.lit("-"))
    line = F.concat(F.lit("| "), "query_id", F.lit(" | "), number("now"), F.lit(" | "), number("before"), F.lit(" | "), number("change"), F.lit(" |"))
    lines = compared.select("query_id", line.alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "line"))), lambda x: x["line"]).alias("lines"))
    return lines.select(F.concat(F.lit("| query | now | before | change |\n|---|---|---|---|\n"), F.array_join("lines", "\n")).alias("body"))
