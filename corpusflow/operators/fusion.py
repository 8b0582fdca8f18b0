"""Reciprocal rank fusion of ranked tiers, the gate before reranking, and reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what is added to a rank before it is inverted.
RRF_K = 60
#: Candidates that a reranker sees, and keeps.
RERANK_POOL, RERANK_KEEP = 30, 8


def fuse(tiers: list[DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    """tiers: item_id, rank, tier. One shuffle brings an item's ranks together; a tier without it adds nothing."""
    ranked = reduce(DataFrame.unionByName, [t.select("item_id", "rank", "tier") for t in tiers])
    adds = F.lit(1.0) / (F.lit(k) + F.col("rank"))
    rank_of = lambda tier: F.max(F.when(F.col("tier") == tier, F.col("rank"))).alias(f"{tier}_rank")
    part_of = lambda tier: F.coalesce(F.max(F.when(F.col("tier") == tier, adds)), F.lit(0.0))
    order = ("lexical", "semantic", "structural")
    fused = ranked.groupBy("item_id").agg(*map(rank_of, order), sum((part_of(t) for t in order[1:]), part_of(order[0])).alias("score"))
    return fused.orderBy(F.desc("score"), "item_id").limit(limit)


def disagree(fused: DataFrame) -> DataFrame:
    """One row: whether the lexical and the semantic tier both have a first item and it isn't the same."""
    first = lambda tier: F.max(F.when(F.col(f"{tier}_rank") == 1, F.col("item_id")))
    return fused.agg(first("lexical").alias("lexical_first"), first("semantic").alias("semantic_first")).withColumn("rerank", F.coalesce(F.col("lexical_first") != F.col("semantic_first"), F.lit(False)))


def overlap_scorer(query_terms: list[str]) -> Callable[[Column], Column]:
    """A stand-in for a model: the share of the query's different terms that a text holds."""
    from corpusflow.functions import text as T

    terms = sorted(set(query_terms))
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    return lambda text: F.size(F.array_intersect(T.tokens(text), wanted)) / F.lit(max(1, len(terms)))


def rerank(fused: DataFrame, texts: DataFrame, scorer: Callable[[Column], Column], keep: int = RERANK_KEEP) -> DataFrame:
    """Score the candidates' texts (item_id, text) anew if the gate opens, and keep the best; else the fused order stays."""
    gate = F.broadcast(disagree(fused).select("rerank"))
    pool = F.broadcast(fused.select("item_id"))  # broadcast: the fused items are limited
    scored = fused.join(texts.join(pool, "item_id", "left_semi").select("item_id", "text"), "item_id", "left").withColumn("rerank_score", scorer(F.coalesce("text", F.lit("")))).drop("text").crossJoin(gate)
    key = F.when(F.col("rerank"), F.col("rerank_score")).otherwise(F.col("score"))
    placed = scored.withColumn("position", F.row_number().over(Window.orderBy(F.desc(key), "item_id")))
    return placed.where(~F.col("rerank") | (F.col("position") <= keep))


def rich_text(title: Column, summary: Column, paragraph: Column, item_id: Column) -> Column:
    """Title, summary and first paragraph between blank lines, the paragraph only if it says something else; the id if there is nothing."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    other = F.when(F.trim(paragraph) != F.trim(F.coalesce(summary, F.lit(""))), paragraph)
    return F.coalesce(blank(F.concat_ws("\n\n", blank(title), blank(summary), blank(other))), item_id.cast("string"))
