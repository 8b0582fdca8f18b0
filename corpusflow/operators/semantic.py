"""Semantic retrieval: exact nearest neighbours by cosine, items by their best chunk, floors, hash embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import vectors as V
from corpusflow.operators import places

# The floors of hash embeddings, and of a model's.
FLOORS = {"hash": (0.35, 0.45), "model": (0.15, 0.20)}
#: Chunks fetched for each item wanted.
OVERSCAN = 4


def nearest(chunks: DataFrame, query: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """chunks with score for the k nearest to a one-row query vector (column ``query``); ties by id."""
    one = F.broadcast(query.select(F.col(query.columns[0]).alias("query")).limit(1))  # broadcast: one row
    scored = chunks.crossJoin(one).withColumn("score", F.greatest(F.lit(0.0), V.cosine(F.col(vector_col), F.col("query")))).drop("query")
    return scored.where("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def items_of(hits: DataFrame, limit: int) -> DataFrame:
    """The best chunk of each item; of equal ones the first by chunk id as text."""
    best = F.min_by(F.struct("chunk_id", "score"), F.struct(-F.col("score"), F.col("chunk_id").cast("string"))).alias("best")
    return hits.groupBy("item_id").agg(best).select("item_id", "best.chunk_id", "best.score").orderBy(F.desc("score"), "item_id").limit(limit)


def semantic_items(chunks: DataFrame, query: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """Items among four times as many chunks as wanted; items whose chunks all lie beyond aren't seen."""
    return items_of(nearest(chunks, query, OVERSCAN * limit, id_col), limit)


def above_floor(items: DataFrame, lexical: DataFrame, least: float, least_alone: float) -> DataFrame:
    """Items from ``least`` on; none if no lexical candidate backs them and even the best is below ``least_alone``."""
    backed = F.broadcast(lexical.limit(1).agg((F.count("*") > 0).alias("backed")))
    top = F.broadcast(items.agg(F.max("score").alias("top")))
    kept = items.crossJoin(backed).crossJoin(top).where((F.col("score") >= least) & (F.col("backed") | (F.col("top") >= least_alone)))
    return kept.drop("backed", "top")


def hash_embeddings(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and a unit vector of 256 hashed counts of words and character 3- to 5-grams; all zero for an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusflow.operators.hashing import hash_vector

        for batch in batches:
            rows = [hash_vector(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["id", "embedding"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInArrow(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def bucket_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, bucket, n: a hash embedding before it is scaled, by built-in functions alone.

    Texts are dealt out by id, and what is counted is one id at a time, so a task holds no table of all its counts.
    """
    dealt = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    found = dealt.groupBy(id_col).agg(F.collect_list(text_col).alias("_texts")).select(id_col, F.flatten(F.transform("_texts", lambda t: F.transform(V.grams(t), V.hash_bucket))).alias("_b"))
    times = lambda x: (F.size("_b") - F.size(F.array_remove("_b", x))).cast("long")
    each = found.select(id_col, F.explode(F.transform(F.array_distinct("_b"), lambda x: F.struct(x.alias("bucket"), times(x).alias("n")))).alias("_c"))
    return each.select(id_col, "_c.bucket", "_c.n")


def ranks(hits: DataFrame, tier: str) -> DataFrame:
    """item_id and its place in a tier."""
    return hits.select("item_id", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")).alias("rank"), F.lit(tier).alias("tier"), F.col("score").cast("double").alias("score"))


def ranks_among(hits: DataFrame, wanted: DataFrame, top: int, tier: str) -> DataFrame:
    """item_id and its place in a long tier, of the first ``top`` items and of the wanted ones (item_id).

    Both may be long: hits are sorted in ranges, and wanted items meet their places by equality.
    """
    score = F.col("score").cast("double")
    placed = places.numbered(hits.select("item_id", score.alias("score")), [F.col("score").isNull(), -F.col("score"), F.col("item_id")], "rank")
    found = placed.select("item_id", "rank", F.lit(tier).alias("tier"), "score")
    asked = found.where(F.col("rank") > top).join(wanted.select("item_id").distinct(), "item_id", "left_semi")
    return found.where(F.col("rank") <= top).unionByName(asked.select(*found.columns))


def sync(stored: DataFrame, inputs: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The store after a sync: chunk_id, item_id, content_hash, embedding of all that is live, and nothing else.

    inputs: chunk_id, item_id, text, content_hash of what is live. Only chunks that are new or whose hash differs are embedded; embed: from inputs to chunk_id, embedding.
    """
    key = ["chunk_id", "content_hash"]
    same = stored.join(inputs.select(*key), key, "left_semi").select("chunk_id", "item_id", "content_hash", "embedding")
    due = inputs.join(same.select("chunk_id"), "chunk_id", "left_anti")
    made = due.select("chunk_id", "item_id", "content_hash").join(embed(due.select("chunk_id", "text")), "chunk_id")
    return same.unionByName(made.select(*same.columns))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of token vectors, weighted by their mask, at unit length; all zero if nothing counts. Tokens without a mask don't count."""
    pairs = F.filter(F.zip_with(tokens, mask, lambda t, m: F.struct(t.alias("t"), m.cast("double").alias("m"))), lambda p: p["m"] > 0)
    zero = F.transform(F.get(tokens, 0), lambda x: F.lit(0.0))
    total = F.aggregate(pairs, zero, lambda a, p: F.zip_with(a, p["t"], lambda x, y: x + y.cast("double") * p["m"]))
    length = V.norm(total)
    return F.transform(total, lambda x: F.when(length > 0, x / length).otherwise(0.0))
