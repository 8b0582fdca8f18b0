"""Streams of documents and of events, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.functions.text import fingerprint
from corpusflow.operators import state
from corpusflow.sources import sinks


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(docs: DataFrame, store: str, checkpoint: str, on_new: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Take all that has arrived: find new sources and revisions, keep every revision, and hand on only what is new.

    Revisions are kept by the number of their batch. A batch that is taken again, after a crash anywhere in it, puts its own in their place and hands
    the same rows on again, with its number; so what takes them can tell a repetition, and nothing is handed on never.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        arrived = rows.select("doc_id", fingerprint(F.coalesce("text", F.lit(""))).alias("content_hash"), "text").dropDuplicates(["doc_id", "content_hash"])
        path = f"{store}/revisions"
        known = arrived.select("doc_id", "content_hash").limit(0)
        if sinks.present(spark, path):
            known = spark.read.schema(f"doc_id {arrived.schema['doc_id'].dataType.simpleString()}, content_hash string, batch long").parquet(path).where(F.col("batch") != number).select(*known.columns)
        outcome = state.ingest_outcome(arrived.select("doc_id", "content_hash"), known.select("doc_id"), known)
        fresh = arrived.join(outcome.where("outcome != 'skipped'"), ["doc_id", "content_hash"]).persist()
        try:
            if on_new is not None:
                on_new(fresh, number)
            fresh.select("doc_id", "content_hash").write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            fresh.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n, value of runs of events with small gaps; streams close a session once the watermark has passed it."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window start, event_type, n."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
