"""Incremental state: what is new, changed or gone, and what depends on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import fingerprint
from corpusflow.operators.graph import closure, prune


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that were inserted or deleted, in a column ``change``."""
    columns = new.columns
    return new.exceptAll(old.select(*columns)).withColumn("change", F.lit("insert")).unionByName(old.select(*columns).exceptAll(new).withColumn("change", F.lit("delete")))


def changed(old: DataFrame, new: DataFrame, key: str = "node_id", value: str = "hash") -> DataFrame:
    """Keys whose values differ; a key on one side only has changed too."""
    a, b = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").otherwise("changed")
    return a.join(b, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, kind.alias("kind"))


def ingest_outcome(arrivals: DataFrame, documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """arrivals: doc_id, content_hash. A document never seen is a new source; bytes never seen of it a new revision; else skipped."""
    known = documents.select("doc_id").distinct().withColumn("_doc", F.lit(True))
    seen = revisions.select("doc_id", "content_hash").distinct().withColumn("_rev", F.lit(True))
    outcome = F.when(F.col("_doc").isNull(), "new_source").when(F.col("_rev").isNull(), "new_revision").otherwise("skipped")
    return arrivals.join(known, "doc_id", "left").join(seen, ["doc_id", "content_hash"], "left").select("doc_id", "content_hash", outcome.alias("outcome"))


def stale(old: DataFrame, new: DataFrame, depends: DataFrame) -> DataFrame:
    """item_id, depth: changed nodes (0), and all that depend on them. depends: node_id, dep_id."""
    seeds = changed(old, new).select(F.col("node_id").alias("item_id"))
    return closure(depends.select(F.col("dep_id").alias("src_id"), F.col("node_id").alias("dst_id")), seeds)


def stale_records(records: DataFrame, changed_inputs: DataFrame) -> DataFrame:
    """record_ids some of whose inputs changed, or are outputs of such a record. records: record_id, inputs, outputs (arrays)."""
    edges = records.select("record_id", F.explode("inputs").alias("src_id"), "outputs").select("src_id", "record_id", F.explode("outputs").alias("dst_id"))
    reached = closure(edges.select("src_id", "dst_id").distinct(), changed_inputs.select(F.col("path").alias("item_id")))
    touched = records.select("record_id", F.explode("inputs").alias("item_id")).join(reached, "item_id", "left_semi")
    return touched.select("record_id").distinct()


def upsert(stored: DataFrame, arriving: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows but for those that arrive again, and the arriving ones."""
    return stored.join(arriving.select(*key), key, "left_anti").select(*stored.columns).unionByName(arriving.select(*stored.columns))


def retire(stored: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows whose key is live no more; those to delete."""
    return stored.join(live.select(*key), key, "left_anti")


def retire_chunks(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored chunks (chunk_id: item#number) to delete: those that are live no more, and those whose id isn't of that form."""
    known = live.select("chunk_id", F.lit(True).alias("_live"))
    return stored.join(known, "chunk_id", "left").where(F.col("_live").isNull() | ~F.col("chunk_id").rlike(r"^.+#\d+$")).drop("_live")


def stage_keys(docs: DataFrame, template_hash: str, model: str) -> DataFrame:
    """doc_id and the key under which a stage's result is kept: content, template and model."""
    return docs.select("doc_id", fingerprint(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(template_hash), F.lit(model)).alias("stage_key"))


def explain_stages(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """doc_id and whether its stage would run or be skipped."""
    old = stored.select("doc_id", F.col("stage_key").alias("_old"))
    return keys.join(old, "doc_id", "left").select("doc_id", F.when(F.col("stage_key").eqNullSafe(F.col("_old")), "skip").otherwise("run").alias("decision"))


def index_stats(live: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: chunks stored, and items with a chunk that is missing, differs or is live no more. Both: chunk_id, item_id, content_hash."""
    both = live.select("chunk_id", F.col("item_id").alias("_a"), F.col("content_hash").alias("_new")).join(stored.select("chunk_id", F.col("item_id").alias("_b"), F.col("content_hash").alias("_old")), "chunk_id", "full_outer")
    off = both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(F.coalesce("_a", "_b").alias("item_id")).distinct()
    return stored.agg(F.count("*").alias("stored_chunks")).crossJoin(off.agg(F.count("*").alias("stale_items")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents with the same content: first_id, n."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("content_hash")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).where("n > 1")


def forget_plan(pages: DataFrame, source_id: Column) -> DataFrame:
    """What forgetting a source would do to each page (page_id, source_ids) that names it: delete the orphaned, scrub the others."""
    return pages.where(F.array_contains("source_ids", source_id)).select("page_id", F.when(F.size("source_ids") == 1, "delete").otherwise("scrub").alias("action"), F.array_remove("source_ids", source_id).alias("remaining"))


def forget(pages: DataFrame, edges: DataFrame, source_id: Column) -> tuple[DataFrame, DataFrame]:
    """What is left after forgetting a source: pages (page_id, source_ids) without it and without those it was all of, and edges (src_id, dst_id) that touch neither these nor the source."""
    plan = forget_plan(pages, source_id)
    gone = plan.where("action = 'delete'").select("page_id")
    kept = pages.join(gone, "page_id", "left_anti").withColumn("source_ids", F.array_remove("source_ids", source_id))
    ends = gone.select(F.col("page_id").cast(edges.schema["src_id"].dataType).alias("item_id"))
    return kept, prune(edges, ends).where((F.col("src_id") != source_id) & (F.col("dst_id") != source_id))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
