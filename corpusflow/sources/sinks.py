"""Writing results: tables swapped in whole, deltas, pages with managed regions, JSON envelopes."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import state
from corpusflow.operators.graph import settle
from corpusflow.sources import cells


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of a table's complete versions, oldest first."""
    jvm, fs = _fs(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if re.fullmatch(r"v\d{12}", n))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that ``replace_table``, ``upsert_table`` or ``persist_edges`` wrote."""
    if cells.exists(spark, path):
        return cells.rows(spark, path)
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]}")


def replace_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Write a new version beside the others; one rename makes it the table, so readers see the old rows or the new ones, and a crash leaves the old.

    df may read the table it replaces. There is one writer at a time. The version before stays for those who read it; older ones go, and so does what crashed writers left.
    """
    spark = df.sparkSession
    versions = _versions(spark, path)
    fresh = f"{path}/_new-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(fresh) if partition_by else df.write.parquet(fresh)
    jvm, fs = _fs(spark, path)
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    number = int(versions[-1][1:]) + 1 if versions else 0
    if not fs.rename(at(fresh), at(f"{path}/v{number:012d}")):
        raise OSError(f"{path}: the new version could not take its place")
    for name in versions[:-1]:
        fs.delete(at(f"{path}/{name}"), True)
    for file in fs.listStatus(at(path)):
        if file.getPath().getName().startswith("_new-"):
            fs.delete(file.getPath(), True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there."""
    return cells.exists(spark, path) or bool(_versions(spark, path))


def present(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path."""
    jvm, fs = _fs(spark, path)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path))


def upsert_table(df: DataFrame, path: str, key: list[str], gone: DataFrame | None = None) -> int:
    """Insert rows or replace those with the same key, and delete those whose key is in gone; only the buckets of these keys are rewritten. Returns how many were."""
    return cells.upsert(df, path, key, gone)


def persist_edges(edges: DataFrame, path: str) -> dict[str, int]:
    """Store a graph's different edges; returns how many there are, and how many were inserted and deleted. Only buckets with such an edge are written, and an unchanged graph isn't."""
    spark, edges = edges.sparkSession, edges.distinct()
    columns = edges.columns
    if not cells.exists(spark, path):
        cells.upsert(edges, path, columns)
        n = cells.rows(spark, path).count()
        return {"edges": n, "inserted": n, "deleted": 0}
    stored = cells.rows(spark, path)
    change = settle(state.delta(stored, edges))
    count = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
    of = lambda kind: change.where(F.col("change") == kind).select(*columns)
    cells.upsert(of("insert"), path, columns, of("delete"))
    return {"edges": cells.rows(spark, path).count(), "inserted": count.get("insert", 0), "deleted": count.get("delete", 0)}


def with_backlinks(pages: DataFrame, backlinks: DataFrame) -> DataFrame:
    """pages (page_id, body) whose region ``backlinks`` lists their referrers, in order; what users wrote stays."""
    listed = backlinks.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("referrer")), lambda r: F.concat(F.lit("- [["), r, F.lit("]]"))), "\n").alias("list"))
    joined = pages.join(listed, "page_id", "left")
    return joined.select(*[c for c in pages.columns if c != "body"], F.when(F.col("list").isNull(), F.col("body")).otherwise(T.put_region(F.col("body"), "backlinks", F.col("list"))).alias("body"))


def envelope(data: Column, command: str) -> Column:
    """The JSON that commands answer with."""
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(command).alias("command"), data.alias("data"), F.array().cast("array<string>").alias("warnings"), F.array().cast("array<string>").alias("errors")), {"ignoreNullFields": "false"})


def publish_links(body: Column, base: str) -> Column:
    """Relative Markdown links become absolute ones below base."""
    return F.regexp_replace(body, r"(!?\[[^\]]*\])\((?!https?://|#|/|mailto:|data:)(?:\./)?([^)\s]+)\)", f"$1({base.rstrip('/')}/$2)")
