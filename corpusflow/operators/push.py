"""Personalised PageRank by forward push over stored links: a round reads the links of those nodes only that have something to hand on.

Each node that was reached has a score and a residual. A round takes all residuals that are large enough: a share stays
as score, the rest goes to the nodes linked to, or back to the seeds where there are none. Scores and residuals
together are what as many rounds over all edges give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.graph import DAMPING, EPSILON, ROUNDS, settle
from corpusflow.sources import cells

#: Cells of the stored links.
BUCKETS = 64


def _dealt(df: DataFrame, by: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(buckets)).cast("int"))


def store_links(edges: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the links (src_id, dst_id) and the nodes with their number of links, each in cells by node."""
    links = edges.select("src_id", "dst_id").distinct()
    degree = links.groupBy(F.col("src_id").alias("item_id")).agg(F.count("*").alias("degree"))
    ends = links.select(F.col("dst_id").alias("item_id"), F.lit(0).cast("long").alias("degree"))
    nodes = settle(degree.unionByName(ends).groupBy("item_id").agg(F.max("degree").alias("degree")))
    cells.write(_dealt(nodes, "item_id", buckets), f"{path}/nodes", ["bucket"], meta={"buckets": str(buckets), "nodes": str(nodes.count())})
    cells.write(_dealt(links, "src_id", buckets), f"{path}/links", ["bucket"])


def _cells_of(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """A stored table's cells of some buckets."""
    wanted = set(map(str, buckets))
    return cells.read(spark, path, lambda cell: cell[0] in wanted).drop("bucket")


def pagerank(spark: SparkSession, path: str, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, epsilon: float = EPSILON, least: float | None = None) -> DataFrame:
    """item_id and score above epsilon / n of what the seeds reach: the ranking of ``graph.pagerank``. seeds: item_id; a repeated seed weighs more.

    least: residuals up to it stay where they are; by default a thousandth of epsilon. They are part of their node's score, so
    what the ranking lacks elsewhere is their sum at most. epsilon 0 runs all rounds.
    """
    least = epsilon / 1000 if least is None else least
    meta = cells.manifest(spark, f"{path}/nodes").meta
    buckets, n = int(meta["buckets"]), int(meta["nodes"])
    asked = settle(_dealt(seeds.groupBy("item_id").agg(F.count("*").alias("weight")), "item_id", buckets))
    known = _cells_of(spark, f"{path}/nodes", asked.agg(F.collect_set("bucket")).first()[0])
    start = settle(asked.join(known, "item_id").select("item_id", "bucket", "degree", "weight"))
    total = start.agg(F.sum("weight")).first()[0]
    if not total:
        return start.select("item_id", F.lit(0.0).alias("score")).limit(0)
    home = settle(start.select("item_id", "bucket", "degree", (F.col("weight") / total).alias("share")))
    state = home.select("item_id", "bucket", "degree", F.lit(0.0).alias("score"), F.col("share").alias("residual"))
    state = settle(state.withColumn("change", F.lit(None).cast("double")))
    for done in range(max(1, rounds) + 1):
        active = state.where(F.col("residual") > least)
        moves = F.when(F.col("degree") > 0, F.col("bucket"))
        facts = state.agg(F.max("change").alias("change"), F.coalesce(F.sum(F.when((F.col("residual") > least) & (F.col("degree") == 0), F.col("residual"))), F.lit(0.0)).alias("lost"), F.collect_set(F.when(F.col("residual") > least, moves)).alias("buckets")).first()
        if done == max(1, rounds) or (epsilon and done and facts["change"] < epsilon):
            break
        moving = active.where("degree > 0").select(F.col("item_id").alias("src_id"), (damping * F.col("residual") / F.col("degree")).alias("part"))
        sent = _cells_of(spark, f"{path}/links", facts["buckets"]).join(moving, "src_id")
        got = sent.select(F.col("dst_id").alias("item_id"), "part").unionByName(home.select("item_id", (F.col("share") * damping * facts["lost"]).alias("part")))
        got = settle(_dealt(got.groupBy("item_id").agg(F.sum("part").alias("got")), "item_id", buckets))
        fresh = got.join(state.select("item_id"), "item_id", "left_anti")
        fresh = fresh.join(_cells_of(spark, f"{path}/nodes", fresh.agg(F.collect_set("bucket")).first()[0]), "item_id").select("item_id", "bucket", "degree", F.lit(0.0).alias("score"), F.lit(0.0).alias("residual"))
        pushed = F.when(F.col("residual") > least, F.col("residual")).otherwise(0.0)
        both = state.drop("change").unionByName(fresh).join(got.select("item_id", "got"), "item_id", "left").withColumn("_pushed", pushed).na.fill(0.0, ["got"])
        state = settle(both.select("item_id", "bucket", "degree", (F.col("score") + (1 - damping) * F.col("_pushed")).alias("score"), (F.col("residual") - F.col("_pushed") + F.col("got")).alias("residual"), F.abs(F.col("got") - damping * F.col("_pushed")).alias("change")))
    return state.select("item_id", (F.col("score") + F.col("residual")).alias("score")).where(F.col("score") > epsilon / n)
