"""Graph operators over tables of edges: personalized PageRank, closures, layers, staleness.

Graphs of few edges, counted first, go to one task. Iterations over larger ones write each
round to the checkpoint folder of the session, so plans stay short and a lost executor costs
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import names, small_graphs

#: Damping, rounds at most, and the change below which a ranking stands still.
DAMPING, ROUNDS, EPSILON = 0.85, 30, 1e-6


def _ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or "/tmp/corpusflow-checkpoints")


def settle(df: DataFrame) -> DataFrame:
    """Compute once, cut the lineage, in shared storage."""
    _ready(df.sparkSession)
    return df.checkpoint(eager=True)


def citation_edges(citations: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """src_id, dst_id, edge_type. citations: page_id, source_id. pages: page_id, source_id (null for concepts). links: page_id, target.

    Of pages with one source id the first counts; links to pages that aren't there and edges to oneself are left out.
    """
    home = pages.where("source_id IS NOT NULL").groupBy("source_id").agg(F.min("page_id").alias("dst_id"))
    cites = citations.join(home, "source_id").select(F.col("page_id").alias("src_id"), "dst_id", F.lit("cites").alias("edge_type"))
    live = pages.select(F.col("page_id").alias("target"))
    linked = links.join(live, "target", "left_semi").select(F.col("page_id").alias("src_id"), F.col("target").alias("dst_id"), F.lit("links").alias("edge_type"))
    return cites.unionByName(linked).where("src_id != dst_id").distinct()


def edge_labels(edges: DataFrame) -> DataFrame:
    """The different types of the edges between two nodes, in order, joined by a comma."""
    return edges.groupBy("src_id", "dst_id").agg(F.array_join(F.array_sort(F.collect_set("edge_type")), ",").alias("edge_types"))


def pagerank(edges: DataFrame, seeds: DataFrame | None, damping: float = DAMPING, rounds: int = ROUNDS, epsilon: float = EPSILON) -> DataFrame:
    """item_id and score above epsilon / n. edges: src_id, dst_id. seeds: item_id; a repeated seed weighs more.

    Without seeds every node is one; seeds of which none is a node rank nothing. What nodes without
    out-edges hold goes back to the seeds. epsilon 0 runs all rounds.
    """
    links = edges.select("src_id", "dst_id").distinct()
    degree = links.groupBy("src_id").agg(F.count("*").alias("degree"))
    nodes = links.select(F.col("src_id").alias("item_id")).union(links.select("dst_id")).distinct()
    if seeds is None:
        weight = nodes.withColumn("weight", F.lit(1.0))
    else:
        weight = nodes.join(seeds.groupBy("item_id").agg(F.count("*").cast("double").alias("weight")), "item_id", "left").na.fill(0.0, ["weight"])
    state = weight.join(degree.withColumnRenamed("src_id", "item_id"), "item_id", "left")
    state = settle(state)
    n, total = state.agg(F.count("*"), F.sum("weight")).first()
    if not n or not total:
        return state.select("item_id", F.col("weight").alias("score")).limit(0)
    state = state.select("item_id", "degree", (F.col("weight") / total).alias("teleport")).withColumn("score", F.col("teleport"))
    links = settle(links.join(degree, "src_id"))
    if links.count() <= small_graphs.FEW_EDGES:
        ranked = small_graphs.pagerank(state.select("item_id", "teleport"), links.select("src_id", "dst_id"), damping, rounds, epsilon)
        return settle(ranked.where(F.col("score") > epsilon / n))
    for _ in range(max(1, rounds)):
        dangling = state.where("degree IS NULL").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        sent = links.join(state.select(F.col("item_id").alias("src_id"), "score"), "src_id").groupBy(F.col("dst_id").alias("item_id")).agg(F.sum(damping * F.col("score") / F.col("degree")).alias("got"))
        moved = state.join(sent, "item_id", "left").withColumn("next", F.coalesce("got", F.lit(0.0)) + F.col("teleport") * (1 - damping + damping * dangling))
        moved = settle(moved.select("item_id", "degree", "teleport", F.abs(F.col("next") - F.col("score")).alias("change"), F.col("next").alias("score")))
        change = moved.agg(F.max("change")).first()[0] if epsilon else None
        state = moved.drop("change")
        if change is not None and change < epsilon:
            break
    return state.where(F.col("score") > epsilon / n).select("item_id", "score")


#: Rounds after which what was reached is written anew as one table.
COMPACT = 12


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """item_id and depth (0 for start) of all that edges (src_id, dst_id) lead to. Few edges go to one task; else each round writes what is new in it."""
    edges = settle(edges.select("src_id", "dst_id").distinct())
    begun = settle(start.select("item_id").distinct().withColumn("depth", F.lit(0)))
    if edges.count() <= small_graphs.FEW_EDGES:
        # only starts that have an edge go to the task: no more than there are edges
        leads = edges.select(F.col("src_id").alias("item_id")).distinct()
        found = settle(small_graphs.closure(begun.join(leads, "item_id", "left_semi"), edges))
        return found.unionByName(begun.join(found.select("item_id"), "item_id", "left_anti"))
    reached = frontier = begun
    depth = 0
    while frontier.limit(1).count():
        depth += 1
        step = frontier.join(edges, F.col("item_id") == F.col("src_id")).select(F.col("dst_id").alias("item_id")).distinct()
        frontier = settle(step.join(reached, "item_id", "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(frontier)
        if depth % COMPACT == 0:
            reached = settle(reached)
    return reached


def upstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")), start)


def layers(edges: DataFrame) -> DataFrame:
    """item_id and layer, each behind all that lead to it; nodes on or behind a cycle have layer null."""
    left = settle(edges.select("src_id", "dst_id").distinct())
    nodes = settle(left.select(F.col("src_id").alias("item_id")).union(left.select("dst_id")).distinct())
    if left.count() <= small_graphs.FEW_EDGES:
        return settle(small_graphs.layers(nodes.withColumn("one", F.lit(1)), left))
    done, layer = None, 0
    while True:
        free = settle(nodes.join(left.select(F.col("dst_id").alias("item_id")), "item_id", "left_anti").withColumn("layer", F.lit(layer)))
        if not free.limit(1).count():
            break
        done = free if done is None else done.unionByName(free)
        nodes = settle(nodes.join(free, "item_id", "left_anti"))
        left = settle(left.join(free.select(F.col("item_id").alias("src_id")), "src_id", "left_anti"))
        layer += 1
    rest = nodes.withColumn("layer", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def inconsistent(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Edges (src_id, dst_id) that one of two directions of a graph lists and the other doesn't."""
    turned = outputs.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    return inputs.exceptAll(turned).withColumn("missing_in", F.lit("outputs")).unionByName(turned.exceptAll(inputs).withColumn("missing_in", F.lit("inputs")))


def resolve_node(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name) to item_id: the node of that name, else the only one that ends with it, else null."""
    same = wanted.join(nodes.select(F.col("item_id").alias("exact")), F.col("name") == F.col("exact"), "left")
    open_ = same.where("exact IS NULL").select("name")
    turned = names.beginnings(nodes.select("item_id", F.reverse("item_id").alias("whole")), open_.select(F.reverse("name").alias("part")), "whole", "part")
    ending = turned.groupBy(F.reverse("part").alias("name")).agg(F.count("item_id").alias("n"), F.min("item_id").alias("only"))
    found = open_.join(ending, "name", "left").select("name", F.when(F.col("n") == 1, F.col("only")).alias("item_id"))
    return same.where("exact IS NOT NULL").select("name", F.col("exact").alias("item_id")).unionByName(found)


def prune(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those at a node that goes (item_id)."""
    out = edges
    for side in ("src_id", "dst_id"):
        out = out.join(gone.select(F.col("item_id").alias(side)), side, "left_anti")
    return out.select(*edges.columns)


def first_parents(edges: DataFrame, root: DataFrame) -> DataFrame:
    """A tree over all that root leads to: item_id, depth and the smallest parent one step nearer. Breadth first, so each node is met once."""
    depth = closure(edges, root)
    near = depth.select(F.col("item_id").alias("src_id"), F.col("depth").alias("d"))
    parent = edges.join(near, "src_id").join(depth, F.col("dst_id") == F.col("item_id")).where("depth = d + 1")
    return depth.join(parent.groupBy("item_id").agg(F.min("src_id").alias("parent")), "item_id", "left")
