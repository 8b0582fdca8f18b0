"""Paths in graphs: a cycle that keeps one from being sorted, and trees of what a root leads to in depth-first order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import graph, places
from corpusflow.operators.graph import settle


def core(edges: DataFrame) -> DataFrame:
    """item_id of all nodes on a cycle, or on a way from one cycle to another: what is left when nodes without edges into them, and without edges out of them, are taken away again and again."""
    left = edges.select("src_id", "dst_id").distinct()
    for _ in range(2):  # from the front, and then from behind
        rest = settle(graph.layers(left).where("layer IS NULL").select("item_id"))
        inside = left.join(rest.select(F.col("item_id").alias("src_id")), "src_id", "left_semi").join(rest.select(F.col("item_id").alias("dst_id")), "dst_id", "left_semi")
        left = settle(inside.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")))
    return left.select(F.col("src_id").alias("item_id")).union(left.select("dst_id")).distinct()


def cycle(edges: DataFrame) -> DataFrame:
    """position (from 0) and item_id of one cycle, its smallest node first; no rows if there is none.

    Each node of the core goes on to its smallest neighbour there, so from each a way ends in a cycle. Ways are
    doubled until they are longer than the core is large: they end at nodes on cycles. The cycle with the smallest of these is it.
    """
    nodes = core(edges)
    inside = edges.select("src_id", "dst_id").join(nodes.select(F.col("item_id").alias("src_id")), "src_id", "left_semi").join(nodes.select(F.col("item_id").alias("dst_id")), "dst_id", "left_semi")
    step = settle(inside.groupBy(F.col("src_id").alias("item_id")).agg(F.min("dst_id").alias("next")))
    n = step.count()
    jump, length = step, 1
    while length < n:
        ahead = jump.select(F.col("item_id").alias("next"), F.col("next").alias("_to"))
        jump, length = settle(jump.join(ahead, "next").select("item_id", F.col("_to").alias("next"))), 2 * length
    on = settle(jump.select(F.col("next").alias("item_id")).distinct())
    first = on.agg(F.min("item_id")).first()[0]
    ring = step.join(on, "item_id", "left_semi")
    if first is None:
        return ring.select(F.lit(0).cast("long").alias("position"), "item_id").limit(0)
    # how far each node is from coming back to the first, where the ring is cut; what goes round in other rings never comes there
    far = settle(ring.select("item_id", F.when(F.col("next") != first, F.col("next")).alias("next"), F.lit(1).cast("long").alias("way"), (F.col("next") == first).alias("ends")))
    length = 1
    while length < n:
        ahead = far.select(F.col("item_id").alias("next"), F.col("next").alias("_next"), F.col("way").alias("_way"), F.col("ends").alias("_ends"))
        far = far.join(ahead, "next", "left").select("item_id", F.col("_next").alias("next"), (F.col("way") + F.coalesce("_way", F.lit(0))).alias("way"), (F.col("ends") | F.coalesce("_ends", F.lit(False))).alias("ends"))
        far, length = settle(far), 2 * length
    mine = far.where("ends")
    size = mine.agg(F.max("way")).first()[0]
    return mine.select((F.lit(size) - F.col("way")).alias("position"), "item_id")


def tree(edges: DataFrame, root: DataFrame) -> DataFrame:
    """item_id, depth, parent, path (from the root to the node) and place (from 1) of all that root (item_id) leads to, in depth-first order, children by id.

    Each node hangs on the smallest of its parents nearest to the root. Paths double in each round, so there are as many rounds as the depth has bits;
    the order of paths is the depth-first order.
    """
    found = settle(graph.first_parents(edges, root))
    paths = settle(found.select("item_id", F.col("parent").alias("up"), F.array("item_id").alias("path")))
    while paths.where("up IS NOT NULL").limit(1).count():
        above = paths.select(F.col("item_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        paths = settle(paths.join(above, "up", "left").select("item_id", F.col("_up").alias("up"), F.concat(F.coalesce("_path", F.array().cast(paths.schema["path"].dataType)), "path").alias("path")))
    whole = found.join(paths.select("item_id", "path"), "item_id").select("item_id", "depth", "parent", "path")
    return places.numbered(whole, [F.col("path")], "place")
