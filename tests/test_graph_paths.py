"""Forward push, cycles and depth-first trees against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import graph, graph_paths, push, small_graphs
from corpusflow.sources import cells


def edges_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src_id string, dst_id string")


def random_edges(rng, n, m, name="n"):
    return {(f"{name}{rng.randrange(n):03}", f"{name}{rng.randrange(n):03}") for _ in range(m)}


@pytest.mark.parametrize("rounds,epsilon", [(3, 0.0), (12, 2e-2)])
def test_push_ranks_as_all_edges_do(spark, tmp_path, rounds, epsilon):
    rng = random.Random(1)
    edges = edges_of(spark, random_edges(rng, 60, 150) | {("n001", "sink"), ("n002", "sink")})
    seeds = spark.createDataFrame([("n001",), ("n001",), ("n007",), ("sink",), ("nowhere",)], "item_id string")
    push.store_links(edges, str(tmp_path / "g"), 8)
    got = {r.item_id: r.score for r in push.pagerank(spark, str(tmp_path / "g"), seeds, rounds=rounds, epsilon=epsilon).collect()}
    want = {r.item_id: r.score for r in graph.pagerank(edges, seeds, rounds=rounds, epsilon=epsilon).where("score > 0").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < (1e-12 if not epsilon else 1e-4) for k in want)
    assert push.pagerank(spark, str(tmp_path / "g"), seeds.where("item_id = 'nowhere'")).count() == 0


def test_push_reads_no_links_of_the_other_half(spark, tmp_path, monkeypatch):
    """Two halves in cells of their own: no round reads those of the half without seeds."""
    rng = random.Random(2)
    names = [f"x{i}" for i in range(400)]
    bucket = {r.item_id: r.bucket for r in push._dealt(spark.createDataFrame([(x,) for x in names], "item_id string"), "item_id", 8).collect()}
    low, high = ([x for x in names if (bucket[x] < 4) == side] for side in (True, False))
    pairs = {(rng.choice(half), rng.choice(half)) for half in (low, high) for _ in range(300)}
    push.store_links(edges_of(spark, pairs), str(tmp_path / "g"), 8)
    read = set()
    real = cells.read

    def watched(spark, path, wanted=None, of=None):
        of = of or cells.manifest(spark, path)
        read.update(of.cell(name)[0] for name in of.cells if wanted is None or wanted(of.cell(name)))
        return real(spark, path, wanted, of)

    monkeypatch.setattr(cells, "read", watched)
    seed = sorted(p[0] for p in pairs if p[0] in set(low))[0]
    got = push.pagerank(spark, str(tmp_path / "g"), spark.createDataFrame([(seed,)], "item_id string"), rounds=4).collect()
    assert got and {r.item_id for r in got} <= set(low) and read <= {"0", "1", "2", "3"}


def test_starts_without_edges_stay_out_of_the_task(spark, monkeypatch):
    given = []
    real = small_graphs.closure
    monkeypatch.setattr(small_graphs, "closure", lambda start, edges: given.append(start.count()) or real(start, edges))
    start = spark.range(5000).selectExpr("'s' || id AS item_id").union(spark.createDataFrame([("a",)], "item_id string"))
    got = graph.closure(edges_of(spark, {("a", "b"), ("b", "c"), ("x", "y")}), start)
    assert given == [1] and got.count() == 5003 and {r.item_id: r.depth for r in got.where("NOT startswith(item_id, 's')").collect()} == {"a": 0, "b": 1, "c": 2}


def plain_core(pairs):
    nodes = {x for p in pairs for x in p}
    while True:
        inside = {(a, b) for a, b in pairs if a in nodes and b in nodes}
        keep = {a for a, _ in inside} & {b for _, b in inside}
        if keep == nodes:
            return nodes
        nodes = keep


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("seed", range(3))
def test_cycles(spark, monkeypatch, seed, few):
    monkeypatch.setattr(small_graphs, "FEW_EDGES", few)
    rng = random.Random(seed)
    pairs = random_edges(rng, 14, 16) if seed else {("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "e"), ("z", "a"), ("d", "q")}
    if few == 0 and seed:
        return  # each round is a table: one graph will do
    edges = edges_of(spark, pairs)
    assert {r.item_id for r in graph_paths.core(edges).collect()} == plain_core(pairs)
    path = [r.item_id for r in graph_paths.cycle(edges).orderBy("position").collect()]
    assert bool(path) == bool(plain_core(pairs))
    if path:
        assert path[0] == min(path) and len(set(path)) == len(path)
        assert all(p in pairs for p in zip(path, path[1:] + path[:1], strict=True))
    if not seed:
        assert path == ["b", "c", "d"]


def test_no_cycle(spark):
    edges = edges_of(spark, {("a", "b"), ("b", "c"), ("a", "c")})
    assert graph_paths.core(edges).count() == graph_paths.cycle(edges).count() == graph_paths.cycle(edges.limit(0)).count() == 0


def test_trees_are_in_depth_first_order(spark):
    rng = random.Random(6)
    pairs = {(f"n{rng.randrange(i):02}", f"n{i:02}") for i in range(1, 50) for _ in range(2)} | {("n40", "n03"), ("n02", "n02")} | {(f"n{i}", f"n{i + 1}") for i in range(60, 80)}
    edges = edges_of(spark, pairs)
    depth, front = {"n00": 0}, ["n00"]
    while front:
        step = sorted({b for a, b in pairs if a in front} - depth.keys())
        depth |= dict.fromkeys(step, depth[front[0]] + 1)
        front = step
    parent = {x: min(a for a, b in pairs if b == x and depth.get(a) == depth[x] - 1) for x in depth if x != "n00"}
    want = []

    def walk(x, path):
        want.append((x, depth[x], parent.get(x), [*path, x]))
        for y in sorted(y for y in parent if parent[y] == x):
            walk(y, [*path, x])

    walk("n00", [])
    got = graph_paths.tree(edges, spark.createDataFrame([("n00",)], "item_id string")).orderBy("place").collect()
    assert [(r.item_id, r.depth, r.parent, list(r.path)) for r in got] == want and [r.place for r in got] == list(range(1, len(want) + 1))
    chain = graph_paths.tree(edges, spark.createDataFrame([("n60",)], "item_id string")).agg(F.max(F.size("path"))).first()[0]
    assert chain == 21
