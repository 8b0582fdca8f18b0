"""Names resolved whatever their number of lengths."""

import random

from corpusflow.operators import graph, names, wiki


def test_every_length_is_resolved(spark):
    """1299 names of 1299 lengths, each the ending of one node."""
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choice("abcé字") for _ in range(n))
    wanted = [letters(8) + letters(n - 8) if n > 8 else str(n) * n for n in range(1, 1300)]
    nodes = [f"dir{i}/" + w for i, w in enumerate(wanted)]
    want = {w: (n if sum(m.endswith(w) for m in nodes) == 1 else None) for w, n in zip(wanted, nodes, strict=True)}
    found = graph.resolve_node(spark.createDataFrame([(n,) for n in nodes], "item_id string"), spark.createDataFrame([(w,) for w in wanted], "name string"))
    assert {r.name: r.item_id for r in found.collect()} == want
    assert sum(v is not None for v in want.values()) > 1280


def test_every_beginning_is_resolved(spark):
    ids = [("x" * i + "y", "page", 0) for i in range(1200)] + [("same", "page", 0), ("same", "image", 1), ("sam", "image", 1), (None, "page", 0), ("", "page", 0)]
    asked = ["x" * i + "y" for i in range(1200)] + ["xx", "sa", "same", "samey", "", None, "y"]
    found = {r.input: (r.kind, r.id, r.status) for r in wiki.resolve_ids(spark.createDataFrame([(a,) for a in asked], "input string"), spark.createDataFrame(ids, "id string, kind string, rank int")).collect()}
    assert all(found["x" * i + "y"] == ("page", "x" * i + "y", "found") for i in range(1200))
    assert found["xx"] == ("page", None, "ambiguous") and found["sa"] == ("page", "same", "found") and found["samey"] == (None, None, "missing") and found[""][2] == "missing"


def test_beginnings_are_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab😀") for _ in range(rng.randint(0, 12)))
    whole, part = [word() for _ in range(300)], [word() for _ in range(300)]
    got = names.beginnings(spark.createDataFrame([(w, i) for i, w in enumerate(whole)], "whole string, n int"), spark.createDataFrame([(p,) for p in part], "part string"), "whole", "part")
    assert sorted((r.n, r.part) for r in got.collect()) == sorted((i, p) for i, w in enumerate(whole) for p in set(part) if p and w.startswith(p))


def test_repeated_names_come_back_each(spark):
    nodes = spark.createDataFrame([("a/x",), ("b/y",), ("c/y",)], "item_id string")
    found = graph.resolve_node(nodes, spark.createDataFrame([("x",), ("x",), ("y",), ("a/x",), ("",)], "name string"))
    assert sorted((r.name, r.item_id or "-") for r in found.collect()) == [("", "-"), ("a/x", "a/x"), ("x", "a/x"), ("x", "a/x"), ("y", "-")]
