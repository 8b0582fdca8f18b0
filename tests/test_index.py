"""The stored lexical index and tables in cells."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import lexical, lexical_index
from corpusflow.sources import cells

WORDS = ["raft", "log", "leader", "vote", "quorum", "term", "node", "the", "of", "HTTPServer", "rareWord", "ü1"]


def library(spark, n, seed, first=0):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    rows = [(i, text(4), [text(2)], [text(3), text(2)], text(40)) for i in range(first, first + n)] + ([(n + first, None, [], [], None)] if not first else [])
    return spark.createDataFrame(rows, "item_id long, title string, aliases array<string>, headings array<string>, summary string")


QUERIES = ["raft leader", "the raft of raft log", "quorum", "HTTPServer vote", "nothing here", "the of", "rareWord ü1 node"]


def rows(df):
    return [tuple(r) for r in df.collect()]


def files(spark, path):
    at, store = cells._store(spark, path)
    walk, out = store.listFiles(at(path), True), {}
    while walk.hasNext():
        f = walk.next()
        if "part-" in f.getPath().getName() and f.getPath().getName().endswith(".parquet"):
            out[f.getPath().toString()] = f.getModificationTime()
    return out


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    docs, path = library(spark, 300, 1), str(tmp_path / "index")
    lexical_index.build(docs, path, buckets=8, parts=4, segment=10)
    for q in QUERIES:
        for k in (3, 1000):
            assert rows(lexical_index.search(spark, path, q, k)) == rows(lexical.search(docs, q, k)), (q, k)
    assert rows(lexical_index.plan(spark, path, QUERIES[0], 90)) == rows(lexical.plan(docs, QUERIES[0], 90))


def test_a_search_reads_its_terms_cells_only(spark, tmp_path):
    docs, path = library(spark, 100, 2), str(tmp_path / "index")
    lexical_index.build(docs, path, buckets=8, parts=4, segment=10)
    terms = ["raft", "leader"]
    wanted = {f"_bucket={lexical_index._bucket(t, 8)}/" for t in terms}
    read = {f for f in lexical_index.search(spark, path, " ".join(terms), 5).inputFiles()}
    assert read and all(any(w in f for w in wanted) for f in read)
    assert len(read) < len(files(spark, path + "/blocks"))


def test_blocks_are_skipped(spark, tmp_path):
    """One item of a segment has a score that no other segment can reach."""
    many = [(i, "", [], [], "raft") for i in range(400)] + [(1000, "raft raft raft", [], [], "raft"), (1001, "raft raft", [], [], "")]
    docs, path = spark.createDataFrame(many, "item_id long, title string, aliases array<string>, headings array<string>, summary string"), str(tmp_path / "index")
    lexical_index.build(docs, path, buckets=2, parts=2, segment=10)
    from collections import Counter

    blocks = lexical_index._asked(spark, path, Counter(["raft"]))
    assert lexical_index.open_segments(blocks, 2).count() <= 2 < lexical_index.reach(blocks).count()
    assert rows(lexical_index.search(spark, path, "raft", 2)) == rows(lexical.search(docs, "raft", 2)) == [(1000, 13), (1001, 8)]


def test_an_update_rewrites_the_parts_of_what_changed(spark, tmp_path):
    docs, path = library(spark, 400, 3), str(tmp_path / "index")
    lexical_index.build(docs, path, buckets=4, parts=32, segment=8)
    before = files(spark, path + "/blocks")
    changed = library(spark, 3, 4, first=17).unionByName(library(spark, 1, 5, first=5000))  # one in a hundred
    gone = spark.createDataFrame([(99,)], "item_id long")
    done = lexical_index.update(path, changed, gone)
    parts = {r[0] for r in lexical_index._placed(changed.select("item_id").union(gone), 32, 2).select("part").collect()}
    assert done["parts"] == len(parts) <= 5 and done["cells"] <= 4 * len(parts)
    after = files(spark, path + "/blocks")
    new = set(after) - set(before)
    assert len(new) == done["cells"] and all(int(f.split("_part=")[1].split("/")[0]) in parts for f in new)
    assert all(after[f] == before[f] for f in before if f in after)
    ids = [r[0] for r in changed.select("item_id").union(gone).collect()]
    now = docs.where(~F.col("item_id").isin(ids)).unionByName(changed)
    for q in QUERIES:
        assert rows(lexical_index.search(spark, path, q, 20)) == rows(lexical.search(now, q, 20))
    assert rows(lexical_index.plan(spark, path, QUERIES[1], 300)) == rows(lexical.plan(now, QUERIES[1], 300))
    assert lexical_index.update(path, changed.limit(0)) == {"parts": 0, "cells": 0}


def test_upserts_rewrite_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    cells.upsert(spark.range(1000).selectExpr("id AS k", "'old' AS v"), path, ["k"], buckets=64)
    before = files(spark, path)
    assert len(before) == 64
    n = cells.upsert(spark.createDataFrame([(3, "new"), (4, "new"), (5000, "new")], "k long, v string"), path, ["k"], gone=spark.createDataFrame([(7,)], "k long"))
    after = files(spark, path)
    assert n <= 4 and len(set(after) - set(before)) == n and set(before) <= set(after)  # the version before can still be read
    got = {r.k: r.v for r in cells.rows(spark, path).collect()}
    assert len(got) == 1000 and [got[k] for k in (3, 4, 5000, 5)] == ["new", "new", "new", "old"] and 7 not in got
    cells.upsert(spark.createDataFrame([(1, "again")], "k long, v string"), path, ["k"])
    cells.upsert(spark.createDataFrame([(1, "last")], "k long, v string"), path, ["k"])
    assert len(files(spark, path)) <= 66  # what neither of the two newest versions lists is gone
    assert cells.rows(spark, path).count() == 1000 and cells.upsert(spark.createDataFrame([], "k long, v string"), path, ["k"]) == 0


def test_a_crash_before_the_rename_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    cells.upsert(spark.range(10).selectExpr("id AS k", "'old' AS v"), path, ["k"], buckets=4)

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(cells, "_commit", crash)
    with pytest.raises(OSError):
        cells.upsert(spark.createDataFrame([(1, "new")], "k long, v string"), path, ["k"])
    monkeypatch.undo()
    assert {r.v for r in cells.rows(spark, path).collect()} == {"old"}
    cells.upsert(spark.createDataFrame([(2, "new")], "k long, v string"), path, ["k"])
    assert sorted(r.k for r in cells.rows(spark, path).where("v = 'new'").collect()) == [2]
    assert len(files(spark, path)) <= 5  # what the crashed writer left is gone


def test_a_whole_write_replaces_all(spark, tmp_path):
    path = str(tmp_path / "t")
    cells.write(spark.createDataFrame([(1, "a"), (2, "b")], "g int, v string"), path, ["g"])
    cells.write(spark.createDataFrame([(3, "c")], "g int, v string"), path, ["g"])
    assert rows(cells.read(spark, path)) == [(3, "c")]
    cells.write(cells.read(spark, path).where("g = 9"), path, ["g"], [("3",)])
    assert rows(cells.read(spark, path)) == [] and cells.exists(spark, path) and not cells.exists(spark, path + "x")
