"""Nearest names by edits against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import nearest_names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(targets, names):
    out = {}
    for t in set(targets) - {None}:
        near = sorted((e, n) for n in set(names) - {None} if (e := edits(t, n)) <= max(3, max(len(t), len(n)) // 2))
        if near:
            out[t] = (near[0][1], near[0][0])
    return out


def words(rng, n, letters, longest):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def changed(rng, w):
    for _ in range(rng.randint(0, 4)):
        at, c = rng.randint(0, len(w)), rng.choice("abcé字x")
        w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
    return w


@pytest.mark.parametrize("seed,head,tail", [(1, "", ""), (2, "wiki/", ".md"), (3, "aa", "a")])
def test_suggestions(spark, seed, head, tail):
    rng = random.Random(seed)
    names = [head + w + tail for w in words(rng, 60, "abcé字", 9) + words(rng, 60, "abcdefghij", 16)]
    targets = [changed(rng, rng.choice(names)) for _ in range(60)] + words(rng, 20, "abxyz", 12) + ["", None, head, head + tail, head[:-1] + tail]
    got = nearest_names.suggestions(spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string"))
    assert {r.target: (r.suggestion, r.edits) for r in got.collect()} == plain(targets, names)


@pytest.mark.parametrize("k", [1, 3])
def test_parts_find_all_within_k(spark, k):
    rng = random.Random(k)
    names = sorted(set(words(rng, 150, "ab", 9)))
    targets = sorted({changed(rng, rng.choice(names)) for _ in range(100)})
    met = {(r.target, r.name) for r in nearest_names.candidates(spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame([(n,) for n in names], "name string"), k).collect()}
    assert met >= {(t, n) for t in targets for n in names if edits(t, n) <= k}


def test_candidates_are_few(spark):
    """A hundred thousand names, and targets one to three edits away from some."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(10, 24))) for _ in range(100_000)]
    targets = [changed(rng, rng.choice(names)) for _ in range(500)]
    known, asked = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in targets], "target string")
    for k, most in ((1, 3), (3, 400)):
        assert nearest_names.candidates(asked, known, k).distinct().count() <= most * len(targets), k


def test_no_names_and_no_targets(spark):
    none = spark.createDataFrame([], "target string"), spark.createDataFrame([], "name string")
    one = spark.createDataFrame([("abc",)], "target string"), spark.createDataFrame([("abd",)], "name string")
    assert nearest_names.suggestions(none[0], one[1]).count() == nearest_names.suggestions(one[0], none[1]).count() == 0
    assert nearest_names.suggestions(*one).where(F.col("edits") == 1).count() == 1
