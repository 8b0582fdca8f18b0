"""The name nearest to each of many others by edits, found from parts that edits leave alone.

With k edits at most, one of k + 1 parts of a name stands unchanged in what it is near to, and not far from its place
(Li et al., Pass-Join, 2011). So names and targets meet by equal parts: for one edit first, then for three, each time only those
targets for which nothing nearer was found. What is left may be as far as half its length, where parts say little:
it meets the names of fitting length that have letters enough in common.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.graph import settle

#: Edits allowed in each round.
ROUNDS = (1, 3)


def _parts(k: int) -> tuple[str, str]:
    """SQL of where part i of a name of length l begins (from 0), and how long it is."""
    short = f"({k + 1} - l % {k + 1})"  # parts of the smaller size come first
    return f"(i * (l div {k + 1}) + greatest(0, i - {short}))", f"((l div {k + 1}) + IF(i >= {short}, 1, 0))"


def name_parts(names: DataFrame, k: int) -> DataFrame:
    """name, and l, i, h of its k + 1 parts: its length, the part's number and hash. Names of k characters at most have none."""
    start, size = _parts(k)
    parts = F.expr(f"transform(sequence(0, {k}), i -> struct(length(name) AS l, i, xxhash64(substring(name, {start.replace('l ', 'length(name) ')} + 1, {size.replace('l ', 'length(name) ')})) AS h))")
    return names.where(F.length("name") > k).select("name", F.explode(parts).alias("x")).select("name", "x.l", "x.i", "x.h")


def target_parts(targets: DataFrame, k: int) -> DataFrame:
    """target, and l, i, h of all its stretches that can be part i of a name of length l within k edits: neither the edits before nor those after it are more than there can be."""
    start, size = _parts(k)
    m = "length(target)"
    low, high = f"greatest(0, {start} - i, {start} + {m} - l - ({k} - i))", f"least({m} - {size}, {start} + i, {start} + {m} - l + ({k} - i))"
    one = f"transform(filter(sequence(0, {m}), p -> p >= {low} AND p <= {high}), p -> struct(l, i, xxhash64(substring(target, p + 1, {size})) AS h))"
    every = F.expr(f"flatten(flatten(transform(sequence(greatest({k + 1}, {m} - {k}), {m} + {k}), l -> transform(sequence(0, {k}), i -> {one}))))")
    return targets.where(F.length("target") > 0).select("target", F.explode(every).alias("x")).select("target", "x.l", "x.i", "x.h")


def candidates(targets: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """target, name of all pairs that are within k edits, and of others that share a part."""
    met = target_parts(targets, k).join(name_parts(names, k), ["l", "i", "h"]).select("target", "name")
    tiny = names.where(F.length("name") <= k).withColumn("n", F.length("name"))
    lengths = targets.where(F.length("target") <= 2 * k).select("target", F.explode(F.sequence(F.greatest(F.lit(0), F.length("target") - k), F.lit(k))).alias("n"))
    return met.unionByName(lengths.where(F.col("n") <= k).join(tiny, "n").select("target", "name"))


def _nearest(pairs: DataFrame, edits: Column) -> DataFrame:
    near = pairs.withColumn("edits", edits).where("edits >= 0")
    return near.groupBy("target").agg(F.min_by("name", F.struct("edits", "name")).alias("suggestion"), F.min("edits").alias("edits"))


def _letters(name: str) -> Column:
    """A bit for each letter there, some letters sharing one."""
    return F.expr(f"aggregate(transform(split({name}, ''), c -> shiftleft(1L, pmod(ascii(c), 63))), 0L, (a, b) -> a | b)")


def _far(targets: DataFrame, names: DataFrame) -> DataFrame:
    """The nearest among all names that are near enough: half the longer one's length, 3 at least. An edit takes one letter away at most, so as many may be missing."""
    limit = F.greatest(F.lit(3), F.floor(F.greatest(F.length("target"), F.length("name")) / 2)).cast("int")
    long = F.length("target")
    low, high = long - F.greatest(F.lit(3), F.floor(long / 2).cast("int")), F.greatest(long + 3, 2 * long + 1)
    asked = targets.select("target", _letters("target").alias("_t"), F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("n"))
    pairs = names.withColumn("n", F.length("name")).withColumn("_n", _letters("name")).join(asked, "n").withColumn("_limit", limit)
    missing = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    pairs = pairs.where((missing("_t", "_n") <= F.col("_limit")) & (missing("_n", "_t") <= F.col("_limit")))
    return _nearest(pairs, F.expr("levenshtein(target, name, _limit)"))


def suggestions(broken: DataFrame, names: DataFrame) -> DataFrame:
    """target and the name nearest to it by edits, if it is near enough: half the longer one's length, 3 at least; of equally near ones the first. broken: target; names: name. Nulls take no part.

    What all names begin and end with changes no distance between two that have it, and would be a part that all share: it is left out where a target has it.
    """
    known = settle(names.select("name").where("name IS NOT NULL").distinct())
    left = settle(broken.select("target").where("target IS NOT NULL").distinct())
    ends = known.agg(F.min("name"), F.max("name"), F.min(F.reverse("name")), F.max(F.reverse("name")), F.min(F.length("name"))).first()
    head, tail = (commonprefix([x or "", y or ""]) for x, y in ((ends[0], ends[1]), (ends[2], ends[3])))
    tail = tail[: max(0, (ends[4] or 0) - len(head))][::-1]
    has = F.col("target").startswith(head) & F.col("target").endswith(tail) & (F.length("target") >= len(head) + len(tail))
    cut = lambda c: F.substr(c, F.lit(len(head) + 1), F.length(c) - len(head) - len(tail))
    out = None
    for k in ROUNDS:
        pairs = None
        for some, mine in ((left.where(has).select(cut(F.col("target")).alias("target")), known.select(cut(F.col("name")).alias("name"))), (left.where(~has), known)):
            met = candidates(some, mine, k)
            if mine is not known:
                met = met.select(F.concat(F.lit(head), "target", F.lit(tail)).alias("target"), F.concat(F.lit(head), "name", F.lit(tail)).alias("name"))
            pairs = met if pairs is None else pairs.unionByName(met)
        found = settle(_nearest(pairs, F.levenshtein("target", "name", k)))
        out = found if out is None else out.unionByName(found)
        left = settle(left.join(found.select("target"), "target", "left_anti"))
        if not left.limit(1).count():
            return out
    return out.unionByName(_far(left, known))
