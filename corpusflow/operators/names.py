"""Names that begin other names, met by equality however many lengths there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beginnings(known: DataFrame, wanted: DataFrame, whole: str, part: str) -> DataFrame:
    """All pairs of a row of known and a different ``part`` of wanted (not null, not empty) with which its ``whole`` begins.

    A name meets what is asked for by its first 1, 2, 4, 8, ... characters, a row for each; these say which lengths,
    up to the next power of two, are asked for behind them, and only for those its beginning is looked up.
    """
    asked = wanted.select(part).where(F.length(part) > 0).distinct()
    power = lambda n: F.length(F.bin(n)) - 1
    heads = asked.select(F.length(part).alias("_n"), power(F.length(part)).alias("_p"), part)
    heads = heads.select("_n", "_p", F.xxhash64(F.substr(part, F.lit(1), F.expr("shiftleft(1, _p)"))).alias("_head"))
    heads = heads.groupBy("_p", "_head").agg(F.collect_set("_n").alias("_lengths"))  # fewer than 2 ** _p
    each = known.where(F.length(whole) > 0).select("*", F.explode(F.sequence(F.lit(0), power(F.length(whole)))).alias("_p"))
    each = each.withColumn("_head", F.xxhash64(F.substr(whole, F.lit(1), F.expr("shiftleft(1, _p)"))))
    met = each.join(heads, ["_p", "_head"]).select(*known.columns, F.explode(F.filter("_lengths", lambda n: n <= F.length(whole))).alias("_n"))
    return met.withColumn(part, F.substr(F.col(whole), F.lit(1), F.col("_n"))).drop("_n").join(asked, part)
