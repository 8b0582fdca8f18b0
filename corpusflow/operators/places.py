"""Places in an order over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.graph import settle


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place (int, from 1) of each row in an order without ties: ranges are sorted each on its own, and their sizes, one number each, are summed up."""
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = settle(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    base, before = [], 0
    for row in dealt.groupBy("_part").count().orderBy("_part").collect():  # one row a partition
        base.append((row["_part"], before))
        before += row["count"]
    at = F.create_map(*[F.lit(x) for pair in base for x in pair])[F.col("_part")] if base else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) + at
    return dealt.select(*df.columns, place.cast("int").alias(name))
