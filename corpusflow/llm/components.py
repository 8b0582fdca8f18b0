"""Connected components of a table of links: by union-find in one task while links are few, else by alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common

#: Links up to which one task of an executor finds the components (about 100 bytes a link).
ONE_TASK = 1_000_000


def _union_find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members and the smallest of their component; members are numbered in their order first, so that only small numbers are linked."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in held]).combine_chunks().dictionary_encode()
    order = pa.compute.sort_indices(ends.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    number = place[ends.indices.to_numpy()]
    parent = list(range(len(order)))

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while x != top:
            parent[x], x = top, parent[x]
        return top

    half = len(number) // 2
    for a, b in zip(number[:half].tolist(), number[half:].tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    least = np.array([root(x) for x in range(len(parent))], np.int64)
    members = np.flatnonzero(least != np.arange(len(least)))
    values = ends.dictionary
    yield pa.RecordBatch.from_arrays([values.take(pa.array(order[members])), values.take(pa.array(order[least[members]]))], ["a", "b"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """links (a, b; of any kind that has an order) to rows (a, b): each member but the smallest of its component, and that smallest one.

    Few links, counted first, go to one task. More take alternating large and small stars (Kiveris et al., 2014):
    each round moves every link towards the smallest member near it, the number of rounds grows with the
    logarithm of the size of components, and each round's links are a table in the shared folder.
    """
    pairs = common.materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", narrow=True)
    if pairs.count() <= one_task:
        return common.materialize(common.map_arrow(pairs.coalesce(1), _union_find, pairs.schema), "links")
    before = None
    while True:
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return pairs
        before = now
        both = pairs.union(pairs.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        pairs = common.materialize(small, "links", narrow=True)
