"""A stored inverted index for lexical search: blocks of postings with their best, skipped where they can't reach the k-th.

A cell of the index is a bucket of terms and a part of the items; inside, each term has a block a segment of
items. A posting is an item's weighted count of the term, so an item's score is the sum of
its postings, each times how often the query repeats the term. A search reads the cells of its terms' buckets:

1. The blocks' best say what a segment can reach at most, and what one item of it has at least. The k-th largest
   of the latter, one a segment, is a threshold that the k best items reach.
2. Segments whose most is below it are skipped; the others' postings are summed.

Changed items touch their parts only, the others' files stay. Their new postings become blocks beside the stored ones, with the
number of the update as age, and a note says until which age the stored ones don't count; a search leaves those out of the blocks
that it reads. A part that has notes of more than one item in ``STALE`` is rebuilt from its stored postings instead.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import lexical, many
from corpusflow.sources import cells

#: Buckets of terms, and items of a segment, about.
TERM_BUCKETS, SEGMENT = 32, 256
#: Items for which there is a part, and parts at most: each has a file a bucket.
PART_ITEMS, MOST_PARTS = 16_384, 512
#: Entries that become blocks at once, about, and tasks for each part, so that few tasks have several.
SLICE, SPREAD = 2048, 4
#: A part is rebuilt when its notes are more than one for so many items, so that a rebuilt item pays for no more than these.
STALE = 8


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _placed(df: DataFrame, parts: int, segments: int) -> DataFrame:
    """df with each item's segment, and the part that holds it."""
    segment = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(parts * segments))
    return df.withColumn("segment", segment.cast("int")).withColumn("part", (F.col("segment") % parts).cast("int"))


def _blocks(entries: DataFrame, parts: int, segments: int, weights: dict[str, int]) -> DataFrame:
    """part, term, segment, best, postings: entries are dealt out whole, a part a task, and become blocks a segment at a time."""
    kind = entries.schema["item_id"].dataType.simpleString()

    def blocks(rows: pa.RecordBatch) -> pa.RecordBatch:
        lengths = pc.list_value_length(rows.column(2)).to_numpy()
        row = np.repeat(np.arange(rows.num_rows), lengths)
        coded = pc.dictionary_encode(rows.column(2).flatten())
        code, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
        key = rows.column(1).to_numpy().astype(np.int64)[row] * size + code
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        impact = rows.column(3).flatten().take(pa.array(order))
        best = np.maximum.reduceat(impact.to_numpy(), first) if len(first) else first
        held = pa.StructArray.from_arrays([rows.column(0).take(pa.array(row[order])), impact], ["item_id", "impact"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), held)
        term = coded.dictionary.take(pa.array(key[first] % size))
        return pa.RecordBatch.from_arrays([term, pa.array(key[first] // size, pa.int32()), pa.array(best, pa.int64()), lists], ["term", "segment", "best", "postings"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # the rows of the segment that is open
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                segment = part.column(1).to_numpy()
                start = int(np.searchsorted(segment, segment[-1]))
                if start or (left and left[-1].column(1)[0].as_py() != segment[-1]):
                    yield blocks(pa.concat_batches([*left, part.slice(0, start)]))
                    left = []
                left.append(part.slice(start))
        if left:
            yield blocks(pa.concat_batches(left))

    rows = _placed(many.counted(entries, weights), parts, segments).select("item_id", "segment", "terms", "impacts", "part")
    dealt = rows.repartition(SPREAD * parts, "part").sortWithinPartitions("segment").drop("part")
    made = dealt.mapInArrow(run, f"term string, segment int, best bigint, postings array<struct<item_id:{kind},impact:bigint>>")
    return made.select((F.col("segment") % parts).cast("int").alias("part"), "term", "segment", "best", "postings")


def _write(blocks: DataFrame, path: str, buckets: int, touched: Iterable[cells.Cell] | None = None, meta: dict[str, str] | None = None, age: int = 0) -> int:
    """Blocks, each part's in one task, to the cells of the index: in the place of the touched ones, and beside the others."""
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int").alias("bucket")
    rows = blocks.select(bucket, "part", "term", "segment", F.lit(age).alias("age"), "best", "postings")
    return cells.write(rows, f"{path}/blocks", ["bucket", "part"], touched, meta, dealt=True, order=["term", "segment"])


def _items(entries: DataFrame, parts: int, segments: int) -> DataFrame:
    """What a plan must know of an item beside its score."""
    text = F.concat_ws(" ", "title", F.array_join("aliases", " "), F.array_join("headings", " "), "summary")
    return _placed(entries.select("item_id", T.entry_estimate(text).alias("tokens")), parts, segments).drop("segment")


def build(entries: DataFrame, path: str, buckets: int = TERM_BUCKETS, parts: int | None = None, segment: int = SEGMENT, weights: dict[str, int] = lexical.WEIGHTS) -> None:
    """Write the index of all entries (item_id unique) to a folder. What is there already gives way; notes on it are older than the new blocks."""
    n = entries.count()
    spark, folders = entries.sparkSession, (f"{path}/blocks", f"{path}/notes")
    ages = [int(cells.manifest(spark, f).meta.get("age", 0)) for f in folders if cells.exists(spark, f)]
    age = max(ages) + 1 if ages else 0
    parts = parts or max(1, min(MOST_PARTS, -(-n // PART_ITEMS)))
    segments = max(1, -(-n // (parts * segment)))
    meta = {"buckets": str(buckets), "parts": str(parts), "segments": str(segments)}
    cells.write(_items(entries, parts, segments), f"{path}/items", ["part"], meta=meta)
    meta |= {"age": str(age)} | ({f"rebuilt {p}": str(age) for p in range(parts)} if age else {})
    _write(_blocks(entries, parts, segments, weights), path, buckets, meta=meta, age=age)


def _notes(spark: SparkSession, path: str, of: cells.Manifest) -> DataFrame | None:
    """part, segment, item_id, until: an item's postings in blocks of a smaller age don't count. None if nothing was ever changed; notes of an update that didn't end are left out."""
    if not int(of.meta.get("age", 0)) or not cells.exists(spark, f"{path}/notes"):
        return None
    return cells.read(spark, f"{path}/notes").where(F.col("until") <= int(of.meta["age"]))


def _valid(blocks: DataFrame, notes: DataFrame | None) -> DataFrame:
    """Blocks with the postings that count, and the best of these."""
    if notes is None:
        return blocks
    held = notes.groupBy("segment", "item_id").agg(F.max("until").alias("until"))
    held = held.groupBy("segment").agg(F.collect_list(F.struct("item_id", "until")).alias("out"))  # no more than a segment's items
    out = F.transform(F.filter("out", lambda o: o["until"] > F.col("age")), lambda o: o["item_id"])
    kept = F.when(F.size("_out") > 0, F.filter("postings", lambda p: ~F.array_contains("_out", p["item_id"]))).otherwise(F.col("postings"))
    rows = blocks.join(held, "segment", "left").withColumn("_out", out)
    rows = rows.withColumn("postings", kept).where(F.size("postings") > 0)
    return rows.withColumn("best", F.array_max(F.transform("postings", lambda p: p["impact"]))).select(*blocks.columns)


def update(path: str, changed: DataFrame, gone: DataFrame | None = None, weights: dict[str, int] = lexical.WEIGHTS) -> dict[str, int]:
    """Put changed and new entries into the index, and take those away that are gone (item_id). Only the parts of these items are touched: they get blocks and notes beside what they hold, or are rebuilt if they have many notes. Returns how many parts, and how many cells were written."""
    spark = changed.sparkSession
    of = cells.manifest(spark, f"{path}/blocks")
    buckets, parts, segments = (int(of.meta[k]) for k in ("buckets", "parts", "segments"))
    age = int(of.meta.get("age", 0)) + 1
    ids = changed.select("item_id")
    ids = _placed((ids.unionByName(gone.select("item_id")) if gone is not None else ids).distinct(), parts, segments)
    arriving = {str(r[0]): r[1] for r in ids.groupBy("part").count().collect()}  # as many numbers as there are parts, at most
    if not arriving:
        return {"parts": 0, "cells": 0}
    old = _notes(spark, path, of)
    torn = cells.exists(spark, f"{path}/notes") and int(cells.manifest(spark, f"{path}/notes").meta["age"]) >= age  # an update wrote its notes and didn't end
    rebuilt = {k.split()[1]: int(v) for k, v in of.meta.items() if k.startswith("rebuilt ")}
    stored_items = cells.read(spark, f"{path}/items", lambda cell: cell[0] in arriving)
    items = {str(r[0]): r[1] for r in stored_items.groupBy("part").count().collect()}
    notes = dict(arriving)
    note = ids.select("part", "segment", "item_id", F.lit(age).alias("until"))
    if old is not None:
        for part, until, n in old.groupBy("part", "until").count().collect():  # a number for each part and update
            if str(part) in notes and until > rebuilt.get(str(part), 0):
                notes[str(part)] += n
        kept = old if torn else old.where(F.col("part").isin(*map(int, arriving)))
        past = [F.lit(x) for p, at in rebuilt.items() if at < age - 1 for x in (int(p), at)]  # else the version before the rebuilding can still be read
        note = note.unionByName(kept.where(F.col("until") > F.coalesce(F.create_map(*past)[F.col("part")], F.lit(0))) if past else kept)
    whole = {p for p, n in notes.items() if n * STALE > items.get(p, 0)}
    cells.write(note, f"{path}/notes", ["part"], None if torn else [(p,) for p in arriving], {"age": str(age)})
    rows = _blocks(changed, parts, segments, weights)
    if whole:
        stored = cells.read(spark, f"{path}/blocks", lambda cell: cell[1] in whole, of)
        now = cells.read(spark, f"{path}/notes", lambda cell: cell[0] in whole)
        rows = _valid(stored, now).select("part", "term", "segment", "best", "postings").unionByName(rows).repartition(SPREAD * parts, "part")
        rows = rows.groupBy("part", "term", "segment").agg(F.max("best").alias("best"), F.flatten(F.collect_list("postings")).alias("postings"))
    items = stored_items.join(ids.select("item_id"), "item_id", "left_anti")
    cells.write(items.unionByName(_items(changed, parts, segments)), f"{path}/items", ["part"], [(p,) for p in arriving])
    meta = {"age": str(age)} | {f"rebuilt {p}": str(age) for p in whole}
    written = _write(rows, path, buckets, [cell for cell in map(of.cell, of.cells) if cell[1] in whole], meta, age)
    return {"parts": len(arriving), "cells": written}


def _asked(spark: SparkSession, path: str, terms: Counter) -> DataFrame:
    """The blocks of some terms, with how often each counts."""
    of = cells.manifest(spark, f"{path}/blocks")
    wanted = {str(_bucket(t, int(of.meta["buckets"]))) for t in terms}
    blocks = cells.read(spark, f"{path}/blocks", lambda cell: cell[0] in wanted, of)
    times = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])[F.col("term")]
    return _valid(blocks.where(F.col("term").isin(list(terms))), _notes(spark, path, of)).withColumn("times", times)


def reach(blocks: DataFrame) -> DataFrame:
    """segment, most (what an item of it can score), least (what some item of it scores at least)."""
    best = F.col("best") * F.col("times")
    return blocks.groupBy("segment").agg(F.sum(best).alias("most"), F.max(best).alias("least"))


def open_segments(blocks: DataFrame, k: int) -> DataFrame:
    """The segments whose items can be among the best k, ties included."""
    bounds = reach(blocks)
    least = [r["least"] for r in bounds.select("least").orderBy(F.desc("least")).limit(k).collect()]  # k numbers
    return bounds.where(F.col("most") >= (least[-1] if len(least) == k else 0)).select("segment")


def search(spark: SparkSession, path: str, query: str, k: int = 10) -> DataFrame:
    """item_id and score of the best k, ties by id: the rows of ``lexical.search``."""
    terms = Counter(T.query_terms(query))
    if not terms:
        of = cells.manifest(spark, f"{path}/items")
        return spark.createDataFrame([], of.schema).select("item_id", F.lit(0).cast("long").alias("score"))
    blocks = _asked(spark, path, terms)
    left = blocks.join(open_segments(blocks, k), "segment", "left_semi")
    scored = left.select("times", F.explode("postings").alias("p")).groupBy(F.col("p.item_id").alias("item_id")).agg(F.sum(F.col("p.impact") * F.col("times")).alias("score"))
    return scored.orderBy(F.desc("score"), "item_id").limit(k)


def plan(spark: SparkSession, path: str, query: str, budget: int) -> DataFrame:
    """position, item_id, score, tokens of the entries to read within the budget: the rows of ``lexical.plan``."""
    best = search(spark, path, query, lexical.PLAN_CANDIDATES)
    priced = best.join(cells.read(spark, f"{path}/items").select("item_id", "tokens"), "item_id")
    return lexical.within_budget(priced, budget, [F.desc("score"), F.col("item_id")])
