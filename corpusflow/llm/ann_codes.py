"""Operator 1: nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, rotated by a random orthogonal matrix and reduced to the signs of
their coordinates, packed into 64-bit words, with three numbers each: the distance to the
centre, the inner product of the unit vector with its code (which makes the estimate
unbiased), and the inner product with the centre. A query is centred and rotated too, and its
coordinates become small integers, a bit plane each; its inner product with a vector is
estimated by counting the bits that planes and code share. The theory bounds the error in
probability.

1. Queries meet the codes, block by block: the best estimates of each query.
2. Those are scored exactly. A query's k-th best score is its threshold.
3. Queries meet the codes again: vectors whose upper bound reaches the threshold are survivors.
4. Survivors are scored exactly, each block of original vectors with the survivors it holds.

Codes take dim / 8 + 24 bytes a vector, survivors a bit at most; original vectors only meet what the
bounds have chosen. A block of queries and a block of codes are one unit of work with bounded memory.

Vectors without an id, or that are null, zero, of another length than most (of equally frequent lengths the
shorter counts), or that hold null or non-finite components take no part. Ties go to the smaller id; a query's own
row is no candidate (all rows of that id). Rows of one query id are one query, which has the k best of all their pairs; other rows of an id are candidates each.
Other columns, whatever their names, are not looked at. A query without candidates has no rows, and an empty table makes none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import common

#: Vectors in a block of the index, and queries in a block of queries.
INDEX_BLOCK = 8192
QUERY_BLOCK = 1024
#: Blocks of queries whose survivors meet a block of original vectors in one task.
TOGETHER = 8
#: Width of the error bounds, in units of the estimate's spread; at 2.5 about 1 bound in 100 is too narrow.
EPSILON = 2.5
#: The best estimates, as a multiple of k, that give the threshold.
FIRST = 3
#: Bit planes of a query's coordinates.
PLANES = 6

BLOCK = "block long, n int, ids binary, vectors binary, bits binary, numbers binary"


@dataclass(frozen=True)
class Frame:
    """What all codes share: the rotation and the centre."""

    rotation: np.ndarray
    centre: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.centre)

    @property
    def words(self) -> int:
        return -(-self.dim // 64)


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(frame: Frame, bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), frame.words * 64), bool)
    wide[:, : frame.dim] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(frame: Frame, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed bits, numbers): the numbers are the residual's length, the code's inner product with its direction, and the vector's inner product with the centre."""
    residual = vectors.astype(np.float64) - frame.centre
    length = np.linalg.norm(residual, axis=1)
    turned = (residual / np.maximum(length, 1e-30)[:, None]) @ frame.rotation.T
    fit = np.abs(turned).sum(1) / np.sqrt(frame.dim)
    return _packed(frame, turned > 0), np.stack([length, np.maximum(fit, 1e-6), vectors.astype(np.float64) @ frame.centre], axis=1)


def estimates(frame: Frame, bits: np.ndarray, numbers: np.ndarray, queries: np.ndarray, bounds: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each query the estimated inner products with all codes, and (if asked for) how far these may be off."""
    length, fit, along = numbers.T
    reach = length / fit
    scale = (reach / np.sqrt(frame.dim)).astype(np.float32)
    code = (reach**2 * np.maximum(0, 1 - fit * fit) / max(1, frame.dim - 1)).astype(np.float32)  # variances of what the codes and the planes leave out
    plane_of = (reach**2 / 12).astype(np.float32)
    along = along.astype(np.float32)
    columns = [np.ascontiguousarray(bits[:, w]) for w in range(frame.words)]
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64).astype(np.float32)
    counts = np.uint16 if frame.words * 64 << PLANES <= 1 << 16 else np.uint32
    queries = queries.astype(np.float64)
    turned = (queries - frame.centre) @ frame.rotation.T
    lows, norms = turned.min(1), np.linalg.norm(turned, axis=1)
    steps = np.maximum((turned.max(1) - lows) / ((1 << PLANES) - 1), 1e-30)
    levels = np.rint((turned - lows[:, None]) / steps[:, None]).astype(np.uint8)
    planes = np.stack([_packed(frame, (levels >> j & 1).astype(bool)) for j in range(PLANES)], axis=1)
    base = queries @ frame.centre - frame.centre @ frame.centre
    for q in range(len(queries)):
        shared = np.zeros(len(bits), counts)
        for j in range(PLANES):
            for w, column in enumerate(columns):
                shared += np.left_shift(np.bitwise_count(column & planes[q, j, w]), j, dtype=counts)
        total = steps[q] * float(levels[q].sum()) + frame.dim * lows[q]
        product = np.float32(2 * steps[q]) * shared + np.float32(2 * lows[q]) * ones - np.float32(total)  # of the rounded query with the signs
        off = np.float32(EPSILON) * np.sqrt(np.float32(norms[q] ** 2) * code + np.float32(steps[q] ** 2) * plane_of) if bounds else None
        yield product * scale + along + np.float32(base[q]), off


def usable(vector: Column) -> Column:
    """No null, zero or non-finite vector, and no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _blocks(rows: DataFrame, size: int, frame: Frame | None) -> DataFrame:
    """Rows of (vec_id, v) as blocks of at most size; codes are added where a frame is given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held]).astype("<i8")
            vectors = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held]).astype("<f4").reshape(len(ids), -1)
            bits, numbers = encode(frame, vectors) if frame else (np.empty(0, np.uint64), np.empty(0))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(ids)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, bits, numbers.astype("<f8"))]], [f.split()[0] for f in BLOCK.split(", ")])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == size:
                    yield made(held)
                    held, block = [], block + 1
        if held:
            yield made(held)

    return common.map_arrow(rows, run, BLOCK)


def _pack_places(at: np.ndarray, n: int) -> bytes:
    """Places below n, as a list or as bits, whichever is shorter."""
    width = "<u2" if n <= 1 << 16 else "<u4"
    if len(at) * np.dtype(width).itemsize <= -(-n // 8):
        return b"\0" + at.astype(width).tobytes()
    chosen = np.zeros(n, bool)
    chosen[at] = True
    return b"\1" + np.packbits(chosen).tobytes()


def _places(raw: bytes, n: int) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(raw, "<u2" if n <= 1 << 16 else "<u4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=n))


_FOUND = "block long, together long, query_id long, q binary, places binary"


def _met(pairs: DataFrame, frame: Frame, choose, bounds: bool) -> DataFrame:
    """What choose(ids, query's id, its threshold, estimates, how far these may be off) takes of each block, for each query: the places of vectors."""
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                bits, numbers = np.frombuffer(r["bits"], np.uint64).reshape(len(ids), -1), np.frombuffer(r["numbers"], "<f8").reshape(-1, 3)
                queries = np.frombuffer(r["q_vectors"], "<f4").reshape(len(q_ids), -1)
                least = np.frombuffer(r["least"], "<f8") if r["least"] is not None else np.full(len(q_ids), -np.inf)
                rows = []
                for i, (estimate, off) in enumerate(estimates(frame, bits, numbers, queries, bounds)):
                    at = choose(ids, q_ids[i], least[i], estimate, off)
                    if len(at):
                        rows.append((int(q_ids[i]), queries[i].tobytes(), _pack_places(at, len(ids))))
                if rows:
                    q, vector, places = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(rows), pa.int64()), pa.array([r["together"]] * len(rows), pa.int64()), pa.array(q, pa.int64()), pa.array(vector, pa.binary()), pa.array(places, pa.binary())], names)

    return common.map_arrow(pairs, run, _FOUND)


def _scored(found: DataFrame, originals: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: exactly, the best k of each block for each query."""
    schema = "query_id long, vec_id long, score double"

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        ids = np.frombuffer(block["ids"][0].as_py(), "<i8")
        vectors = np.frombuffer(block["vectors"][0].as_py(), "<f4").reshape(len(ids), -1)
        of, which, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for query, q, places in zip(asked["query_id"].to_pylist(), asked["q"].to_pylist(), asked["places"].to_pylist(), strict=True):
            at, vector = _places(places, len(ids)), np.frombuffer(q, "<f4").astype(np.float64)
            if len(at) > 2 * k:  # a product of matrices first, whose last digits may differ between equal vectors
                rough = vectors[at].astype(np.float64) @ vector
                least = np.partition(rough, len(at) - k)[len(at) - k]
                at = at[rough >= least - 1e-9 * (1 + np.abs(rough).max())]
            score = (vectors[at].astype(np.float64) * vector).sum(1)
            best = np.lexsort((ids[at], -score))[:k]
            of.append(np.full(len(best), query))
            which.append(ids[at[best]])
            scores.append(score[best])
        return pa.table({"query_id": np.concatenate(of), "vec_id": np.concatenate(which), "score": np.concatenate(scores)})

    wanted = found.select(F.col("block").alias("b"), F.col("together").alias("t")).distinct().join(originals.withColumnRenamed("block", "b"), "b")
    return wanted.groupBy("b", "t").cogroup(found.groupBy("block", "together")).applyInArrow(run, schema)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds its k nearest by inner product."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"), is_query.alias("q"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims[0]["d"]
    rows = rows.where(F.size("v") == dim)
    centre = rows.select(*[F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(dim)]).first()
    frame = Frame(rotation(dim), np.array(centre, np.float64))
    total = rows.agg(F.count("*"), F.count_if("q")).first()
    n_blocks, n_queries = -(-total[0] // index_block), max(1, -(-total[1] // query_block))
    dealt = lambda df, n: df.select("vec_id", "v").repartition(n)  # noqa: E731  round robin: blocks of about equal size
    index = common.materialize(_blocks(dealt(rows, n_blocks), 2 * index_block, frame), "ann-index")
    asked = common.materialize(_blocks(dealt(rows.where("q"), n_queries), 2 * query_block, None), "ann-queries")
    asked = asked.select(F.col("block").alias("number"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).withColumn("together", F.floor(F.shiftright("number", 32) / TOGETHER))
    codes, originals = index.select("block", "ids", "bits", "numbers"), index.select("block", "ids", "vectors")
    tasks = max(1, common.shuffle_partitions(spark))

    def meet(queries: DataFrame, choose, bounds: bool) -> DataFrame:
        pairs = queries.select("together", "q_ids", "q_vectors", "least").crossJoin(codes)  # of blocks: a stated query set against all rows
        return _met(pairs.repartition(tasks), frame, choose, bounds)

    def highest(ids: np.ndarray, query: int, least: float, estimate: np.ndarray, off: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(ids != query)
        return at if len(at) <= FIRST * k else at[np.argpartition(estimate[at], len(at) - FIRST * k)[len(at) - FIRST * k :]]

    def reaching(ids: np.ndarray, query: int, least: float, estimate: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.flatnonzero((estimate + off >= least) & (ids != query))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = _scored(meet(asked.withColumn("least", F.lit(None).cast("binary")), highest, False), originals, k)
    first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least")).distinct()
    thresholds = common.materialize(first, "ann-thresholds")  # queries with fewer than k candidates have none, and all survive

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["q_ids"], "<i8")
                of = dict(zip(r["t_ids"] or [], r["t_least"] or [], strict=True))
                least = np.array([of.get(i, -np.inf) for i in ids.tolist()], "<f8")
                yield pa.RecordBatch.from_arrays([pa.array([r["together"]], pa.int64()), pa.array([r["q_ids"]], pa.binary()), pa.array([r["q_vectors"]], pa.binary()), pa.array([least.tobytes()], pa.binary())], ["together", "q_ids", "q_vectors", "least"])

    # each query's threshold goes to the block that the query is in
    homes = common.map_arrow(asked.select("number", "q_ids"), _members, "number long, query_id long")
    by_block = homes.join(thresholds, "query_id").groupBy("number").agg(F.collect_list("query_id").alias("t_ids"), F.collect_list("least").alias("t_least"))
    ready = common.map_arrow(asked.join(by_block, "number", "left").select("together", "q_ids", "q_vectors", "t_ids", "t_least"), known, "together long, q_ids binary, q_vectors binary, least binary")
    found = _scored(meet(common.materialize(ready, "ann-asked"), reaching, True), originals, k)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(raw, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(ids)], ["number", "query_id"])
