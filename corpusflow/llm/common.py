"""Helpers shared by the training-data operators: tables, the shared workspace, and file access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

T = TypeVar("T")

#: Documents handled at once inside a Python worker; bounds its memory whatever the Arrow batch holds.
SLICE_ROWS = 512
#: Bytes of text handled at once, for slices of very long documents.
SLICE_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI; ``spark.checkpoint.dir`` of the session. Only a local session, where all run on one machine, may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/corpusflow-shared"
        spark.sparkContext.setCheckpointDir(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString().rstrip("/")


_MADE: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root, as a URI."""
    _MADE.append(f"{shared_root(spark)}/corpusflow/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_workspaces(spark: SparkSession) -> None:
    """Delete all folders that this process has made; results that were not written elsewhere can't be read after that."""
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a row group of intermediate tables: what a writing task holds back, and a reading one takes at once.
ROW_GROUP = 16 << 20


def materialize(df: DataFrame, name: str, free: bool = False, narrow: bool = False) -> DataFrame:
    """Write once to the shared workspace and read back: cuts lineage and survives lost executors.

    free: let Spark's cleaner delete shuffle files that nothing refers to any more; worth it after large shuffles.
    narrow: rows are few dozen bytes for a document at most, so eight partitions of what is sized for texts make one file.
    """
    spark, schema = df.sparkSession, df.schema
    path = workspace(spark, name)
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 8))
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def stored_bytes(df: DataFrame) -> int | None:
    """The size that Spark knows of what is under df; None where it knows nothing."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


#: Stored bytes of texts for which there is a task, at most, where tasks enough for all cores remain.
TASK_BYTES = 16 << 20


def few_tasks(df: DataFrame) -> DataFrame:
    """df, not in more tasks than its stored bytes are worth: tiny splits would make as many tiny files. Large tables keep their splits."""
    size = stored_bytes(df)
    return df if size is None else df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


#: Rows and bytes up to which a side may be broadcast.
SMALL_ROWS, SMALL_BYTES = 500_000, 32 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows are few and so are the bytes of the table under it; else Spark shuffles both sides."""
    size = stored_bytes(df)
    return F.broadcast(df) if size is not None and size <= SMALL_BYTES and df.count() <= SMALL_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of an Arrow batch between the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow; the session's batches become small ones, as a batch of very long texts would fill a worker."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"\d+$", str(conf.get(key, None)))
        if now is None or not 0 < int(now[0]) <= most:
            conf.set(key, most)
    return df.mapInArrow(fn, schema)


_RESIDENT: dict[str, object] = {}


def resident(name: str, build: Callable[[], T]) -> T:
    """What this Python worker keeps between tasks under a name: one thing at a time, so that what other stages left behind makes room."""
    if name not in _RESIDENT:
        _RESIDENT.clear()
        trim()
        _RESIDENT[name] = build()
    return _RESIDENT[name]


def trim() -> None:
    """Give memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def fresh_name(taken: Iterable[str], wish: str) -> str:
    """A column name like wish that isn't taken."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows (file, hdfs, s3, gs) by its URI."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def texts_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", named: bool = False) -> DataFrame:
    """Just the id and the text (null: empty), whatever other columns there are. named: rows without an id are left out."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return out.where("doc_id IS NOT NULL") if named else out


def sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """Rows with the smallest hashed ids, ``rows`` at most, also where ids repeat; ids are picked before anything wide is read.

    Of large tables only ids whose hash is among the first few in a thousand are told apart first; these are the smallest, if there are enough of them.
    """
    hashed, ids = F.xxhash64(id_col), df.select(id_col)
    n = ids.count()
    picked = None
    if n > 16 * rows:
        low = ids.where(hashed < -(1 << 63) + (1 << 64) * 8 * rows // n)
        picked = low.distinct().orderBy(hashed, id_col).limit(rows)
        picked = picked if picked.count() == rows else None
    picked = ids.distinct().orderBy(hashed, id_col).limit(rows) if picked is None else picked
    return df.join(F.broadcast(picked), id_col, "left_semi").limit(rows)  # broadcast: at most ``rows`` numbers


def fewest(df: DataFrame, by: str, order: list[Column], rows: int) -> DataFrame:
    """The first ``rows`` rows of each value of a column in an order; each task sends off no more than that of each."""
    place = fresh_name(df.columns, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(place) <= rows).drop(place)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into slices of bounded rows and bytes."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    start = 0
    held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow of a function over bounded slices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = fn(part)
                if out is not None:
                    yield out

    return map_arrow(few_tasks(df), run, schema)


def text_list(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bytes_list(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def keep_rows(docs: DataFrame, keeps: Callable[[list[bytes]], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, for whose texts keeps is true."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(keeps(bytes_list(part, text_col)), pa.bool_()))

    return map_arrow(few_tasks(docs), run, docs.schema)


def change_texts(docs: DataFrame, change: Callable[[str], str], text_col: str = "text") -> DataFrame:
    """All rows with all their columns, the texts changed; null stays null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                at = part.schema.get_field_index(text_col)
                new = pa.array([None if t is None else change(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    return map_arrow(few_tasks(docs), run, docs.schema)
