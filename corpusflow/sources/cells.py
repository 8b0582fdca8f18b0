"""Tables kept in cells: folders of rows, by the values of some columns, of which an update rewrites only those it touches.

``data/<write>/<column>=<value>/...`` holds the rows; ``manifest/v<number>.json`` lists each cell's folders: one, and
those of later writes that were put beside it. A write puts its cells into a folder of its own and then adds a manifest, which one rename makes the newest: readers see the
old cells or the new ones, and a crash before it leaves the old. There is one writer at a time. The manifest before
stays, with all it lists, for those who read it; what no manifest lists is deleted.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The values of a cell's columns, as text.
Cell = tuple[str, ...]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``); only a local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/corpusflow-shared"
    return f"{root.rstrip('/')}/corpusflow/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written to a new shared folder: for what is costly and read several times."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    at, store = _store(spark, path)
    folder = at(f"{path}/manifest")
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    return sorted(int(n[1:13]) for n in names if re.fullmatch(r"v\d{12}\.json", n))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


class Manifest:
    """What a version of a table consists of."""

    def __init__(self, schema: StructType, by: list[str], cells: dict[str, list[str]], meta: dict[str, str]):
        self.schema, self.by, self.cells, self.meta = schema, by, cells, meta

    def cell(self, name: str) -> Cell:
        return tuple(part.split("=", 1)[1] for part in name.split("/"))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest:
    """The newest manifest, or one of a number."""
    number = _numbers(spark, path)[-1] if number is None else number
    _, store = _store(spark, path)
    text = spark.read.text(f"{path}/manifest/v{number:012d}.json", wholetext=True).first()[0]
    held = json.loads(text)
    folders = {name: [where] if isinstance(where, str) else where for name, where in held["cells"].items()}
    return Manifest(StructType.fromJson(held["schema"]), held["by"], folders, held["meta"])


def read(spark: SparkSession, path: str, wanted: Callable[[Cell], bool] | None = None, of: Manifest | None = None) -> DataFrame:
    """The rows of all cells, or of those that are wanted; other cells' files are not listed."""
    of = of or manifest(spark, path)
    folders = [f"{path}/data/{folder}/{name}" for name, held in sorted(of.cells.items()) if wanted is None or wanted(of.cell(name)) for folder in held]
    return spark.read.schema(of.schema).parquet(*folders) if folders else spark.createDataFrame([], of.schema)


def write(df: DataFrame, path: str, by: list[str], touched: Iterable[Cell] | None = None, meta: dict[str, str] | None = None, dealt: bool = False, order: Iterable[str] = ()) -> int:
    """Put df in the place of the touched cells (None: of all), and return how many cells were written. Touched cells without rows go; rows of cells that aren't touched are put beside what these hold.

    df may read the table. dealt: the rows of a cell are in one task already. order: columns that a cell's rows are sorted by. by: columns with short values (numbers, names); they stay columns of the rows.
    """
    spark = df.sparkSession
    at, store = _store(spark, path)
    numbers = _numbers(spark, path)
    old = manifest(spark, path, numbers[-1]) if numbers else None
    fresh = uuid.uuid4().hex
    folder = f"{path}/data/{fresh}"
    keys = [f"_{c}" for c in by]
    keyed = df.select("*", *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)])
    keyed = keyed if dealt else keyed.repartition(*by)
    keyed.sortWithinPartitions(*keys, *order).write.partitionBy(*keys).parquet(folder)
    new = _cells_below(store, at, folder, len(by))
    gone = None if touched is None else {"/".join(f"{k}={v}" for k, v in zip(keys, cell, strict=True)) for cell in touched}
    kept = {} if old is None or gone is None else {name: where for name, where in old.cells.items() if name not in gone}
    cells = kept | {name: [*kept.get(name, []), fresh] for name in new}
    held = {"schema": json.loads(df.schema.json()), "by": by, "cells": cells, "meta": (old.meta if old else {}) | (meta or {})}
    _commit(spark, path, numbers[-1] + 1 if numbers else 0, json.dumps(held))
    _clean(spark, path)
    return len(new)


def _cells_below(store, at, folder: str, depth: int) -> list[str]:
    """Names (column=value/...) of the folders that a partitioned write made."""
    names = [""]
    for _ in range(depth):
        names = [f"{name}{s.getPath().getName()}/" for name in names for s in store.listStatus(at(f"{folder}/{name}" if name else folder)) if s.isDirectory()]
    return [n.rstrip("/") for n in names]


def _commit(spark: SparkSession, path: str, number: int, text: str) -> None:
    at, store = _store(spark, path)
    draft, final = at(f"{path}/manifest/_new-{uuid.uuid4().hex}"), at(f"{path}/manifest/v{number:012d}.json")
    out = store.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(final) or not store.rename(draft, final):
        raise OSError(f"{path}: version {number} could not take its place")


def _clean(spark: SparkSession, path: str) -> None:
    """Delete manifests but for the two newest, and the folders and cells that neither lists."""
    at, store = _store(spark, path)
    numbers = _numbers(spark, path)
    for n in numbers[:-2]:
        store.delete(at(f"{path}/manifest/v{n:012d}.json"), False)
    for file in store.listStatus(at(f"{path}/manifest")):
        if file.getPath().getName().startswith("_new-"):
            store.delete(file.getPath(), False)
    live = [manifest(spark, path, n) for n in numbers[-2:]]
    listed = {(where, name) for m in live for name, held in m.cells.items() for where in held}
    used = {where for where, _ in listed}
    for file in store.listStatus(at(f"{path}/data")):
        where = file.getPath().getName()
        if where not in used:
            store.delete(file.getPath(), True)
            continue
        for name in _cells_below(store, at, f"{path}/data/{where}", len(live[-1].by)):
            if (where, name) not in listed:
                store.delete(at(f"{path}/data/{where}/{name}"), True)


#: Cells that keyed tables are dealt into.
BUCKETS = 64


def _keyed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _buckets(df: DataFrame) -> list[Cell]:
    """The cells that rows fall into: as many numbers as there are buckets, at most."""
    return [(str(r[0]),) for r in df.select("_bucket").distinct().collect()]


def upsert(df: DataFrame, path: str, key: list[str], gone: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Insert rows, or replace those of the same key, and delete those whose key is in gone; only the cells of these keys are read and rewritten. Returns how many cells were written.

    The number of buckets is that of the first write.
    """
    spark = df.sparkSession
    if not exists(spark, path):
        return write(_keyed(df, key, buckets), path, ["_bucket"], meta={"buckets": str(buckets)})
    of = manifest(spark, path)
    buckets = int(of.meta["buckets"])
    arriving = _keyed(df, key, buckets)
    keys = arriving.select(*key, "_bucket")
    if gone is not None:
        keys = keys.unionByName(_keyed(gone.select(*key), key, buckets))
    touched = _buckets(keys)
    if not touched:
        return 0
    inside = set(touched)
    stored = read(spark, path, lambda cell: cell in inside, of)
    return write(stored.join(keys.select(*key).distinct(), key, "left_anti").select(*stored.columns).unionByName(arriving.select(*stored.columns)), path, ["_bucket"], touched)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``upsert`` keeps."""
    return read(spark, path).drop("_bucket")
