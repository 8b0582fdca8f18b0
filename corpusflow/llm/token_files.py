"""Operator 6: token ids as flat unsigned integer files with 64-bit document offsets.

Each partition of the range-partitioned documents becomes a pair of files: ``.ids`` holds
nothing but the ids (``<u2`` if the vocabulary fits, else ``<u4``), ``.idx`` a header,
the doc ids and the n+1 offsets of the documents in the first. A partition's base, the
number of ids before it, is a prefix sum over the manifest. Readers map the files to memory, or read slices where a store has no files to map.

Null and empty texts are documents that hold the end id alone. Repeated doc ids stay
separate documents side by side; rows without an id are left out. A very long text is
encoded in whole; ids of equal documents stand in any order. Other columns are not looked at. An empty table makes no files and reads back as no rows.
Every attempt of a task writes files under names of its own, and only the manifest, made
from the attempts that succeeded, says which ones count, so a lost executor does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import common
from corpusflow.llm.unit_encoder import encoder, vocabulary_size

#: The index file's first bytes, and its codes for the width of ids.
MAGIC = b"CFTOKIDX"
WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}

MANIFEST = "name string, first_doc long, n_docs long, n_tokens long"


@dataclass(frozen=True)
class Shard:
    """One pair of files, and the number of ids in all files before it."""

    name: str
    n_docs: int
    n_tokens: int
    base: int


def _writer(out: str, path: str, keeps_space: bool, end_id: int, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = common.filesystem(out)
        known = common.resident(f"encoder {path} {keeps_space}", lambda: encoder(path, keeps_space))
        name = f"part-{uuid.uuid4().hex}"
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        sink = None
        try:
            for batch in batches:
                for part in common.slices(batch, "text"):
                    if sink is None:
                        sink = fs.open_output_stream(f"{folder}/{name}.ids")
                    ids, n = known.encode(common.text_list(part))
                    out_ids = np.full(len(ids) + len(n), end_id, np.uint32)
                    keep = np.ones(len(out_ids), bool)
                    keep[np.cumsum(n + 1) - 1] = False
                    out_ids[keep] = ids
                    sink.write(out_ids.astype(WIDTHS[width]).tobytes())
                    docs.append(common.ids_of(part).to_numpy(zero_copy_only=False))
                    sizes.append(n + 1)
        finally:
            if sink is not None:
                sink.close()
        if sink is None:
            return
        doc = np.concatenate(docs).astype("<i8")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        with fs.open_output_stream(f"{folder}/{name}.idx") as idx:
            idx.write(MAGIC + np.array([width, len(doc)], "<u8").tobytes() + doc.tobytes() + offsets.tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "first_doc": [int(doc[0])], "n_docs": [len(doc)], "n_tokens": [int(offsets[-1])]}, pa.schema([("name", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, keeps_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> list[Shard]:
    """Write all documents in ascending id order; the manifest, one row a partition, comes back."""
    spark = docs.sparkSession
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4
    fs, folder = common.filesystem(out)
    fs.create_dir(folder, recursive=True)
    ordered = common.texts_only(docs, id_col, text_col, named=True).repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = common.map_arrow(ordered, _writer(out, tokenizer, keeps_space, end_id, width), MANIFEST).collect()
    shards, base = [], 0
    for row in sorted(manifest, key=lambda r: r.first_doc):
        shards.append(Shard(row.name, row.n_docs, row.n_tokens, base))
        base += row.n_tokens
    return shards


class RangeReader:
    """Ids of a file that can't be mapped: each slice is read when it is asked for."""

    def __init__(self, file: pa.NativeFile, dtype: np.dtype):
        self.file, self.dtype = file, dtype

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, at: slice) -> np.ndarray:
        start, stop, _ = at.indices(len(self))
        return np.frombuffer(self.file.read_at((stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


def open_shard(out: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | RangeReader]:
    """doc ids, offsets and the ids of a pair of files: mapped to memory, or read slice by slice from stores that aren't file systems."""
    fs, folder = common.filesystem(out)
    with fs.open_input_file(f"{folder}/{name}.idx") as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{name}.idx is no token index")
    width, n = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
    doc = np.frombuffer(raw, "<i8", n, 24)
    offsets = np.frombuffer(raw, "<u8", n + 1, 24 + 8 * n)
    if common.pafs.LocalFileSystem is type(fs):
        ids = np.memmap(f"{folder}/{name}.ids", WIDTHS[width], "r") if offsets[-1] else np.empty(0, WIDTHS[width])
    else:
        ids = RangeReader(fs.open_input_file(f"{folder}/{name}.ids"), WIDTHS[width])
    return doc, offsets, ids


def _reader(out: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, offsets, ids = open_shard(out, row["name"])
                for at in range(0, len(doc), 4096):
                    o = offsets[at : at + 4097].astype(np.int64)
                    flat = memoryview(np.ascontiguousarray(ids[o[0] : o[-1]], "<u4")).cast("B")
                    cut = (o - o[0]) * 4
                    crc = [zlib.crc32(flat[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[at : at + 4096]), pa.array(o[:-1] + row["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, out: str, shards: list[Shard]) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = [(s.name, s.base) for s in shards]
    files = spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)))
    return common.map_arrow(files, _reader(out), "doc_id long, start long, n_tokens long, ids_crc32 long")
