"""Operator 3: WARC archives, each record compressed on its own with a shared dictionary.

A Zstandard dictionary is built from a bounded sample of the records, from the first
bytes of very long ones. Each archive opens
with a skippable frame that holds the dictionary, so it can be read without anything
else, and each record is a frame of its own, so it can be read without those before it.
Where the sample is too small or too uniform to train on, its last bytes serve as a dictionary of plain content.

Records with equal payloads are stored once: the one with the largest id is a response,
the others are revisits that refer to it. Payloads of null pages are empty, and equal as
others are; pages without an id are left out. Repeated page ids are archived row by row; of equal ones none is a revisit of
itself. A very long payload is held about three times while its record is written. Other columns, whatever their names, are not looked at.
An empty table makes no archive.

Each attempt of a task writes an archive under a name of its own; the manifest of the
attempts that succeeded says which count, so a lost executor does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import common

# Fixed values of the formats: the skippable frame that holds a dictionary, the profile of a revisit.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records from which the dictionary is built, at most, and its size in bytes.
SAMPLE_RECORDS = 800
DICTIONARY_BYTES = 64 << 10
#: Characters of a sampled payload that count for the dictionary.
SAMPLE_CHARS = 64 << 10
LEVEL = 3
#: Bytes read from an archive at a time, and records handed on together.
STEP, TOGETHER = 32 << 10, 2048

PAGE = "page_id long, url string, html string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(page_id & (1 << 64) - 1) | 0x8 << 60 << 64)}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int & ((1 << 64) - 1)
    return low - (1 << 64) if low >> 63 else low


def build_record(page_id: int, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record; a revisit has no block, and carries its payload's length in a field of its own."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    block = b""
    if refers_to is None:
        head.append("Content-Type: text/html")
        block = payload
    else:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Payload-Length: {len(payload)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {"version": lines[0]} | dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, rest[:length]


def train(records: list[bytes]) -> bytes:
    """A dictionary of at most an eighth of the records; none (empty) if there is nothing at all."""
    size = min(DICTIONARY_BYTES, sum(map(len, records)) // 8)
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few, or all alike
        return b"".join(records)[-max(size, min(1024, DICTIONARY_BYTES)) :]


def read_archive(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame after another; no more than a record is held."""
    left, words = stream.read(8), b""
    if len(left) == 8 and struct.unpack_from("<I", left)[0] == DICTIONARY_MAGIC:
        words, left = stream.read(struct.unpack_from("<I", left, 4)[0]), b""
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    while left := left or stream.read(STEP):
        one, out = unzip.decompressobj(), []
        while True:
            out.append(one.decompress(left))
            if one.eof:
                break
            if not (left := stream.read(STEP)):
                raise ValueError("an archive ends within a record")
        left = one.unused_data
        yield parse_record(b"".join(out))


def refer(pages: DataFrame) -> DataFrame:
    """Add refers_to: of pages with equal payloads the largest page_id, to the others."""
    keyed = pages.withColumn("_digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    keepers = keyed.groupBy("_digest").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = keyed.join(keepers, "_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("_keeper") != F.col("page_id"), F.col("_keeper"))).drop("_digest", "_keeper")


def write(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", sample_records: int = SAMPLE_RECORDS) -> list[tuple[str, int]]:
    """Archive all pages; the manifest, (name, records) of each archive, comes back."""
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", " ").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    plain = plain.where("page_id IS NOT NULL")
    sample = common.sample(plain, "page_id", sample_records).select("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html")).collect()
    words = train([build_record(r["page_id"], r["url"], r["html"].encode(), None, date) for r in sorted(sample)])
    fs, folder = common.filesystem(out)
    fs.create_dir(folder, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, n, name = None, 0, f"part-{uuid.uuid4().hex}.warc.zst"
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": True}
        press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), **options) if words else zstandard.ZstdCompressor(**options)
        store, at = common.filesystem(out)
        try:
            for batch in batches:
                if batch.num_rows and sink is None:
                    sink = store.open_output_stream(f"{at}/{name}", compression=None)  # the name would have it compressed once more
                    if words:
                        sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
                n += batch.num_rows
                col = {k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names) if k != "html"}
                for page, url, html, to in zip(col["page_id"], col["url"], batch.column(batch.schema.get_field_index("html")).cast(pa.binary()), col["refers_to"], strict=True):
                    sink.write(press.compress(build_record(page, url, html.as_py(), to, date)))
        finally:
            if sink is not None:
                sink.close()
        if n:
            yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    rows = refer(plain).select("page_id", "url", "html", "refers_to")
    rows = common.map_arrow(rows, run, "name string, n long").collect()
    return sorted((r["name"], r["n"]) for r in rows)


def read(spark: SparkSession, out: str, manifest: list[tuple[str, int]]) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; a response's digest is taken anew."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [f.split()[0] for f in schema.split(", ")]

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def row_of(fields: dict[str, str], block: bytes) -> tuple:
        own = fields["WARC-Type"] == "response"
        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if own and digest(block) != said:
            raise ValueError(f"{fields['WARC-Record-ID']}: a payload differs from its digest")
        return page_of(fields["WARC-Record-ID"]), len(block) if own else int(fields["X-Payload-Length"]), said, fields["WARC-Type"], None if own else page_of(fields["WARC-Refers-To"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = common.filesystem(out)
        for batch in batches:
            for row in batch.to_pylist():
                n = 0
                with fs.open_input_stream(f"{folder}/{row['name']}", compression=None) as f:
                    records = read_archive(f)
                    while rows := [row_of(*r) for r in islice(records, TOGETHER)]:
                        n += len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                if n != row["n"]:
                    raise ValueError(f"{row['name']}: {n} records, not {row['n']}")

    files = spark.createDataFrame(manifest, "name string, n long").repartition(max(1, len(manifest)))
    return common.map_arrow(files, run, schema)
