"""Empty tables, repeated rows and very long texts, for the operators whose own tests don't hold them."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm import ann_codes, bin_packing, bpe_cuts, fill_middle, pii_offsets, quality_subword, rule_cascade, shingle_join, token_files, warc_zstd

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor, sit amet 12.5 Ünï " * 20_000  # 740 000 characters
#: Names of columns that the operators make for themselves.
EXTRA = "part string, start string, n string, grams string, ids string, place string, sig string, label string, bucket string, length string, segment string"


def docs(spark, rows):
    wide = [(*r, *["x"] * 11) for r in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, {EXTRA}").repartition(3)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_encoding_of_nothing_and_of_repeated_rows(spark):
    assert bpe_cuts.digests(docs(spark, []), WORD).count() == 0
    assert bin_packing.pieces(docs(spark, []), BYTE, 1024, 2).count() == 0
    rows = [(5, "same text"), (5, "same text"), (5, "other"), (6, None)]
    got = sorted((r.doc_id, r.n_tokens) for r in bpe_cuts.digests(docs(spark, rows), WORD).collect())
    assert got == sorted((i, len(ids_of(WORD, t or ""))) for i, t in rows)
    pieces = bin_packing.pieces(docs(spark, rows), BYTE, 1024, 2).collect()
    assert sorted((r.doc_id, r.length) for r in pieces) == sorted((i, len(ids_of(BYTE, t or "")) + 1) for i, t in rows)
    packed = bin_packing.pack(spark.createDataFrame(pieces, bin_packing.PIECES), 1024).collect()
    assert sorted(r.offset for r in packed) == sorted(np.cumsum([0, *[r.length for r in sorted(packed, key=lambda r: r.offset)]])[:-1].tolist())


def test_token_files_of_repeated_ids(spark, tmp_path):
    rows = [(5, "same text"), (5, "longer text than that"), (4, "first"), (6, None)]
    shards = token_files.write(docs(spark, rows), str(tmp_path / "ids"), WORD, 2)
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.read(spark, str(tmp_path / "ids"), shards).collect())
    assert [s for s, *_ in got] == np.cumsum([0, *[n for _, n, _ in got]])[:-1].tolist()
    assert sorted((d, n) for _, n, d in got) == sorted((i, len(ids_of(WORD, t or "")) + 1) for i, t in rows) and [d for *_, d in got] == [4, 5, 5, 6]


def test_very_long_texts(spark, tmp_path):
    """One document of three quarters of a million characters beside a short one."""
    df = docs(spark, [(1, LONG), (2, "short")])
    word, byte = ids_of(WORD, LONG), ids_of(BYTE, LONG)
    (row,) = bpe_cuts.digests(df.where("doc_id = 1"), WORD).collect()
    assert row.n_tokens == len(word) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, word)).encode()).hexdigest()
    pieces = sorted(bin_packing.pieces(df, BYTE, 1024, 2).where("doc_id = 1").collect(), key=lambda r: r.piece)
    whole = np.array([*byte, 2], "<u4")
    assert len(pieces) == math.ceil(len(whole) / 1024) and all(zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    shards = token_files.write(df, str(tmp_path / "ids"), WORD, 2)
    got = {r.doc_id: (r.start, r.n_tokens) for r in token_files.read(spark, str(tmp_path / "ids"), shards).collect()}
    assert got[1] == (0, len(word) + 1) and got[2][0] == len(word) + 1
    words = LONG.split(" ")[:-1]
    measured = {r.doc_id: r for r in rule_cascade.cascade(df).collect()}
    assert measured[1].n_words == len(words) and measured[1].base_failed == (measured[1].n_repeat_words * 2 > len(words))
    assert {r.doc_id for r in quality_subword.score(df, quality_subword.Model(np.zeros(quality_subword.BUCKETS), 0.0)).collect()} == {1, 2}
    assert {r.doc_id: r.n_shingles for r in shingle_join.linked_components(df).collect()} == {1: 7, 2: 1}
    assert {r.doc_id: r.n_email for r in pii_offsets.spans(df.withColumn("text", F.concat("text", F.lit(" a@b.org")))).collect()} == {1: 1, 2: 1}
    assert {r.doc_id for r in fill_middle.digests(df).collect()} == {1, 2}


def test_repeated_vector_ids(spark):
    """Rows of a query's own id are no candidates, of others all are; rows of a query id are one query."""
    rows = [(20, [1.0, 0.0]), (20, [0.5, 1.0]), (1, [0.5, 0.5]), (1, [0.75, 0.0]), (2, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann_codes.neighbours(df, F.col("vec_id") % 20 == 0, 9).orderBy("rank").collect()
    pairs = sorted((-(a[0] * b[0] + a[1] * b[1]), i) for q, a in rows[:2] for i, b in rows[2:])
    assert [(r.rank, -r.score, r.vec_id) for r in got] == [(n, *p) for n, p in enumerate(pairs, 1)] and {r.query_id for r in got} == {20}


@pytest.mark.parametrize("size", [10, 3_000_000])
def test_archives_of_repeated_ids_and_long_pages(spark, tmp_path, size):
    rows = [(1, "u", "x" * size), (1, "u", "x" * size), (2, "u", "y" * size), (3, "u", "x" * size)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = warc_zstd.read(spark, str(tmp_path / "w"), warc_zstd.write(df, str(tmp_path / "w"))).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(1, size), (1, size), (2, size), (3, size)]
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "revisit", 3), (2, "response", None), (3, "response", None)}
