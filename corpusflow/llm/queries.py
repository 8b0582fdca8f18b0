"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import ann_codes, bin_packing, bpe_cuts, common, fill_middle, language_codes, oracles, pii_offsets, quality_subword, rule_cascade, shingle_join, simhash_tiles, token_alignment, token_files, warc_zstd

END_ID = 2
CAPACITY = 1024


def fold(n: int) -> Column:
    """crc32 of the doc_id as text, mod n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_ann_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, among all rows."""
    return ann_codes.neighbours(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; those of fold 2 of 4 are never learnt from."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_codes.predict(docs, language_codes.learn(docs, fold(4) != 2))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, and read the archives back."""
    out = common.workspace(spark, "op3-warc")
    return warc_zstd.read(spark, out, warc_zstd.write(common.table(spark, sf_dir, "pages"), out))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    parts = bin_packing.pieces(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)
    return bin_packing.pack(common.materialize(parts, "op4-pieces"), CAPACITY)


def op5_pii_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, disguised or not."""
    return pii_offsets.spans(common.table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to flat files, and read them back."""
    out = common.workspace(spark, "op6-ids")
    shards = token_files.write(common.table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read(spark, out, shards)


def op7_bpe_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return bpe_cuts.digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return rule_cascade.cascade(common.table(spark, sf_dir, "documents"))


def op9_quality_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents; those of fold 1 of 3 are never learnt from."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_subword.learn(docs, common.table(spark, sf_dir, "labels"), fold(3) != 1)
    return quality_subword.score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents that link by 5-word shingles at a Jaccard similarity of 0.75."""
    return shingle_join.linked_components(common.table(spark, sf_dir, "documents"), 5, 75)


def op11_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents whose 64-bit fingerprints differ in three bits at most."""
    return simhash_tiles.linked_components(common.table(spark, sf_dir, "documents"), 3, 3)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their middle last, and the texts restored from that."""
    return fill_middle.digests(common.table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of two tokenizers over all documents, aligned by their bytes."""
    return token_alignment.alignments(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann_codes,
        op2_language_codes,
        op3_warc_zstd,
        op4_best_fit_packing,
        op5_pii_offsets,
        op6_token_files,
        op7_bpe_cuts,
        op8_rule_cascade,
        op9_quality_subword,
        op10_shingle_join,
        op11_simhash_tiles,
        op12_fill_middle,
        op13_token_alignment,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op3_warc_zstd": oracles.OP3, "op8_rule_cascade": oracles.OP8, "op10_shingle_join": oracles.OP10, "op12_fill_middle": oracles.OP12}
