"""Operator 13: alignment of two tokenizers' tokens by byte-owner arrays.

Both token sequences of a text spell the same bytes, a space and the text. ``np.repeat`` gives every
byte the number of the token it belongs to, once for A and once for B. Where either owner changes,
a new pair of owners begins: these are the links. Where both change at once, both sequences
have a token end: these cut the tokens into groups.

What a link says of the corpus takes counts over all documents:

1. A slice of documents is aligned in one go and becomes one row of a table: the documents'
   numbers, the slice's different id pairs with their counts, and for each document which of
   these pairs it has, and how often.
2. The pairs of all slices are summed, and of each B id the highest sum is found.
3. Each slice gets its pairs' sums back, and its documents add up theirs.

What is shuffled are the different pairs of a slice, a small part of its links, and each slice's row once.

Null and empty texts, and texts whose A or B tokens don't spell the bytes of a space and the text
(U+2581, which B takes for a space), have no tokens. Special tokens' strings are plain text. Of a B id's pairs
several may have the highest count; links of all of them are best. Repeated rows count each by itself; rows without an id
are left out. A very long text is a slice of its own, of which about fifty times its size is held. Other columns,
whatever their names, are not looked at. An empty table makes no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm.unit_encoder import ByteLevelEncoder, byte_symbols

#: Bytes of text that are aligned at once.
SLICE_BYTES = 1_000_000
#: Tokens that are spelled at once.
CHUNK = 1 << 14
#: Bits of a pair that hold the B id.
B_BITS = 16


class PlainByteLevel(ByteLevelEncoder):
    """A byte-level file's ids; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.units.tok.encode_special_tokens = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._ordinary(t) for t in texts]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.array([len(p) for p in parts], np.int64)

    def _ordinary(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or not self._FAR.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return self.units.encode([text])[0]


class Spelling:
    """The bytes of every token of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, a few thousand tokens at a time: places take eight times what they point at."""
        parts = []
        for at in range(0, len(ids), CHUNK):
            few = ids[at : at + CHUNK]
            size = self.size[few]
            ends = np.cumsum(size)
            parts.append(self.flat[np.repeat(self.begin[few] - (ends - size), size) + np.arange(ends[-1])])
        return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def _byte_level_spelling(path: str) -> Spelling:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = {c: b for b, c in enumerate(byte_symbols())}
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return Spelling(tokens)


def _piece_spelling(model) -> Spelling:
    single = re.compile("<0x([0-9A-F]{2})>")
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Spelling([bytes([int(m[1], 16)]) if (m := single.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces])


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = PlainByteLevel(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.spell_a, self.spell_b = _byte_level_spelling(a_path), _piece_spelling(self.b)
        if len(self.spell_b.size) > 1 << B_BITS or len(self.spell_a.size) > 1 << 32 - B_BITS:
            raise ValueError("a pair of ids must fit 32 bits")
        most = max(len(self.spell_a.size), len(self.spell_b.size))
        digits = [str(i).encode() for i in range(most)]
        self.digits = Spelling(digits)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and their number a text, B's ids and their number a text, and which texts have tokens."""
        spaced = [" " + t for t in texts]
        a, na = self.a.encode(spaced)
        per = self.b.encode(texts, num_threads=1)
        nb = np.array([len(x) for x in per], np.int64)
        b = np.fromiter(chain.from_iterable(per), np.int64, int(nb.sum()))
        del per
        raw = [s.encode() for s in spaced]
        size = np.array([len(r) for r in raw], np.int64)
        good = np.array([bool(t) for t in texts], bool)
        of_a, of_b = np.repeat(np.arange(len(texts)), na), np.repeat(np.arange(len(texts)), nb)
        for ids, of, spell in ((a, of_a, self.spell_a), (b, of_b, self.spell_b)):
            good &= np.bincount(of, spell.size[ids], len(texts)).astype(np.int64) == size
        while True:  # lengths agree: hold the bytes themselves against each other, once more if some go
            flat = np.frombuffer(b"".join(r for r, g in zip(raw, good.tolist(), strict=True) if g), np.uint8)
            ends = np.cumsum(size[good])
            bad = np.zeros(len(flat), bool)
            for ids, of, spell in ((a, of_a, self.spell_a), (b, of_b, self.spell_b)):
                bad |= spell.bytes_of(ids[good[of]]) != flat
            if not bad.any():
                break
            good[np.flatnonzero(good)[np.unique(np.searchsorted(ends, np.flatnonzero(bad), "right"))]] = False
        return a[good[of_a]].astype(np.int64), np.where(good, na, 0), b[good[of_b]], np.where(good, nb, 0), good

    def align(self, texts: list[str]) -> Alignment:
        a, na, b, nb, _ = self.tokens(texts)
        size_a, size_b = self.spell_a.size[a], self.spell_b.size[b]
        own_a, own_b = np.repeat(np.arange(len(a), dtype=np.int32), size_a), np.repeat(np.arange(len(b), dtype=np.int32), size_b)
        new_a, new_b = np.ones(len(own_a), bool), np.ones(len(own_b), bool)
        new_a[1:], new_b[1:] = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
        linked = np.flatnonzero(new_a | new_b)
        link_a, link_b = own_a[linked], own_b[linked]
        cut = new_a & new_b  # also where a text begins
        begins = np.flatnonzero(cut)
        first_a, first_b = own_a[begins], own_b[begins]  # each group's first tokens
        text_of_a = np.repeat(np.arange(len(texts)), na)
        text = text_of_a[link_a]
        n_groups = np.bincount(text_of_a[first_a], minlength=len(texts))
        return Alignment(na, nb, n_groups, np.bincount(text, minlength=len(texts)), text, a[link_a] << B_BITS | b[link_b], self._written(a, na, b, nb, first_a, first_b, n_groups))

    def _written(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, n_groups: np.ndarray) -> list[bytes]:
        """Each text's groups: ids of a group of A joined by commas, a bar, those of B, a semicolon between groups."""
        group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        group_a[first_a] = group_b[first_b] = 1
        group_a, group_b = np.cumsum(group_a) - 1, np.cumsum(group_b) - 1
        # a group's tokens of A come before its tokens of B: what is before each token in the whole sequence
        at_a = np.arange(len(a)) + first_b[group_a]
        ends_a, ends_b = (np.append(first[1:], n)[: len(first)] for first, n in ((first_a, len(a)), (first_b, len(b))))
        at_b = np.arange(len(b)) + ends_a[group_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a[ends_a - 1]] = ord("|")
        mark[at_b[ends_b - 1]] = ord(";")
        size = self.digits.size[ids] + 1
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        where = np.ones(len(out), bool)
        where[ends - 1] = False
        out[where] = self.digits.bytes_of(ids)
        out[ends - 1] = mark
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(na + nb)])].tolist()
        return [out[x : y - 1].tobytes() if y > x else b"" for x, y in zip(upto[:-1], upto[1:], strict=True)]


class Alignment:
    """Of a list of texts: tokens, groups and links of each; of each link its text and its pair of ids; each text's groups in writing."""

    def __init__(self, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, n_links: np.ndarray, text: np.ndarray, pair: np.ndarray, written: list[bytes]):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.text, self.pair, self.written = n_a, n_b, n_groups, n_links, text, pair, written


_ALIGNED = "slice string, docs binary, numbers binary, shas array<string>, pairs array<long>, totals array<long>, entries binary"


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row a slice of documents.

    docs: their ids. numbers: n_a, n_b, n_groups, n_links and the number of entries of each. shas: digests of their groups.
    pairs, totals: the slice's different pairs and how many links hold each. entries: a document's pairs, as
    places among these, and how many of its links hold each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = common.resident(f"align {a_path} {b_path}", lambda: Aligner(a_path, b_path)).align
        for part in _slices(batches, slice_bytes):
            yield _slice_row(align(common.text_list(part)), common.ids_of(part).to_numpy())

    return common.map_arrow(common.few_tasks(common.texts_only(docs, id_col, text_col, named=True)), run, _ALIGNED)


def _slices(batches: Iterable[pa.RecordBatch], slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of documents cut, and joined, to slices of about so many bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(1)).to_numpy()
        start = 0
        for i, length in enumerate(lengths.tolist()):
            if size and size + length > slice_bytes:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield whole()
                held, size, start = [], 0, i
            size += length + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield whole()


def _slice_row(found: Alignment, ids: np.ndarray) -> pa.RecordBatch:
    pairs, place = np.unique(found.pair, return_inverse=True)
    totals = np.bincount(place, minlength=len(pairs))
    entry, count = np.unique(found.text << 32 | place, return_counts=True)
    of = entry >> 32
    numbers = np.stack([found.n_a, found.n_b, found.n_groups, found.n_links, np.bincount(of, minlength=len(ids))]).astype("<i8")
    entries = (entry & 0xFFFFFFFF).astype("<u4").tobytes() + count.astype("<u4").tobytes()
    shas = [hashlib.sha256(w).hexdigest() if n else "" for w, n in zip(found.written, found.n_a.tolist(), strict=True)]
    columns = [
        pa.array([uuid.uuid4().hex]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([numbers.tobytes()], pa.binary()), pa.array([shas], pa.list_(pa.string())),
        pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([totals.tolist()], pa.list_(pa.int64())), pa.array([entries], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _ALIGNED.split(", ")])


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of slices with their pairs' counts over the corpus (places, sums, best) to rows of documents."""
    column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    for r in range(batch.num_rows):
        ids = np.frombuffer(column["docs"][r].as_buffer(), "<i8")
        n_a, n_b, n_groups, n_links, n_entries = np.frombuffer(column["numbers"][r].as_buffer(), "<i8").reshape(5, -1)
        place, count = np.frombuffer(column["entries"][r].as_buffer(), "<u4").reshape(2, -1).astype(np.int64)
        got = column["got"][r].values
        sums, best = np.zeros(0, np.int64), np.zeros(0, bool)
        if got is not None and len(got):
            at = got.field("place").to_numpy()
            sums, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            sums[at], best[at] = got.field("total").to_numpy(), got.field("best").to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(n_entries)])
        over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])  # noqa: B023, E731
        n_best, count_sum = over(count * best[place]), over(count * sums[place])
        columns = [pa.array(x.astype(np.int64)) for x in (ids, n_a, n_b, n_groups, n_links, n_best, count_sum)]
        yield pa.RecordBatch.from_arrays([*columns, column["shas"][r].values], [f.split()[0] for f in _OUT.split(", ")])


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair, total (links of the corpus that hold it), best (whether no pair of its B id has more)."""
    each = slices.select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.totals").alias("n"))
    total = common.materialize(each.groupBy("pair").agg(F.sum("n").alias("total")), "align-counts", narrow=True)
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    high = total.groupBy(b.alias("b")).agg(F.max("total").alias("high"))
    return total.withColumn("b", b).join(high, "b").select("pair", "total", (F.col("total") == F.col("high")).alias("best"))


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document its tokens, groups and links, how many links are of a best pair, the sum of their pairs' counts, and a digest of its groups."""
    slices = common.materialize(aligned(docs, a_path, b_path, id_col, text_col, slice_bytes), "align-slices")
    asked = slices.select("slice", F.posexplode("pairs").alias("place", "pair"))
    got = asked.join(pair_counts(slices), "pair").groupBy("slice").agg(F.collect_list(F.struct("place", "total", "best")).alias("got"))  # at most as many as a slice has pairs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _summed(batch)

    rows = slices.select("slice", "docs", "numbers", "shas", "entries").join(got, "slice", "left").drop("slice")
    return common.map_arrow(rows, run, _OUT)
