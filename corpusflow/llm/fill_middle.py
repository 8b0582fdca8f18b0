"""Operator 12: fill-in-middle transformation with succinct rank and select.

A text is a row of tokens, ``[A-Za-z]+|[^A-Za-z]``. Where each one starts is a bit of a packed
bitvector, one for all texts of a slice end to end, with a directory of how many bits are set
before each block of 64. A text's number of tokens is the difference of two ranks; its two
cuts, given as ranks, are byte places by select. Bytes are enough: a byte that continues a
code point never starts a token, any other starts one unless it is a letter after a letter.

Prefix, suffix and middle then change places behind their marks: suffix before middle (psm),
or suffix first (spm). What is cut where depends on the document's id alone.

Null and empty texts, and texts that hold a mark already, stay as they are (plain). A text of one
token has cuts at its ends only. Repeated rows, and equal ids, are transformed one by one; rows without an
id are left out. A very long text is one row, of which about five times its size is held. Other columns, whatever
their names, are not looked at. An empty table makes no rows. There are no ties.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents so many are transformed, and of a hundred of these so many have their suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
#: The place of the set bit of each rank in each byte.
_IN_BYTE = np.zeros((256, 8), np.int64)
for _b in range(256):
    _set = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, : len(_set)] = _set


class Bits:
    """A packed bitvector with rank and select."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.size = len(bits)
        self.words = np.zeros(len(packed) // 8 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of the set bit before which so many are set; the end, where there are no more."""
        inside = rank < self.before[-1]
        rank = np.where(inside, rank, 0)
        word = np.searchsorted(self.before, rank, "right") - 1
        word = np.minimum(word, len(self.words) - 1)
        octets = self.words[word].view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        left = (rank - self.before[word])[:, None]
        octet = np.minimum((upto <= left).sum(1), 7)
        row = np.arange(len(octets))
        left = left[:, 0] - np.where(octet, upto[row, octet - 1], 0)
        return np.where(inside, 64 * word + 8 * octet + _IN_BYTE[octets[row, octet], np.clip(left, 0, 7)], self.size)


def boundaries(raw: list[bytes]) -> tuple[Bits, np.ndarray]:
    """The starts of all tokens of texts end to end, and where each text begins (and the last one ends)."""
    begin = np.concatenate([[0], np.cumsum([len(b) for b in raw], dtype=np.int64)])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    letter = _LETTER[flat]
    starts = _LEAD[flat]
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[begin[:-1][np.diff(begin) > 0]] = True  # a text starts afresh whatever the one before it ends with
    return Bits(starts), begin


def draws(doc_id: int) -> list[int]:
    """Four numbers from the id."""
    digest = hashlib.sha256(b"1:%d" % doc_id).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def cuts(raw: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its number of tokens, its two cuts in bytes, and the four draws of its id."""
    bits, begin = boundaries(raw)
    first = bits.rank(begin)
    n = np.diff(first)
    drawn = np.array([draws(i) for i in ids], np.int64).reshape(-1, 4)
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    place = [np.minimum(bits.select(first[:-1] + np.where(r < n, r, 0)), begin[1:]) - begin[:-1] for r in (np.minimum(one, two), np.maximum(one, two))]
    ends = np.diff(begin)
    low, high = (np.where(r < n, p, ends) for r, p in zip((np.minimum(one, two), np.maximum(one, two)), place, strict=True))
    return n, low, high, drawn


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, ids = common.bytes_list(part), common.ids_of(part)
        n, low, high, drawn = cuts(raw, ids.to_pylist())
        form: list[str] = []
        before: list[int | None] = []
        between: list[int | None] = []
        output: list[bytes] = []
        for b, x, y, (_, _, some, first) in zip(raw, low.tolist(), high.tolist(), drawn.tolist(), strict=True):
            if not b or some % 100 >= TRANSFORMED or any(m in b for m in (PREFIX, SUFFIX, MIDDLE)):
                form.append("plain")
                before.append(None)
                between.append(None)
                output.append(b)
                continue
            form.append("spm" if first % 100 < SUFFIX_FIRST else "psm")
            before.append(_code_points(b[:x]))
            between.append(_code_points(b[x:y]))
            output.append(SUFFIX + b[y:] + PREFIX + b[:x] + MIDDLE + b[x:y] if form[-1] == "spm" else PREFIX + b[:x] + SUFFIX + b[y:] + MIDDLE + b[x:y])
        columns = [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return common.map_slices(common.texts_only(docs, id_col, text_col, named=True), run, schema)


def _code_points(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode())


def restored(output: Column, form: Column) -> Column:
    """The text, from what became of it and its form: no part holds a mark, and none can arise where a part meets one."""
    psm = F.split(F.substr(output, F.lit(4)), "<S>|<M>")
    spm = F.split(F.substr(output, F.lit(4)), "<P>|<M>")
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The transformation's numbers, and digests of what it made and of what is restored from that."""
    made = transform(docs, id_col, text_col)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
