"""Operator 11: SimHash near-duplicates by exact comparison of tiles.

1. Every text's fingerprint has 64 bits: bit i is set if it is set in over half the hashes of
   its word shingles, repeats included. Equal fingerprints collapse to one.
2. Fingerprints are dealt into cells by the population counts of their four 16-bit words, and
   a cell into tiles of about TILE. Two fingerprints differ in at least as many bits as
   their population counts do, word by word, so a tile meets only those tiles whose counts
   differ by the radius at most: 65 cells with its own, each pair once.
3. Two tiles are compared by exclusive-or and bit counts. Inside them the same holds for the
   population counts of the eight bytes: both are sorted by these into small tiles with the
   least and the most of each byte, and small tiles too far apart are skipped.
4. Of the links found, tiles report a forest that connects the same fingerprints, so dense groups
   make no more rows than they have members; components then give each document the
   smallest id it can reach.

Comparisons still grow with the square of the number of different fingerprints: of random ones 4 in
100 pairs share or border a cell, and fewer are compared. No pair is left out, whatever its size.

Null and empty texts, and those without a word, have fingerprint zero, which links like any other. Texts of
fewer words than a shingle has are one shingle. Equal texts, and repeated rows, have equal fingerprints; rows come back
one by one, and rows of one id are one document, linked by any of its fingerprints. Rows without an id are left out. Very long texts are read
in pieces of about a megabyte. Other columns, whatever their names, are not looked at. An empty table makes no rows.
Components are named by their smallest id, so there are no ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm.components import components

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a tile, about, and of a small tile inside it.
TILE, SMALL = 4096, 64
#: Fingerprints of several tiles that one tile is compared with at once.
GATHER = 16384
#: Bytes of text split into words at a time.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time."""
    start = 0
    while start < len(raw):
        cut = _SPACE.search(raw, start + PIECE)
        end = cut.start() if cut else len(raw)
        yield raw[start:end].split()
        start = end


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """64 bits, as an unsigned number."""
    ones, total = np.zeros(64, np.int64), 0
    held: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(raw.lower()):
        held += piece
        if len(held) < words:
            continue
        line = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)], "<u8")
        ones += _set_bits(h)
        total += len(h)
        held = held[len(held) - words + 1 :] if words > 1 else []
    if not total:
        if not held:
            return 0
        return digest(b" ".join(held), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How often each bit is set, counted a few thousand hashes at a time."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        out += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(b, words) for b in common.bytes_list(part)), np.uint64, part.num_rows)
        return pa.RecordBatch.from_arrays([common.ids_of(part), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return common.map_slices(common.texts_only(docs, id_col, text_col, named=True), run, "doc_id long, fp long")


def offsets(radius: int) -> list[int]:
    """Steps from a cell to those whose four counts differ by radius in all, one of each pair of opposite ones, and zero: counts have five bits each (0 to 16), so a step out of range meets no cell."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]
    return sorted(k for s in steps if (k := s[0] * 32768 + s[1] * 1024 + s[2] * 32 + s[3]) >= 0)


def _cell(fp: Column) -> Column:
    """The population counts of the four words of a fingerprint, in one number."""
    word = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return (word[3] * 32768 + word[2] * 1024 + word[1] * 32 + word[0]).cast("int")


class Forest:
    """Which of some members are connected; keeps the links that first connect two."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[i] with b[i]. Links between what is connected already go at once; each round then takes one link of every member of b."""
        while True:
            new = self.label[a] != self.label[b]
            a, b = a[new], b[new]
            if not len(a):
                return
            _, at = np.unique(self.label[b], return_index=True)
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while x in parent:
                    x = parent[x]
                return x

            for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True):
                x, y = root(int(self.label[i])), root(int(self.label[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    self.links.append((i, j))
            move = np.arange(len(self.label))
            for x in parent:
                move[x] = root(x)
            self.label = move[self.label]


def _bytes_of(fps: np.ndarray) -> np.ndarray:
    """The population counts of each fingerprint's eight bytes."""
    return np.bitwise_count(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8))


def _small_tiles(fps: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Fingerprints in the order of their bytes' counts, where each small tile begins, and the least and most of each byte in it."""
    counts = _bytes_of(fps)
    order = np.lexsort(counts.T[[1, 3, 5, 7, 0, 2, 4, 6]])
    fps, counts = fps[order], counts[order]
    at = list(range(0, len(fps), SMALL))
    return fps, at, np.minimum.reduceat(counts, at).astype(np.int8), np.maximum.reduceat(counts, at).astype(np.int8)


def compare(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Pairs of unequal fingerprints, one of a and one of b, that connect all whose bits differ in radius places at most."""
    if not len(a) or not len(b):
        return np.empty((0, 2), np.uint64)
    a, at_a, low_a, high_a = _small_tiles(a)
    b, at_b, low_b, high_b = _small_tiles(b)
    every = np.unique(np.concatenate([a, b]))
    number_a, number_b = np.searchsorted(every, a), np.searchsorted(every, b)
    forest = Forest(len(every))
    for k, start in enumerate(at_a):
        apart = np.maximum(low_a[k] - high_b, low_b - high_a[k])
        near = np.flatnonzero(np.maximum(apart, 0).sum(1) <= radius)
        if not len(near):
            continue
        place = (near[:, None] * SMALL + np.arange(SMALL)).ravel()
        place = place[place < len(b)]
        one = a[start : start + SMALL]
        bits = np.bitwise_count(one[:, None] ^ b[place][None, :])
        i, j = np.nonzero((bits <= radius) & (bits > 0))
        if len(i):
            forest.add(number_a[start + i], number_b[place[j]])
    links = np.array(forest.links, np.int64).reshape(-1, 2)
    return every[links]


def _compare_rows(radius: int):
    """Rows of (tile, xs, ys): one tile's fingerprints xs, and those of another that borders it, ys. Rows of the same xs in a row are taken together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, xs = None, np.empty(0, np.uint64)
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = compare(np.concatenate(held), xs, radius).view(np.int64)
                held.clear()
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            own, first, second = (batch.column(k) for k in range(3))
            for r in range(batch.num_rows):
                if own[r].as_py() != tile or sum(map(len, held)) > GATHER:
                    yield from flush()
                    tile, xs = own[r].as_py(), _numbers(first, r)
                held.append(_numbers(second, r))
        yield from flush()

    return run


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False).view(np.uint64).copy()


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fps: different fingerprints (fp). Rows (a, b) that connect all that differ in radius bits at most."""
    cells = fps.select("fp", _cell(F.col("fp")).alias("cell"))
    # at most 17 ** 4 cells, of two small numbers each, whatever the input
    sizes = common.materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).coalesce(1), "simhash-cells").select("cell", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("no", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiles = common.materialize(dealt.groupBy("cell", "no").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")  # about ``tile`` numbers a row
    meets = tiles.select(F.col("cell").alias("own"), F.col("no").alias("own_no"), F.col("fps").alias("ys"), F.explode(F.array(*[F.col("cell") + F.lit(k) for k in offsets(radius)])).alias("cell"))
    meets = meets.join(F.broadcast(sizes.select("cell")), "cell", "left_semi")
    pairs = meets.join(tiles, "cell").where((F.col("own") != F.col("cell")) | (F.col("own_no") <= F.col("no")))
    rows = pairs.select(F.concat_ws(":", "cell", "no").alias("tile"), F.col("fps").alias("xs"), "ys")
    return common.map_arrow(rows, _compare_rows(radius), "a long, b long")


def linked_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    own = common.materialize(fingerprints(docs, words, id_col, text_col), "simhash-fps", narrow=True)
    fps = common.materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-different", narrow=True)
    found = links(fps.select("fp"), radius)
    several = own.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b")
    if several.limit(1).count():  # ids with more than one fingerprint
        ids = common.materialize(several.select("doc_id", "a"), "simhash-several", narrow=True)
        found = found.union(own.join(ids, "doc_id").select(F.col("fp").alias("a"), F.col("a").alias("b")).where("a != b"))
    reached = components(found).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    reached = reached.union(reached.select(F.col("root").alias("fp"), "root").distinct())
    least = reached.join(fps, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = fps.join(reached.join(least, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = common.materialize(named, "simhash-named", narrow=True)  # a table, so that Spark can split a fingerprint that a third of all documents have
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
