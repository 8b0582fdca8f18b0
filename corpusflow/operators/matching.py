"""Which of many short texts stand in which long ones: the long ones pass once, however many patterns there are.

A pattern's head is its first 1, 2, 4, 8 or 16 characters, as many as it has. The heads' hashes are a bitmap of fixed
size, which is all that a task needs to know of the patterns. A task takes the places of its texts whose next
characters are in the bitmap, and sends off what stands there; patterns then meet it by equality
(``names.beginnings``). So neither the driver nor a task holds patterns, and more of them only fill the bitmap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import names
from corpusflow.operators.chunks import slices

#: Lengths of heads.
HEADS = (1, 2, 4, 8, 16)
#: Bits of the bitmap, as a power of two: 8 MB, of which a million patterns set one in sixty-seven.
BITS = 26
#: Characters of a pattern that are looked for at once; of what is longer the whole text is asked again.
REACH = 256
#: Characters of texts taken at once.
SLICE = 1 << 17

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _windows(text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length of a head the bit of the window that begins at each character (windows that would end beyond the text have none). text: code points, or rows of them."""
    h = (text.astype(np.uint64) + np.uint64(1)) * _MIX
    size = 1
    while True:
        yield size, ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)
        if size == HEADS[-1] or h.shape[-1] <= size:
            return
        h = (h[..., :-size] ^ (h[..., :-size] >> np.uint64(31))) * _MIX + h[..., size:]
        size *= 2


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _head_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the bitmap, by place, with the bits of a task's patterns; and the sizes of their heads as places below zero."""
    words: dict[int, int] = {}
    for batch in batches:
        patterns = batch.column(0).to_pylist()
        for size in HEADS:
            heads = [p[:size] for p in patterns if 1 << min(len(p).bit_length() - 1, 4) == size]
            if heads:
                bits = next(bit for n, bit in _windows(_points("".join(heads)).reshape(-1, size)) if n == size)
                for bit in np.unique(bits).tolist():
                    words[bit >> 6] = words.get(bit >> 6, 0) | 1 << (bit & 63)
                words[-1] = words.get(-1, 0) | size
    if words:
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int32()), pa.array(np.array(list(words.values()), np.uint64).view(np.int64))], ["place", "bits"])


def _bitmap(patterns: DataFrame) -> tuple[np.ndarray, int]:
    """The bitmap of all heads, one bit a byte here, and their sizes as bits of a number."""
    rows = patterns.mapInArrow(_head_bits, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # a bitmap's words at most
    place, bits = rows["place"].to_numpy(), rows["bits"].to_numpy().view(np.uint64)
    words = np.zeros(1 << BITS - 6, np.uint64)
    words[place[place >= 0]] = bits[place >= 0]
    sizes = int(bits[place < 0][0]) if (place < 0).any() else 0
    return words, sizes


def _scan(words: np.ndarray, sizes: int, reach: int, kind: pa.DataType):
    """A task that gives, of texts (text_id, text), what stands at each place where a pattern may begin."""

    def places(texts: list[str]) -> np.ndarray:
        """Places in all texts end to end."""
        text = _points("".join(texts))
        may = np.zeros(len(text), bool)
        for size, bit in _windows(text):
            if sizes & size:
                may[: len(bit)] |= (words[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return np.flatnonzero(may)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= SLICE):
                    size += len(texts[stop])
                    stop += 1
                few = texts[start:stop]
                begin = np.concatenate([[0], np.cumsum([len(t) for t in few])])
                at = places(few)
                of = np.searchsorted(begin, at, "right") - 1
                seen = dict.fromkeys((i, few[i][p : p + reach]) for i, p in zip(of.tolist(), (at - begin[of]).tolist(), strict=True))
                if seen:
                    ids = batch.column(0).take(pa.array([start + i for i, _ in seen], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids.cast(kind), pa.array([s for _, s in seen], pa.string())], ["text_id", "here"])
                start = stop

    return run


#: Arrow's types of text ids.
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def contained(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """pattern_id, text_id of each text that holds a pattern. patterns: pattern_id, pattern; texts: text_id, text. Empty patterns and nulls are found nowhere.

    Only of patterns longer than REACH the candidates' texts are read a second time.
    """
    kept = patterns.where(F.col("pattern") != "").select("pattern_id", "pattern").distinct().withColumn("part", F.substr("pattern", F.lit(1), F.lit(REACH)))
    longest = kept.agg(F.max(F.length("part"))).first()[0] or 0
    kind = texts.schema["text_id"].dataType.simpleString()
    words, sizes = _bitmap(kept.select("part").distinct())
    here = texts.select("text_id", "text").mapInArrow(_scan(words, sizes, longest, _KINDS[kind]), f"text_id {kind}, here string")
    found = names.beginnings(here, kept.select("part"), "here", "part").select("part", "text_id").distinct().join(kept, "part")
    if longest < REACH:
        return found.select("pattern_id", "text_id").distinct()
    whole = F.length("pattern") <= REACH
    rest = found.where(~whole).join(texts.select("text_id", "text"), "text_id").where(F.contains("text", "pattern"))
    return found.where(whole).select("pattern_id", "text_id").unionByName(rest.select("pattern_id", "text_id")).distinct()
