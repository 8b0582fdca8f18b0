"""Operator 4: best-fit packing by bin completion with branch and bound.

How pieces are packed depends on their lengths alone, and there are at most ``capacity``
different ones. So executors count the lengths, the driver packs that histogram (its size
is fixed by the capacity, not by the data), and executors give each piece the place that
its rank among the pieces of its length stands for.

The histogram is packed by bin completion (Martello & Toth; Korf): take the largest
length that is left, take one by one all fillings of the rest of its bin that no other
dominates, fullest first, and branch over them and over how often each is used, from as
often as the counts allow down to once. A branch ends when the space it has wasted exceeds what a better packing may waste. The
first incumbent is best-fit decreasing. The search ends at the lower bound or after
``node_limit`` nodes, with the best packing so far; no piece is ever left out. Without a limit
(None) it ends with a packing that no other beats. Each row says how many sequences there are, and how many
there must be at least, so the gap is known.

Null and empty texts make one piece, the end id. Repeated rows are packed one by one; rows
without an id are left out. A very long text is encoded in whole, about twenty times its size. Pieces of one
length take the places for it in any order. Other columns, whatever their names, are not looked at. An
empty table makes no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm.unit_encoder import encoder

#: Pieces that one task ranks, about; those of a length go to as many parts as that takes, as a third of all may have the same.
RANKED = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: A group of equal bins: how many, and the lengths in one with their numbers, largest first.
Group = tuple[int, tuple[tuple[int, int], ...]]


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Group]:
    """Best-fit decreasing over a histogram; equal bins are moved together."""
    by_room: dict[int, Counter] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r, bins in by_room.items() if r >= length and bins), default=None)
            if room is None:
                per_bin = capacity // length
                n, some = divmod(left, per_bin)
                if n:
                    by_room.setdefault(capacity - per_bin * length, Counter())[((length, per_bin),)] += n
                if some:
                    by_room.setdefault(capacity - some * length, Counter())[((length, some),)] += 1
                break
            fits = room // length
            bins = by_room[room]
            content, n = next(iter(bins.items()))
            whole = min(n, left // fits)
            k, m = (whole, fits) if whole else (1, left)
            bins[content] -= k
            if not bins[content]:
                del bins[content]
            by_room.setdefault(room - m * length, Counter())[(*content, (length, m))] += k
            left -= k * m
    return [(n, content) for bins in by_room.values() for content, n in bins.items()]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: large pieces that can't share, and the volume that must go elsewhere."""
    lengths = np.arange(capacity + 1)
    volume = counts * lengths
    n, v = np.cumsum(counts), np.cumsum(volume)
    best = -(-int(v[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        alone = int(n[-1] - n[capacity - k])
        half = int(n[capacity - k] - n[capacity // 2])
        room = half * capacity - int(v[capacity - k] - v[capacity // 2])
        small = int(v[capacity // 2] - (v[k - 1] if k else 0))
        best = max(best, alone + half + max(0, -(-(small - room) // capacity)))
    return best


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's pieces, in groups, fit inside a's pieces; both descending."""
    if not b:
        return True
    return any(_dominates(tuple(sorted((*a[:i], x - b[0], *a[i + 1 :]), reverse=True)), b[1:]) for i, x in enumerate(a) if x >= b[0] and (i == 0 or a[i - 1] != x))


def _smear(bits: int, width: int) -> int:
    """The union of bits, moved up by 0 to width."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def undominated(counts: np.ndarray, gap: int, most_waste: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """All undominated fillings of a gap that waste at most most_waste, one at a time; fullest first, and of equal ones those with larger pieces first.

    A filling is dominated if and only if a piece outside it can take the place of some of its pieces
    (or of none) whose sum it isn't smaller than, and the gap still holds it all.
    """
    lengths = [int(x) for x in np.flatnonzero(counts[: gap + 1]) if x]
    if not lengths:
        if gap <= most_waste:
            yield ()
        return
    free = {x: int(counts[x]) for x in lengths}
    mask = (1 << (gap + 1)) - 1

    def reaches() -> list[int]:
        sums = [1]  # bit s of sums[i]: s can be made of the i smallest lengths
        for x in lengths:
            reach, left, step = sums[-1], min(free[x], gap // x), 1
            while left:
                step = min(step, left)
                reach |= (reach << (x * step)) & mask
                left -= step
                step *= 2
            sums.append(reach)
        return sums

    sums = reaches()

    def walk(top: int, rest: int, waste: int, content: tuple[tuple[int, int], ...], some: int, several: int, spare: int) -> Iterator[tuple[tuple[int, int], ...]]:
        """Content, and rest made of the top smallest lengths. Bits: sums of any of content's pieces, of two or more, and the lengths of which pieces are left."""
        taken = ((_smear(some, waste - 1) << 1 if waste else 0) | several) & spare  # what can take the place of pieces in content
        if not rest:
            if not taken:
                yield content
            return
        # What is larger than the rest can't be in it; that holds for what is larger than all that may still come, too.
        if (_smear(some << rest, waste) & spare) >> (rest + 1) or (taken >> (lengths[top - 1] + 1) if top else taken):
            return
        top = min(top, bisect_right(lengths, rest))
        alone = spare >> rest & 1  # a piece of just the rest dominates all other ways to make it
        if alone and not (top and lengths[top - 1] == rest):
            return
        while top and sums[top] >> rest & 1:
            x = lengths[top - 1]
            any_of, more_of, steps = some, several, []
            for m in range(1, min(free[x], rest // x) + 1):
                more_of |= more_of << x | (any_of & ~1) << x
                any_of |= any_of << x
                steps.append((m, any_of, more_of))
            for m, any_of, more_of in reversed(steps):
                if sums[top - 1] >> (rest - m * x) & 1:
                    yield from walk(top - 1, rest - m * x, waste, (*content, (x, m)), any_of, more_of, spare & ~(1 << x) if m == free[x] else spare)
            if alone or taken >> x & 1:
                return
            top -= 1

    start = sum(1 << x for x in lengths)
    for waste in range(min(most_waste, gap - lengths[-1]) + 1):  # the largest piece alone dominates what is less full
        for content in walk(bisect_right(lengths, gap - waste), gap - waste, waste, (), 1, 0, start):
            sums = []  # a search holds many of these
            yield content
            sums = reaches()


def fillings(counts: np.ndarray, gap: int, width: int, most_waste: int) -> list[tuple[tuple[int, int], ...]]:
    """The first undominated fillings, up to width."""
    return list(islice(undominated(counts, gap, most_waste), width))


def pack_histogram(counts: np.ndarray, capacity: int, node_limit: int | None = 6000) -> list[Group]:
    """Groups of equal bins that hold every piece; counts[i]: how many pieces of length i."""
    counts = np.asarray(counts, np.int64).copy()
    best = best_fit_decreasing(counts, capacity)
    n_best, least = sum(n for n, _ in best), lower_bound(counts, capacity)
    total = int((counts * np.arange(len(counts))).sum())
    nodes = 0

    def expand(left: np.ndarray, waste: int, above: int, done: set) -> Iterator[tuple[Group, np.ndarray, int, int, set]]:
        """All ways to fill some bins with the largest piece; done: fillings whose number is settled for bins with the piece above."""
        largest = int(np.flatnonzero(left)[-1])
        done = set(done) if largest == above else set()
        allowed = (n_best - 1) * capacity - total - waste
        left = left.copy()
        left[largest] -= 1
        for rest in undominated(left, capacity - largest, allowed):
            if rest in done:
                continue
            done.add(rest)
            need = Counter({largest: 1})
            for x, m in rest:
                need[x] += m
            most = min((int(left[x]) + (x == largest)) // m for x, m in need.items())
            lost = capacity - sum(x * m for x, m in need.items())
            if lost:
                most = min(most, allowed // lost)
            for times in range(most, 0, -1):
                after = left.copy()
                after[largest] += 1
                for x, m in need.items():
                    after[x] -= m * times
                yield (times, tuple(sorted(need.items(), reverse=True))), after, waste + lost * times, largest, done

    if n_best > least:
        stack, chosen = [expand(counts, 0, 0, set())], []
        while stack and (node_limit is None or nodes < node_limit) and n_best > least:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if chosen:
                    chosen.pop()
                continue
            nodes += 1
            group, after, waste, largest, done = step
            if waste > (n_best - 1) * capacity - total:
                continue
            chosen.append(group)
            if not after.any():
                best, n_best = list(chosen), sum(n for n, _ in chosen)
                chosen.pop()
                continue
            stack.append(expand(after, waste, largest, done))
    return best


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keeps_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, end it with end_id, and cut what is longer than capacity; a shorter piece comes first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.resident(f"encoder {tokenizer} {keeps_space}", lambda: encoder(tokenizer, keeps_space))
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids, n = known.encode(common.text_list(part))
                size = n + 1
                ends = np.cumsum(size)
                flat = np.full(int(ends[-1]), end_id, "<u4")
                keep = np.ones(len(flat), bool)
                keep[ends - 1] = False
                flat[keep] = ids
                begin, number = ends - size, -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                end = size[doc] - (number[doc] - 1 - piece) * capacity
                start = np.maximum(0, end - capacity)
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[a:b]) for a, b in zip(((begin[doc] + start) * 4).tolist(), ((begin[doc] + end) * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([common.ids_of(part).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(end - start), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.map_arrow(common.few_tasks(common.texts_only(docs, id_col, text_col, named=True)), run, PIECES)


def pack(parts: DataFrame, capacity: int = 1024, node_limit: int | None = 6000, ranked: int = RANKED) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to capacity; and sequences, how many there are, and sequences_at_least.

    parts must be stable (a table), as its rows are counted first and placed afterwards. Its
    columns must be those of ``pieces``.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").count().collect():  # at most capacity rows
        counts[row["length"]] = row["count"]
    shares = np.maximum(1, -(-counts // ranked))
    first = np.cumsum(shares) - shares  # where a length's parts begin
    share = F.element_at(F.lit(shares.tolist()), (F.col("length") + 1).cast("int"))
    salted = parts.withColumn("_part", (F.element_at(F.lit(first.tolist()), (F.col("length") + 1).cast("int")) + F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), share)).cast("long"))
    held = np.zeros(int(shares.sum()), np.int64)
    for row in salted.groupBy("_part").count().collect():  # one row for ``ranked`` pieces, and one a length
        held[row["_part"]] = row["count"]
    base = np.cumsum(held) - held
    base -= np.repeat(base[first], shares)
    groups = pack_histogram(counts, capacity, node_limit)
    used = np.zeros(capacity + 1, np.int64)
    rows = []  # length, first rank, first sequence, number in a sequence, first offset
    sequence = 0
    for times, content in groups:
        offset = 0
        for length, m in content:
            rows.append((length, used[length], sequence, m, offset))
            used[length] += times * m
            offset += length * m
        sequence += times
    plan = np.array(sorted(rows), np.int64).reshape(-1, 5)
    shift = np.int64(1) << 48
    keys = plan[:, 0] * shift + plan[:, 1]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(batch.schema.names)}
            length = col["length"]
            rank = base[col["_part"]] + col["_rank"] - 1
            row = plan[np.searchsorted(keys, length * shift + rank, "right") - 1]
            nth, slot = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + nth), pa.array(row[:, 4] + slot * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("_part").orderBy("doc_id", "piece", "start", "ids_crc32")
    placed = salted.select("doc_id", "piece", "start", "length", "ids_crc32", "_part", F.row_number().over(order).cast("long").alias("_rank"))
    out = common.map_arrow(placed, place, PIECES + ", sequence_id long, offset long")
    return out.select("*", F.lit(sequence).cast("long").alias("sequences"), F.lit(lower_bound(counts, capacity)).cast("long").alias("sequences_at_least"))
