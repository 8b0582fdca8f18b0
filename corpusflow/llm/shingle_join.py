"""Operator 10: n-gram Jaccard join by T-occurrence search (DivideSkip).

Documents are sets of distinct word n-grams; two link when 100 * intersection >=
percent * union. The result is each document's set size and the smallest id that links
reach from it. It is exact (n-grams are compared by 64-bit hashes, sets by 128-bit digests):

1. Every text is shingled once. Equal sets collapse to one, by their digest. All n-grams are
   counted where they meet, in packed blocks of 8 bytes an n-gram: a link needs so many
   shared n-grams that a set most of whose n-grams are in no other set has none. What
   remains are the likely copies.
2. Those are shingled again. In the order of how many sets hold an n-gram, rarest first, two
   linked sets share one of their first n - ceil(p * n) + 1 n-grams (prefix filter).
   Sets that share one, directly or by way of others, make a block.
3. Within a block, each set asks an inverted index for those that occur in at least T
   of its lists: short lists are heap-merged, long ones binary-probed. Pairs that found
   links already connect are not asked for again.
4. Blocks too large for one task go a longer way: some sets of each, picked by hash, ask all
   others, chunk by chunk, which connects most of what is alike. Prefix n-grams whose sets are
   connected by then are done with; those left make smaller blocks. Where such a block is still
   too large, each set that isn't connected with most of it asks all others of fitting size,
   chunk against chunk, in bands of size.

No candidate is dropped anywhere. Null and empty texts have no n-grams and link with
nothing. Texts of fewer words than n have one, all their words. Repeated rows come back
row by row; rows of one id are one document, linked by any of its texts, each with its own
set's size. Components are named by their smallest id, so there are no ties. A very long text is one set, of which about forty times its size is
held. Rows without an id are left out; other columns, whatever their names, are not looked at, and ``keep`` returns them as they are. An empty table makes no rows.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm.components import components

WORDS = 5
PERCENT = 75
#: N-grams, and sets, that a task gathers before it sends them off.
FLUSH, FLUSH_SETS = 500_000, 60_000
#: Stored input for which there is a part of the n-grams; a task gathers about twice as much.
PART_BYTES = 16_000_000
#: Parts at least. As each set is in most of the parts while they are few, more of them from the start keep what is sent in proportion to the input.
LEAST_PARTS = 32
#: Parts that a task of texts sends rows to at most: where there are more, it sends to groups of parts, and a second shuffle deals each group's
#: n-grams, gathered to so many, to its parts. So a row holds hundreds of n-grams in both, however many parts there are.
MOST_PARTS, GROUP_FLUSH = 1024, 4_000_000
#: Tasks that count, at most; each takes its parts one after the other.
MOST_TASKS = 50_000
#: Documents and n-grams of a block that one task searches; of what is more, the chunks.
BLOCK_DOCS, BLOCK_GRAMS = 400, 600_000
#: Sets of a large block that ask all others first. It doesn't change what is found, only how soon.
ASKING = 256

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(raw: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Of each text the ascending 64-bit hashes of its different word n-grams."""
    words = [b.lower().split() for b in raw]
    size = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, int(size.sum()))
    ends = np.cumsum(size)
    m = max(0, len(flat) - n + 1)
    grams = np.zeros(m, np.uint64)
    for k in range(n):
        grams += flat[k : k + m] * _C[k % 8] + np.uint64(k // 8)
    grams = _mix(grams)
    out = []
    for end, count in zip(ends.tolist(), size.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(grams[end - count : end - n + 1]))
        elif count:
            out.append(_mix((flat[end - count : end] * _C[:count]).sum(dtype=np.uint64, keepdims=True) + np.array([count], np.uint64) * _C[7]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return (grams >> np.uint64(40)) % np.uint64(parts)


_KEY = np.uint64((1 << 32) - 1)
_RAW = "kind int, part int, doc_id long, key long, n int, sig binary, grams binary"


def _key_of(sig: bytes) -> int:
    """Half of a set's digest, by which the count tells sets apart."""
    return int.from_bytes(sig[:8], "little", signed=True)


def _packed(grams: np.ndarray, places: np.ndarray) -> bytes:
    """Ascending n-grams as differences, byte by byte, as high bytes are mostly zero and compress; and the place of each one's set."""
    steps = np.diff(grams, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes() + places.astype("<u2").tobytes()


def _unpacked(raw: pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of n sets, ascending n-grams, places of their sets)."""
    many = (raw.size - 8 * n) // 6
    planes = np.frombuffer(raw, np.uint8, 4 * many, 8 * n).reshape(4, many)
    steps = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return np.frombuffer(raw, np.int64, n).copy(), np.cumsum(steps, dtype=np.uint32), np.frombuffer(raw, "<u2", many, 8 * n + 4 * many).copy()


def _sorted_by(part: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return np.argsort(part.astype(np.uint64) << np.uint64(32) | grams)


def _cut(keys: np.ndarray, place: np.ndarray, grams: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Of n-grams, sorted by part and then themselves: each part, the number of its sets, and these and the n-grams packed. place: of each n-gram its set's among the keys."""
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        used, local = np.unique(place[a:b], return_inverse=True)
        yield int(part[a]), len(used), keys[used].tobytes() + _packed(grams[a:b].astype(np.uint32), local.astype(np.uint16))


def _cut_groups(keys: np.ndarray, place: np.ndarray, grams: np.ndarray, part: np.ndarray, wide: int) -> Iterator[tuple[int, int, bytes]]:
    """The same for groups of so many parts; each n-gram says which of them is its."""
    group = part // wide
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        used, local = np.unique(place[a:b], return_inverse=True)
        yield int(group[a]), len(used), keys[used].tobytes() + grams[a:b].astype("<u4").tobytes() + local.astype("<u2").tobytes() + (part[a:b] % wide).astype("<u2").tobytes()


def _width(parts: int) -> int:
    """Parts of a group."""
    return -(-parts // MOST_PARTS)


def _dealt_to_parts(spread: DataFrame, parts: int, wide: int) -> DataFrame:
    """Rows of groups to rows of parts. A group goes to several tasks, by the digest of its rows; a task gathers one group at a time."""
    spark = spread.sparkSession
    names = [f.split()[0] for f in _RAW.split(", ")]

    def made(found: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        for part, n, packed in found:
            columns = [pa.array([1], pa.int32()), pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([n], pa.int32()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    def flush(group: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            before = np.cumsum([0, *(len(k) for k, *_ in held)])
            keys, place = np.concatenate([k for k, *_ in held]), np.concatenate([p.astype(np.int64) + b for (_, _, p, _), b in zip(held, before, strict=False)])
            grams, part = np.concatenate([g for _, g, _, _ in held]), group * wide + np.concatenate([s for *_, s in held]).astype(np.int64)
            order = _sorted_by(part, grams)
            yield from made(_cut(keys, place[order], grams[order], part[order]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting, sets = -1, [], 0, 0
        for batch in batches:
            kind = batch.column(0).to_numpy()
            own = batch.filter(pa.array(kind == 0))
            if own.num_rows:
                yield own
            sent = batch.filter(pa.array(kind == 1))
            for group, n, raw in zip(sent.column(1).to_pylist(), sent.column(4).to_pylist(), sent.column(6), strict=True):
                if group != now or waiting >= GROUP_FLUSH or sets + n > FLUSH_SETS:
                    yield from flush(now, held)
                    now, held, waiting, sets = group, [], 0, 0
                b = raw.as_buffer()
                many = (b.size - 8 * n) // 8
                at = 8 * n
                held.append((np.frombuffer(b, np.int64, n).copy(), np.frombuffer(b, "<u4", many, at).copy(), np.frombuffer(b, "<u2", many, at + 4 * many).copy(), np.frombuffer(b, "<u2", many, at + 6 * many).copy()))
                waiting, sets = waiting + many, sets + n
        yield from flush(now, held)

    tasks = common.shuffle_partitions(spark)
    salt = F.pmod(F.crc32(F.coalesce("grams", F.col("sig"))), F.lit(max(1, -(-tasks // MOST_PARTS)) * 4))
    routed = spread.withColumn("_salt", salt).repartition(tasks, "part", "_salt").sortWithinPartitions("part").drop("_salt")
    return common.map_arrow(routed, run, _RAW)


def _spread(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """kind 0: a document, its set's size and digest. kind 1: n-grams of a task's different sets that belong to a part: keys of n sets, and what ``_packed`` makes."""
    names = [f.split()[0] for f in _RAW.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    wide = _width(parts)

    def rows(many: int, **col) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(col[k], t) if k in col else pa.nulls(many, t) for k, t in zip(names, types, strict=True)], names)

    def flush(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.array([k for k, _ in held], np.int64)
        place = np.repeat(np.arange(len(held), dtype=np.uint64), [len(g) for _, g in held])
        grams = np.concatenate([g for _, g in held])
        part = _part_of(grams, parts)
        grams &= _KEY
        order = _sorted_by(part, grams)
        place, grams, part = place[order], grams[order], part[order].astype(np.int64)
        for at, many, packed in _cut(keys, place, grams, part) if wide == 1 else _cut_groups(keys, place, grams, part, wide):
            yield rows(1, kind=[1], part=[at], n=[many], grams=[packed])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            for piece in common.slices(batch, "text"):
                doc = common.ids_of(piece).to_pylist()
                sets = shingle_sets(common.bytes_list(piece), n)
                sigs = [signature(s) for s in sets]
                keys = [_key_of(x) for x in sigs]
                yield rows(len(doc), kind=[0] * len(doc), part=[d % parts // wide for d in doc], doc_id=doc, key=keys, n=[len(s) for s in sets], sig=sigs)
                for k, s in zip(keys, sets, strict=True):
                    if len(s) and k not in seen:
                        seen.add(k)
                        held.append((k, s))
                        waiting += len(s)
                if waiting >= FLUSH or len(held) >= FLUSH_SETS:
                    yield from flush(held)
                    held, waiting = [], 0
        if held:
            yield from flush(held)

    sent = common.map_arrow(common.few_tasks(docs), run, _RAW)
    return sent if wide == 1 else _dealt_to_parts(sent, parts, wide)


_COUNTED = "kind int, doc_id long, key long, n int, sig binary, part int, shared int, holders binary"

#: N-grams counted at once, and bytes that a part gathers before they go to a file.
COUNT_AT_ONCE, GATHER_BYTES = 1_000_000, 96 << 20


#: Of n-grams that wait in the shared folder, every so manieth stays in memory, to find a place among them.
EVERY = 1024


class _Blob:
    """Keys of sets, and ascending n-grams with the places of their sets among the keys; these two in memory, or in a file from some byte on."""

    def __init__(self, keys: np.ndarray, grams: np.ndarray, places: np.ndarray):
        self.keys, self.grams, self.places, self.many = keys, grams, places, len(grams)
        self.file, self.at = None, 0

    def leave(self, file: pafs.FileSystem, path: str, at: int) -> None:
        """Let go of what stands in a file."""
        self.file, self.path, self.at = file, path, at
        self.grams, self.places = self.grams[::EVERY].copy(), None

    def _read(self, at: int, size: int) -> np.ndarray:
        with self.file.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at(size, at), np.uint8)

    def places_of(self, a: int, b: int) -> np.ndarray:
        return self.places[a:b] if self.file is None else self._read(self.at + 4 * self.many + 2 * a, 2 * (b - a)).view(np.uint16)

    def below(self, a: int, top: int | None) -> np.ndarray:
        """The n-grams from place a on that are smaller than top."""
        if self.file is None:
            return self.grams[a : self.many if top is None else int(np.searchsorted(self.grams, np.uint32(top)))]
        stop = self.many if top is None else min(self.many, EVERY * int(np.searchsorted(self.grams, np.uint32(top))))
        if stop <= a:
            return np.empty(0, np.uint32)
        found = self._read(self.at + 4 * a, 4 * (stop - a)).view(np.uint32)
        return found if top is None else found[: int(np.searchsorted(found, np.uint32(top)))]


class _Blobs:
    """What a part's task gathers; beyond some bytes in files of the shared folder, as many as it takes."""

    def __init__(self, folder: str):
        self.folder = folder
        self.held: list[_Blob] = []
        self.open: list[_Blob] = []
        self.bytes = 0

    def add(self, raw: pa.Buffer, n: int) -> None:
        blob = _Blob(*_unpacked(raw, n))
        self.held.append(blob)
        self.open.append(blob)
        self.bytes += raw.size
        if self.bytes > GATHER_BYTES:
            self._leave()

    def _leave(self) -> None:
        files, path = common.filesystem(f"{self.folder}/{uuid.uuid4().hex}")
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        at = 0
        with files.open_output_stream(path) as out:
            for blob in self.open:
                out.write(blob.grams.astype("<u4").tobytes() + blob.places.astype("<u2").tobytes())
        for blob in self.open:
            blob.leave(files, path, at)
            at += 6 * blob.many
        self.open, self.bytes = [], 0


def _holders(blobs: list[_Blob]) -> list[np.ndarray]:
    """Of each n-gram of each blob, in how many different sets it is (255: or more); 0 for a set that an earlier blob has."""
    every = np.concatenate([x.keys for x in blobs])
    first = np.zeros(len(every), bool)
    first[np.unique(every, return_index=True)[1]] = True
    ends = np.cumsum([len(x.keys) for x in blobs])
    own = [first[end - len(x.keys) : end] for end, x in zip(ends.tolist(), blobs, strict=True)]
    out = [np.zeros(x.many, np.uint8) for x in blobs]
    at = [0] * len(blobs)
    slices = max(1, sum(x.many for x in blobs) // COUNT_AT_ONCE)
    for k in range(1, slices + 1):
        top = None if k == slices else (k << 32) // slices  # n-grams below this; blobs are in ascending order
        grams = [x.below(a, top) for x, a in zip(blobs, at, strict=True)]
        stops = [a + len(g) for a, g in zip(at, grams, strict=True)]
        alive = [mine[x.places_of(a, b)] for mine, x, a, b in zip(own, blobs, at, stops, strict=True)]
        some = np.concatenate([g[y] for g, y in zip(grams, alive, strict=True)])
        if len(some):
            order = np.argsort(some, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], np.diff(some[order]) != 0]))
            count = np.diff(np.concatenate([start, [len(some)]]))
            many = np.empty(len(some), np.uint8)
            many[order] = np.repeat(np.minimum(count, 255).astype(np.uint8), count)
            done = 0
            for x, a, b, y in zip(out, at, stops, alive, strict=True):
                n = int(y.sum())
                x[a:b][y] = many[done : done + n]
                done += n
        at = stops
    return out


def _count(spread: DataFrame, parts: int) -> DataFrame:
    """kind 0: as before. kind 1: of a set's n-grams in a part, in ascending order of their low 32 bits, in how many sets each is (a byte, 255: or more), if any is in two; and how many are."""
    names = [f.split()[0] for f in _COUNTED.split(", ")]
    folder, wide = common.workspace(spread.sparkSession, "shingles-waiting"), _width(parts)
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def rows(many: int, **col) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(col[k], t) if k in col else pa.nulls(many, t) for k, t in zip(names, types, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, _Blobs] = {}
        for batch in batches:
            kind = batch.column(0).to_numpy()
            own = batch.filter(pa.array(kind == 0))
            if own.num_rows:
                yield rows(own.num_rows, kind=own.column(0), doc_id=own.column(2), key=own.column(3), n=own.column(4), sig=own.column(5))
            sent = batch.filter(pa.array(kind == 1))
            for part, n, grams in zip(sent.column(1).to_pylist(), sent.column(4).to_pylist(), sent.column(6), strict=True):
                if wide > 1 and part not in gathered:
                    yield from counted(gathered)  # parts come one after the other
                gathered.setdefault(part, _Blobs(folder)).add(grams.as_buffer(), n)
        yield from counted(gathered)

    def counted(gathered: dict[int, _Blobs]) -> Iterator[pa.RecordBatch]:
        for part in sorted(gathered):
            blobs = gathered.pop(part).held
            for blob, held in zip(blobs, _holders(blobs), strict=True):
                keys, mine = blob.keys, blob.places_of(0, blob.many).astype(np.int64)
                shared = np.bincount(mine[held > 1], minlength=len(keys))
                have = np.flatnonzero(shared)
                if len(have):
                    stop = np.cumsum(np.bincount(mine, minlength=len(keys)))
                    start = np.concatenate([[0], stop[:-1]])
                    packed = held[np.argsort(mine, kind="stable")].tobytes()
                    yield rows(len(have), kind=np.ones(len(have), np.int32), key=keys[have], part=np.full(len(have), part, np.int32), shared=shared[have].astype(np.int32), holders=[packed[x:y] for x, y in zip(start[have].tolist(), stop[have].tolist(), strict=True)])

    if wide == 1:
        return common.map_arrow(spread.repartitionById(parts, "part"), run, _COUNTED)
    return common.map_arrow(spread.repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part"), run, _COUNTED)


def least_overlap(n: int, percent: int) -> int:
    """The smallest intersection of a set of n with any set that it links with."""
    return -(-percent * n // 100)


#: From so many postings on, short lists are merged as the runs of a merge sort, in C, instead of by a heap; few merges are that large.
HEAP_POSTINGS = 2000


def merge_short(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different members of ascending lists, ascending, and in how many lists each is."""
    if sum(map(len, lists)) <= HEAP_POSTINGS:
        merged = np.fromiter(heapq.merge(*[x.tolist() for x in lists]), np.int64)
    else:
        merged = np.sort(np.concatenate(lists), kind="stable")
    start = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]])) if len(merged) else np.empty(0, np.int64)
    return merged[start], np.diff(np.concatenate([start, [len(merged)]]))


def divide_skip(lists: list[np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
    """The members that occur in at least t of the ascending lists, and their numbers of occurrences.

    The longest lists are set aside, fewer than t; a member must occur in at least t minus their number
    of the short ones, which are merged, and is looked up in the long ones by binary search, as long as it can still reach t.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < t:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    aside = min(t - 1, int(t / (0.01 * np.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    member, count = merge_short(short)
    member, count = member[count >= t - aside], count[count >= t - aside]
    for i, x in enumerate(long):
        alive = count + (len(long) - i) >= t
        if not alive.all():
            member, count = member[alive], count[alive]
        if not len(member):
            break
        at = np.minimum(np.searchsorted(x, member), len(x) - 1)
        count = count + (x[at] == member)
    return member[count >= t], count[count >= t]


def search(sets: list[np.ndarray], label: list, queries: range, index: range, percent: int) -> list[tuple[int, int]]:
    """Links, as places, between queries and index that connect what labels and links found before don't; as many as connect all that is linked."""
    if not len(index):
        return []
    size = np.array([len(s) for s in sets], np.int64)
    number: dict = {}
    root = np.array([number.setdefault(x, len(number)) for x in label], np.int64)
    grams = np.concatenate([sets[i] for i in index])
    owner = np.repeat(np.arange(index.start, index.stop), size[index.start : index.stop])
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    key, stop = grams[start], np.concatenate([start[1:], [len(grams)]])
    found = []
    for q in queries:
        others = (root != root[q]) & (100 * size >= percent * size[q]) & (100 * size[q] >= percent * size)
        if queries == index:
            others[: q + 1] = False
        if not others[index.start : index.stop].any():
            continue
        at = np.searchsorted(key, sets[q])
        at = at[at < len(key)] if at.size and at[-1] == len(key) else at
        at = at[key[at] == sets[q][: len(at)]]
        lists = [x for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True) if len(x := owner[a:b][others[owner[a:b]]])]
        member, both = divide_skip(lists, least_overlap(int(size[q]), percent))
        for x in member[100 * both >= percent * (size[q] + size[member] - both)].tolist():
            if root[x] != root[q]:
                found.append((q, x))
                root[root == root[x]] = root[q]
    return found


_LINKS = "a binary, b binary"


def _search_group(percent: int):
    """A group's rows: sig, label, side (0: asks, 1: is asked, 2: both), grams."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("sig", "ascending")])  # an asking set may stand among the asked ones too
        sig, side = group["sig"].to_pylist(), group["side"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()]
        asks = side.count(0)
        links = search(sets, group["label"].to_pylist(), range(asks) if asks else range(len(sig)), range(asks, len(sig)), percent)
        return pa.table({"a": pa.array([sig[i] for i, _ in links], pa.binary()), "b": pa.array([sig[j] for _, j in links], pa.binary())})

    return run


def _grouped_search(members: DataFrame, sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links that the tasks find; members: keys, sig, label, side. Few members go to the sets, so that these are shuffled by group alone."""
    members = common.broadcast_if_small(common.materialize(members, "shingles-members", narrow=True))
    full = sets.select("sig", "grams").join(members, "sig").select(*keys, "sig", "label", "side", "grams")
    return full.groupBy(*keys).applyInArrow(_search_group(percent), _LINKS)


def _copies(docs: DataFrame, able: DataFrame, n: int, parts: int, percent: int, repeats: bool) -> DataFrame:
    """sig, key, n, grams, prefix of the sets that may have links; able: rep (a document that has the set), sig, held (how many sets hold its n-grams, by part); repeats: whether rows repeat ids."""
    names = ["sig", "key", "n", "grams", "prefix"]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(common.bytes_list(part), n)
        sigs = [signature(s) for s in sets]
        # of an id with several texts only the one that was asked for is meant
        mine = [i for i, wanted in enumerate(part.column(part.schema.get_field_index("sig")).to_pylist()) if wanted == sigs[i]]
        held = part.column(part.schema.get_field_index("held")).to_pylist()
        prefix = []
        for i in mine:
            s = sets[i]
            of = _part_of(s, parts)
            order = np.argsort(of << np.uint64(32) | s & _KEY)
            first = np.concatenate([[0], np.cumsum(np.bincount(of.astype(np.int64), minlength=parts))])
            holders = np.ones(len(s), np.uint8)
            for h in held[i]:
                holders[order[first[h["part"]] : first[h["part"] + 1]]] = np.frombuffer(h["holders"], np.uint8)
            rare = np.argsort(holders, kind="stable")[: len(s) - least_overlap(len(s), percent) + 1]
            prefix.append(s[rare].view(np.int64))
        columns = [pa.array([sigs[i] for i in mine], pa.binary()), pa.array([_key_of(sigs[i]) for i in mine], pa.int64()), pa.array([len(sets[i]) for i in mine], pa.int32()), pa.array([sets[i].tobytes() for i in mine], pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names)

    wanted = able.select(F.col("rep").alias("doc_id"), "sig", "held")
    texts = docs.join(common.broadcast_if_small(wanted.select("doc_id")), "doc_id", "left_semi").join(wanted, "doc_id")
    made = common.map_slices(texts.select("doc_id", "text", "sig", "held"), run, "sig binary, key long, n int, grams binary, prefix array<long>")
    return made.dropDuplicates(["sig"]) if repeats else made


def _parts(docs: DataFrame, part_bytes: int) -> int:
    """Parts that n-grams are dealt into, by the bytes of the stored input; as many as there are shuffle partitions where these aren't known."""
    size = common.stored_bytes(docs)
    return common.shuffle_partitions(docs.sparkSession) if size is None else max(LEAST_PARTS, -(-size // part_bytes))


def linked_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    texts = common.texts_only(docs, id_col, text_col, named=True)
    parts = _parts(docs, part_bytes)
    counted = common.materialize(_count(_spread(texts, n, parts), parts), "shingles-counted", free=True)
    own = counted.where("kind = 0").select("doc_id", "key", "n", "sig")
    shared = counted.where("kind = 1").select("key", "part", "shared", "holders")
    repeats = own.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    reps = own.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("key").alias("key"), F.first("n").alias("n"))
    able = reps.join(shared.groupBy("key").agg(F.sum("shared").alias("shared")), "key").where(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("n"))
    able = common.materialize(able.select("sig", "rep", "key"), "shingles-able", narrow=True)
    held = shared.join(common.broadcast_if_small(able.select("key")), "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("part", "holders")).alias("held"))
    sets = common.materialize(_copies(texts, able.join(held, "key"), n, parts, percent, repeats), "shingles-sets", free=True)

    blocks = _blocks(sets)
    small = blocks.where("NOT large").select("block", "sig", F.col("sig").alias("label"), F.lit(2).alias("side"))
    links = common.materialize(_grouped_search(small, sets, ["block"], percent), "shingles-links", narrow=True)
    if blocks.where("large").limit(1).count():
        hot = blocks.where("large").select("block", "sig", "n")
        links = common.materialize(links.union(_some_ask(hot, sets, percent)), "shingles-some", narrow=True)
        label = _labels(hot, links)
        left = _blocks(sets, label)
        some = left.where("NOT large").select("block", "sig", "label", F.lit(2).alias("side"))
        links = links.union(_grouped_search(some, sets, ["block"], percent))
        if left.where("large").limit(1).count():
            links = links.union(_rest_asks(left.where("large").select("block", "sig", "n", "label"), sets, percent))
        links = common.materialize(links, "shingles-rest", narrow=True)

    if repeats:
        several = own.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a != b").select("doc_id")
        several = common.materialize(several, "shingles-several", narrow=True)  # ids with more than one set
        theirs = own.where("n > 0").join(several, "doc_id", "left_semi")
        links = links.union(theirs.join(theirs.groupBy("doc_id").agg(F.min("sig").alias("b")), "doc_id").select(F.col("sig").alias("a"), "b"))
    reached = components(links).select(F.col("a").alias("sig"), F.col("b").alias("root"))
    reached = reached.union(reached.select(F.col("root").alias("sig"), "root").distinct())
    least = reached.join(reps.select("sig", "rep"), "sig").groupBy("root").agg(F.min("rep").alias("component_id"))
    found = reps.select("sig", "rep").join(reached.join(least, "root").select("sig", "component_id"), "sig", "left").select("sig", F.coalesce("component_id", "rep").alias("component_id"))
    found = common.materialize(found, "shingles-sets-found", narrow=True)  # a table, so that Spark can split a digest that a third of all documents have
    out = own.join(found, "sig", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if repeats:
        out = common.materialize(out, "shingles-out", narrow=True)
        one = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("one"))
        out = out.join(one, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("one", "component_id").alias("component_id"))
    return out


def _blocks(sets: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """block, sig, n, large (and label) of the sets that share prefix n-grams, directly or by way of others.

    label: sig, label; only sets that have one take part, and only n-grams whose sets differ in it count.
    Sets go by half of their digest here: two of one half would share a block, which harms nothing.
    """
    every = sets.select("sig", "key", "n", "prefix")
    if label is None:
        grams = every.select("key", F.explode("prefix").alias("gram"))
        meeting = grams.groupBy("gram").agg(F.min("key").alias("first"), F.count("*").alias("met")).where("met > 1")
    else:
        every = every.join(label, "sig")
        grams = every.select("key", F.xxhash64("label").alias("label"), F.explode("prefix").alias("gram"))
        meeting = grams.groupBy("gram").agg(F.min("key").alias("first"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    meets = grams.join(meeting.select("gram", "first"), "gram").where("key != first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    block = components(meets).select(F.col("a").alias("key"), F.col("b").alias("block"))
    block = block.union(block.select(F.col("block").alias("key"), "block").distinct())
    block = block.join(every.drop("prefix"), "key").drop("key")
    weight = block.groupBy("block").agg(F.count("*").alias("docs"), F.sum("n").alias("grams"))
    large = (F.col("docs") > BLOCK_DOCS) | (F.col("grams") > BLOCK_GRAMS)
    return common.materialize(block.join(weight.select("block", large.alias("large")), "block"), "shingles-blocks", narrow=True)


def _labels(hot: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("a").alias("sig"), F.col("b").alias("label"))
    return common.materialize(hot.join(found, "sig", "left").select("sig", F.coalesce("label", "sig").alias("label")), "shingles-labels", narrow=True)


def _load(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many chunks the documents of each group go to, no more than there are documents; and the documents (name_docs)."""
    chunks = F.least("docs", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("grams") / BLOCK_GRAMS))).cast("int")
    return rows.groupBy(*by).agg(F.count("*").alias("docs"), F.sum("n").alias("grams")).select(*by, chunks.alias(name), F.col("docs").alias(f"{name}_docs"))


def _dealt(rows: DataFrame, by: list[str], name: str, to: str) -> DataFrame:
    """rows with their chunk: in turn, largest first, where a group has few documents, as a hash would leave chunks empty; by hash where it has many."""
    hashed = F.pmod(F.xxhash64("sig"), F.col(name)).cast("int")
    few = F.col(f"{name}_docs") <= BLOCK_DOCS
    turn = F.row_number().over(Window.partitionBy(*by, F.when(few, -1).otherwise(hashed)).orderBy(F.desc("n"), "sig"))
    return rows.withColumn(to, F.when(few, (turn - 1) % F.col(name)).otherwise(hashed).cast("int"))


def _some_ask(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """In large blocks: some sets ask all, in chunks."""
    first = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("sig"), "sig"))
    asks = hot.select("block", "sig", first.alias("place")).where(F.col("place") <= ASKING)
    load = common.materialize(_load(hot, ["block"], "chunks"), "shingles-load", narrow=True)
    index = _dealt(hot.join(load, "block"), ["block"], "chunks", "chunk").select("block", "chunk", "sig", F.col("sig").alias("label"), F.lit(1).alias("side"))
    query = asks.join(load, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "sig", F.col("sig").alias("label"), F.lit(0).alias("side"))
    return _grouped_search(index.union(query), sets, ["block", "chunk"], percent)


def _rest_asks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """In blocks that are large still (block, sig, n, label): every set that isn't connected with most of its block asks all that it isn't connected with, chunk against chunk.

    Linked sets differ in size by percent at most, so they are in the same band of sizes or in neighbouring ones.
    """
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent) + 1e-6)).cast("int") if percent < 100 else F.col("n")
    each = rows.groupBy("block", "label").agg(F.count("*").alias("docs"))
    most = each.groupBy("block").agg(F.max_by("label", F.struct("docs", "label")).alias("main"))
    rows = common.materialize(rows.join(most, "block").withColumn("band", band), "shingles-open", narrow=True)
    few = rows.where("label != main")
    asked, asking = (common.materialize(_load(r, ["block", "band"], c), "shingles-load", narrow=True) for r, c in ((rows, "x_chunks"), (few, "q_chunks")))
    near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))
    of = lambda load, name: load.select("block", F.col("band").alias(name), f"{name[0]}_chunks")
    index = _dealt(rows.join(asked, ["block", "band"]), ["block", "band"], "x_chunks", "j").select("block", F.col("band").alias("x_band"), "j", "sig", "label", near.alias("q_band"))
    index = index.join(of(asking, "q_band"), ["block", "q_band"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("q_chunks") - 1)))
    query = _dealt(few.join(asking, ["block", "band"]), ["block", "band"], "q_chunks", "i").select("block", F.col("band").alias("q_band"), "i", "sig", "label", near.alias("x_band"))
    query = query.join(of(asked, "x_band"), ["block", "x_band"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("x_chunks") - 1)))
    keys = ["block", "q_band", "i", "x_band", "j"]
    both = index.select(*keys, "sig", "label", F.lit(1).alias("side")).unionByName(query.select(*keys, "sig", "label", F.lit(0).alias("side")))
    return _grouped_search(both, sets, keys, percent)


def keep(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest doc_id; rows without an id stay.

    Of repeated rows of an id one stays, the first by its text.
    """
    found = common.materialize(linked_components(docs, n, percent).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "shingles-found", narrow=True)
    goes = found.where("doc_id != component_id").select("doc_id")
    kept = docs.join(common.broadcast_if_small(goes), "doc_id", "left_anti").select(*docs.columns)
    if found.where("rows > 1").limit(1).count():
        again = found.where("rows > 1").select("doc_id")
        order = Window.partitionBy("doc_id").orderBy(F.coalesce("text", F.lit("")))
        row = common.fresh_name(docs.columns, "row")
        once = kept.join(again, "doc_id", "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).select(*docs.columns)
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return kept
