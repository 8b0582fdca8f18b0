"""Operator 9: a quality classifier on supervised subword embeddings.

A text is the mean of learned vectors: one for each word, for each character 3- and 4-gram
of the word between its boundaries, and for each pair of neighbouring words, all hashed into
one table of buckets (two equal neighbours share one bucket). A softmax over two classes
sits on top; vectors and softmax are learned together by stochastic gradient descent in
numpy.

Scoring needs the softmax of a mean only, so each bucket's vector shrinks to one number,
its part of the difference between the classes; each word's numbers are added up once and
remembered by the worker.

Learning takes a bounded sample of labelled rows, picked by hashed id. Null and empty
texts have no vectors and get the score of the bias. Without labels every score is 0.5.
Repeated labels of a document count by their smallest value. A score of exactly 0.5 counts as class 1.
Repeated rows and rows without an id are scored row by row, very long texts whole; ``keep`` returns all columns as they are,
whatever their names. An empty table makes no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common

BITS = 17
BUCKETS = 1 << BITS
#: The bucket of two equal words side by side.
SAME = 0
#: Labelled rows to learn from, at most.
SAMPLE_ROWS = 3000
#: Words that one worker remembers before it starts afresh.
MAX_WORDS = 250_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def word_buckets(words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, bucket) of every word and subword, ordered by place."""
    joined = b"<" + b"><".join(words) + b">"
    size = np.array([len(w) + 2 for w in words], np.int64)
    place = np.repeat(np.arange(len(words)), size)
    if joined.isascii():
        flat = np.frombuffer(joined, np.uint8).astype(np.uint64)
    else:
        flat = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4").astype(np.uint64)
        place = place[(np.frombuffer(joined, np.uint8) & 0xC0) != 0x80]  # the first bytes of characters
    places, buckets = [np.arange(len(words))], [_bucket(hashes ^ np.uint64(0x5BD1E995))]
    h = flat + np.uint64(1)
    for n in (1, 2, 3):
        h = h[:-1] * np.uint64(0x100000001B3) + flat[n:]
        if n > 1 and len(h):
            inside = place[: len(h)] == place[n:]
            places.append(place[: len(h)][inside])
            buckets.append(_bucket(h[inside] + np.uint64(n)))
    at, bucket = np.concatenate(places), np.concatenate(buckets)
    order = np.argsort(at, kind="stable")
    return at[order], bucket[order]


def pair_buckets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of all pairs of neighbouring words within a document."""
    inside = doc[:-1] == doc[1:]
    a, b = hashes[:-1][inside], hashes[1:][inside]
    return doc[:-1][inside], np.where(a == b, SAME, _bucket(a * np.uint64(0xC2B2AE3D27D4EB4F) + b))


@dataclass
class Model:
    """part[b]: what a vector in bucket b adds to the logit of class 1."""

    part: np.ndarray
    bias: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class _Words(dict):
    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores texts; remembers each word's hash, number of vectors and sum of parts."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.index = _Words()
        self.hash, self.sum, self.count = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64)

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        hashes = word_hashes(new)
        at, bucket = word_buckets(new, hashes)
        need = len(self.index)
        if need > len(self.hash):
            more = max(need, 2 * len(self.hash)) - len(self.hash)
            self.hash, self.sum, self.count = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.hash, self.sum, self.count))
        first = need - len(new)
        self.hash[first:need] = hashes
        self.sum[first:need] = np.bincount(at, self.model.part[bucket], len(new))
        self.count[first:need] = np.bincount(at, minlength=len(new))

    def scores(self, raw: list[bytes]) -> np.ndarray:
        if len(self.index) > MAX_WORDS:
            self._reset()
        words = [b.split() for b in raw]
        size = np.array([len(w) for w in words], np.int64)
        at = np.fromiter((i for w in words for i in map(self.index.__getitem__, w)), np.int64, int(size.sum()))
        if self.index.new:
            self._learn()
        doc = np.repeat(np.arange(len(raw)), size)
        pair_doc, pair = pair_buckets(self.hash[at], doc)
        n = len(raw)
        total = np.bincount(doc, self.sum[at], n) + np.bincount(pair_doc, self.model.part[pair], n)
        count = np.bincount(doc, self.count[at], n) + np.bincount(pair_doc, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.model.bias, -30, 30)))


def _scorer(model: Model) -> Scorer:
    """This process's scorer of a model: tasks in the same Python worker share the words it knows."""
    return common.resident(f"scorer {model.name}", lambda: Scorer(model))


def _bags(raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its different buckets and their shares."""
    out = []
    for b in raw:
        words = b.split()
        if not words:
            out.append((np.empty(0, np.int32), np.empty(0, np.float32)))
            continue
        hashes = word_hashes(words)
        bucket = np.concatenate([word_buckets(words, hashes)[1], pair_buckets(hashes, np.zeros(len(words), np.int64))[1]])
        which, count = np.unique(bucket, return_counts=True)
        out.append((which.astype(np.int32), (count / len(bucket)).astype(np.float32)))
    return out


#: What a text is learnt from: different buckets, and the share of each.
Bag = tuple[np.ndarray, np.ndarray]


def fit(bags: list[Bag], y: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 3.0) -> Model:
    """Plain stochastic gradient descent, one text at a time, with a falling rate."""
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    top, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            which, share = bags[i][0], bags[i][1].astype(np.float32)
            step = rate * (1 - steps / total)
            steps += 1
            mean = share @ vectors[which]
            z = top @ mean + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            back = g @ top
            top -= step * np.outer(g, mean)
            bias -= 0.1 * step * g
            vectors[which] -= step * share[:, None] * back
    return Model((vectors @ (top[1] - top[0])).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """labels: doc_id, quality. Only documents for which usable holds (an expression over doc_id) are learnt from."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    picked = known.where(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = common.texts_only(docs).join(F.broadcast(picked), "doc_id").limit(sample_rows)  # broadcast: at most sample_rows pairs of numbers

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        raw = common.bytes_list(part)
        bags = _bags(raw)
        packed = [zlib.compress(np.diff(which, prepend=0).astype("<i4").tobytes() + share.astype("<f4").tobytes(), 1) for which, share in bags]
        return pa.RecordBatch.from_arrays([common.ids_of(part), pa.array([hashlib.sha256(b).digest() for b in raw], pa.binary()), part.column(2), pa.array(packed, pa.binary())], ["doc_id", "sha", "quality", "bag"])

    # the driver gets sample_rows bags of buckets, of which a text has as many as different words and n-grams, 2 ** BITS at most
    rows = common.map_slices(texts, run, "doc_id long, sha binary, quality int, bag binary").toArrow()
    if rows.num_rows == 0:
        return Model(np.zeros(BUCKETS), 0.0)
    rows = rows.sort_by([("doc_id", "ascending"), ("sha", "ascending")])
    bags, y = [_unpacked(b.as_buffer()) for b in rows["bag"]], rows["quality"].to_numpy().astype(np.int64)
    del rows
    return fit(bags, y)


def _unpacked(raw: pa.Buffer) -> Bag:
    b = zlib.decompress(raw)
    return np.cumsum(np.frombuffer(b, "<i4", len(b) // 8), dtype=np.int32), np.frombuffer(b, "<f4", len(b) // 8, len(b) // 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: class 1 likelier), predicted."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        s = _scorer(model).scores(common.bytes_list(part))
        return pa.RecordBatch.from_arrays([common.ids_of(part), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return common.map_slices(common.texts_only(docs), run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of class 1, with all their columns."""
    return common.keep_rows(docs, lambda raw: _scorer(model).scores(raw) >= 0.5)
