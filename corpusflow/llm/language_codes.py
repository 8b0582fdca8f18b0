"""Operator 2: language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a logistic classifier over hashed byte
n-grams learns which side a text is on; decoding picks the language whose codeword loses
least, each bit's loss weighted by how reliable its classifier was on held-back sample
rows. Two codewords nearly as close make a text ambiguous.

Learning takes a bounded sample: at most about ``per_language`` labelled rows of each
language, picked by hashed id. Texts are used whole, in learning and predicting.

Null texts and texts without a letter are ``und`` with score 0 and not ambiguous. Without
any labelled row all texts are ``und``. Of equally near codewords the language that comes first by name
counts. Repeated rows and rows without an id are predicted one by one, very long texts whole; ``keep`` returns all
columns as they are, whatever their names. An empty table makes no rows.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common

#: Buckets for hashed n-grams of 1 to 3 bytes.
BITS = 12
BUCKETS = 1 << BITS
#: Labelled rows of a language to learn from, about at most.
PER_LANGUAGE = 500
#: A text is ambiguous if the two best languages' shares differ by less.
AMBIGUOUS = 0.2

_LETTER = re.compile(rb"[A-Za-z]")
#: What a byte counts as: letters in lower case, bytes of other scripts as they are, all else a space.
_CLASS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: every split of the classes up to 7 of them, else distant random ones."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=n - 1) if -1 in s]
        return np.array(splits, np.float32).T
    rng = np.random.default_rng(7)
    tries = (np.where(rng.random((n, 4 * int(np.ceil(np.log2(n))) + 8)) < 0.5, -1, 1).astype(np.float32) for _ in range(200))
    return max(tries, key=lambda m: ((m[:, None] != m[None]).sum(-1) + np.eye(n) * 1e9).min())


def has_letter(raw: bytes) -> bool:
    return bool(_LETTER.search(raw)) or (not raw.isascii() and any(map(str.isalpha, raw.decode())))


def features(raw: list[bytes]) -> np.ndarray:
    """A row of unit length for each text: square roots of its n-gram counts."""
    size = np.array([len(b) + 1 for b in raw], np.int64)
    flat = _CLASS[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    row = np.repeat(np.arange(len(raw)) * BUCKETS, size)
    out = np.zeros(len(raw) * BUCKETS, np.float32)
    h = flat + np.uint32(0x9E37)
    for n in range(3):
        if n:
            h = h[:-1] * np.uint32(0x01000193) ^ flat[n:]
        if n and len(h) == 0:
            break
        first = row[: len(h)]
        inside = first == row[n:] if n else slice(None)
        bucket = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out += np.bincount((first + bucket)[inside], minlength=len(out))
    x = np.sqrt(out).reshape(len(raw), BUCKETS)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def shares(self, x: np.ndarray) -> np.ndarray:
        """For each text and language: 0 to 1, more for less weighted loss."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(1) for c in self.code], axis=1)
        e = np.exp(loss.min(1, keepdims=True) - loss)
        return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], epochs: int = 30, rate: float = 0.5) -> Model:
    """AdaGrad on the logistic loss of all bits at once; a fifth of the rows sets the bits' weights."""
    rng = np.random.default_rng(11)
    code = codewords(len(languages))
    order = rng.permutation(len(x))
    held, train = order[: len(x) // 5], order[len(x) // 5 :]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    gw, gb = np.full_like(w, 1e-4), np.full_like(b, 1e-4)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            target = code[y[at]]
            g = -target / (1 + np.exp(np.clip(target * (x[at] @ w + b), -30, 30))) / len(at)
            dw, db = x[at].T @ g + 1e-6 * w, g.sum(0)
            gw += dw * dw
            gb += db * db
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
    wrong = ((x[held] @ w + b) * code[y[held]] <= 0).mean(0) if len(held) else np.zeros(code.shape[1])
    trust = np.log((1 - (e := np.clip(wrong, 1e-3, 0.49))) / e)
    return Model(languages, code, w, b, (trust / trust.mean()).astype(np.float32))


def learn(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """docs: doc_id, text, lang. Rows where usable holds and lang isn't null may be learnt from."""
    rows = docs.where(usable & F.col("lang").isNotNull())
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # as many as there are languages
    if not count:
        return None
    languages = tuple(sorted(count))
    # the smallest hashed ids of each language, of which no more are told apart than it takes
    ids, hashed = rows.select("doc_id", "lang"), F.xxhash64("doc_id")
    below = F.create_map(*[F.lit(x) for k in languages for x in (k, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 8 * per_language // count[k]))])
    first = lambda some: common.fewest(some.distinct(), "lang", [hashed, F.col("doc_id")], per_language)
    picked = first(ids.where(hashed <= below[F.col("lang")]))
    found = {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}
    if any(found.get(k, 0) < min(per_language, count[k]) for k in languages):  # ids repeat
        picked = first(ids)
    # of an id that repeats all rows meet now; the first by their texts stay
    texts = rows.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))  # broadcast: per_language ids a language
    picked = common.fewest(texts, "lang", [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("text")], per_language)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        x = features(common.bytes_list(part)).astype(np.float16)
        return pa.RecordBatch.from_arrays([common.ids_of(part), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    got = row = common.map_slices(picked, run, "doc_id long, lang string, x binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    x = np.empty((got.num_rows, BUCKETS), np.float32)
    for i, row in enumerate(got["x"]):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    y = np.array([languages.index(v) for v in got["lang"].to_pylist()], np.int64)
    del got, row
    return fit(x, y, languages)


def decide(raw: list[bytes], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text its language, that language's share, and whether it is ambiguous."""
    known = np.array([model is not None and has_letter(b) for b in raw], bool)
    lang, score, unsure = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw), bool)
    if known.any():
        at = np.flatnonzero(known)
        p = model.shares(features([raw[i] for i in at]))
        two = np.sort(p, axis=1)[:, -2:]
        score[at] = two[:, -1]
        unsure[at] = two[:, -1] - two[:, 0] < AMBIGUOUS if p.shape[1] > 1 else False
        for i, k in zip(at.tolist(), p.argmax(1).tolist(), strict=True):
            lang[i] = model.languages[k]
    return lang, score, unsure


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all their columns, whose text has a language; those are left out that are ``und``, or ambiguous among more than two languages."""

    def keeps(raw: list[bytes]) -> np.ndarray:
        lang, score, unsure = decide(raw, model)
        return np.array([k != "und" for k in lang], bool) & ~(unsure & (score < 0.4))

    return common.keep_rows(docs, keeps)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (the share of the predicted language), ambiguous."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, unsure = decide(common.bytes_list(part), model)
        return pa.RecordBatch.from_arrays([common.ids_of(part), pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return common.map_slices(common.texts_only(docs), run, "doc_id long, lang_pred string, score double, ambiguous boolean")
