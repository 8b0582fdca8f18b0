"""Operator 8: quality rules as a short-circuit cascade.

All rules must pass, so their order changes the cost of a verdict and never the verdict.
On a bounded sample of the documents each rule's seconds and rejections are measured, among those
that the rules chosen before it let pass; the one with most rejections per second is next. A rule
looks only at documents that no rule before it has rejected, and a measure is taken of a document
when a rule first asks for it.

Words are runs of anything but ASCII white space. Null and empty texts have no words and
fail the base rule. Every rule is a function of one text alone; ties and repeated rows
don't matter. Very long texts are measured whole. Rows without an id come back too, and ``keep`` returns all columns as they are, whatever
their names; an empty table makes no rows.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusflow.llm import common

# The base rule's limits and the characters that count as symbols.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: Documents (at most, in expectation) on which costs and selectivities are measured.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 32 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_START = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_BANG = re.compile(rb"!![ \t-\r]|!!\Z")


class Texts:
    """A slice of documents; each measure is taken of a document when something first asks for it."""

    #: What is measured together.
    TOGETHER = {"words": ("n_words",), "characters": ("word_chars", "n_symbols"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words",)}

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.words: list[list[bytes] | None] = [None] * len(raw)
        self.known = {group: np.zeros(len(raw), bool) for group in self.TOGETHER}
        self._value = {name: np.zeros(len(raw), np.int64) for names in self.TOGETHER.values() for name in names}

    def fork(self) -> Texts:
        """The same documents with what is known so far, to try something without changing this."""
        out = Texts(self.raw)
        out.words = list(self.words)
        out.known = {k: v.copy() for k, v in self.known.items()}
        out._value = {k: v.copy() for k, v in self._value.items()}
        return out

    def get(self, name: str, at: np.ndarray | None = None) -> np.ndarray:
        """A measure of the documents at; of all by default."""
        at = np.arange(len(self.raw)) if at is None else at
        group = next(g for g, names in self.TOGETHER.items() if name in names)
        new = at[~self.known[group][at]]
        if len(new):
            for k, v in zip(self.TOGETHER[group], getattr(self, f"_{group}")(new), strict=True):
                self._value[k][new] = v
            self.known[group][new] = True
        return self._value[name][at]

    def split(self, at: np.ndarray) -> list[list[bytes]]:
        self.get("n_words", at)
        return [self.words[i] for i in at.tolist()]

    def _words(self, at: np.ndarray) -> tuple[np.ndarray]:
        for i in at.tolist():
            self.words[i] = self.raw[i].split()
        return (np.array([len(self.words[i]) for i in at.tolist()], np.int64),)

    def _characters(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = [self.raw[i] for i in at.tolist()]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(b) for b in raw])
        total = lambda flags: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[ends]]))
        return total(_START[flat] & ~_SPACE[flat]), total(_SYMBOL[flat])

    def _lines(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dup, every = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
        for k, i in enumerate(at.tolist()):
            if b"\n" in self.raw[i]:
                lines = [x for x in self.raw[i].split(b"\n") if x.strip()]
                dup[k], every[k] = len(lines) - len(set(lines)), max(1, len(lines))
        return dup, every

    def _repeats(self, at: np.ndarray) -> tuple[np.ndarray]:
        """Words that lie in a 3-word window found at least twice in their text."""
        split = self.split(at)
        size = np.array([len(w) for w in split], np.int64)
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(at)), size)
        if len(ids) < 4:
            return (np.zeros(len(at), np.int64),)
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        three = np.unique(pair[:-1][inside] * len(number) + ids[2:][inside], return_inverse=True)[1]
        _, window, count = np.unique(three * len(at) + doc[inside], return_inverse=True, return_counts=True)
        hit = inside[count[window] >= 2]
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[hit + k] = True
        return (np.bincount(doc[covered], minlength=len(at)),)

    def base_failed(self) -> np.ndarray:
        return (self.get("n_words") < MIN_WORDS) | (100 * self.get("n_repeat_words") > MAX_REPEAT_PERCENT * self.get("n_words"))


@dataclass(frozen=True)
class Rule:
    """rejects(texts, which): of the documents which, those that the rule rejects."""

    name: str
    rejects: Callable[[Texts, np.ndarray], np.ndarray]


def _mean_length(t: Texts, at: np.ndarray) -> np.ndarray:
    n, chars = t.get("n_words", at), t.get("word_chars", at)
    return (chars < 2 * n) | (chars > 15 * n)


def _symbols(t: Texts, at: np.ndarray) -> np.ndarray:
    return 10 * t.get("n_symbols", at) > 2 * t.get("n_words", at)


def _lines(t: Texts, at: np.ndarray) -> np.ndarray:
    return 10 * t.get("n_dup_lines", at) > 4 * t.get("n_lines", at)


def _repeats(t: Texts, at: np.ndarray) -> np.ndarray:
    return 100 * t.get("n_repeat_words", at) > MAX_REPEAT_PERCENT * t.get("n_words", at)


def _few_words(t: Texts, at: np.ndarray) -> np.ndarray:
    return t.get("n_words", at) < MIN_WORDS


def _shouting(t: Texts, at: np.ndarray) -> np.ndarray:
    """More than half of the words end in two exclamation marks."""
    loud = np.array([len(_BANG.findall(t.raw[i])) if b"!!" in t.raw[i] else 0 for i in at.tolist()], np.int64)
    out = loud > 0
    out[out] = 2 * loud[out] > t.get("n_words", at[out])
    return out


def _few_different(t: Texts, at: np.ndarray) -> np.ndarray:
    """Fewer than one word in twenty differs from those before it; long documents repeat more by nature."""
    return np.array([20 * len(set(w)) < min(len(w), 2000) for w in t.split(at)], bool)


RULES = (Rule("few_words", _few_words), Rule("repeats", _repeats), Rule("symbols", _symbols), Rule("mean_length", _mean_length), Rule("dup_lines", _lines), Rule("shouting", _shouting), Rule("few_different", _few_different))


def order_rules(sample: list[bytes], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Most rejections per second next, of the sample's documents that the rules before it let pass; what these have measured costs nothing more."""
    texts, alive, left, out = Texts(sample), np.arange(len(sample)), list(rules), []
    while left:
        tried = []
        for rule in left:
            trial = texts.fork()
            began = time.thread_time()
            rejected = rule.rejects(trial, alive) if len(alive) else np.zeros(0, bool)
            cost = max(time.thread_time() - began, 1e-9)
            tried.append((-int(rejected.sum()) / cost, cost, len(tried), trial, rejected))
        _, _, best, texts, rejected = min(tried, key=lambda x: x[:3])
        alive = alive[~rejected]
        out.append(left.pop(best))
    return tuple(out)


def verdicts(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which documents every rule lets pass; what a rule rejects costs those behind it nothing."""
    alive = np.arange(len(texts.raw))
    for rule in rules:
        if len(alive):
            alive = alive[~rule.rejects(texts, alive)]
    kept = np.zeros(len(texts.raw), bool)
    kept[alive] = True
    return kept


def measured_order(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, ...]:
    """The rules' names in the order that one task finds best for the documents with the smallest hashed ids: ``rows`` at most, and SAMPLE_BYTES of text."""
    sampled = common.sample(common.texts_only(docs, id_col, text_col), "doc_id", rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: list[bytes] = []
        size = 0
        for batch in batches:
            for text in common.bytes_list(batch):
                if size <= SAMPLE_BYTES:
                    raw.append(text)
                    size += len(text)
        names = [r.name for r in order_rules(raw)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(names)], ["place", "name"])

    found = common.map_arrow(sampled.coalesce(1), run, "place int, name string").collect()
    return tuple(r.name for r in sorted(found)) or tuple(r.name for r in RULES)


def _ordered(names: tuple[str, ...]) -> tuple[Rule, ...]:
    by_name = {r.name: r for r in RULES}
    return tuple(by_name[n] for n in names)


def cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document the base measures, whether the base rule fails, and the cascade's verdict. The verdict comes first; the measures of what is rejected are taken for the report alone."""
    rules = measured_order(docs, sample_rows, id_col, text_col)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        t = Texts(common.bytes_list(part))
        kept = verdicts(t, _ordered(rules))
        return pa.RecordBatch.from_arrays([common.ids_of(part), *[pa.array(t.get(x)) for x in names[1:6]], pa.array(t.base_failed()), pa.array(kept)], names)

    return common.map_slices(common.texts_only(docs, id_col, text_col), run, schema)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows, with all their columns, that every rule lets pass; nothing is measured that no verdict needs."""
    rules = measured_order(docs, sample_rows, id_col, text_col)
    return common.keep_rows(docs, lambda raw: verdicts(Texts(raw), _ordered(rules)), text_col)
