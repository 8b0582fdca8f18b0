"""Operator 7: byte-pair encoding with forced boundaries, and decoding.

A merge joins two neighbours into a vocabulary token, so two neighbouring bytes that stand
side by side inside no token can never be joined. Each such pair is a certain cut: the
fragments between cuts are encoded independently and their ids concatenated. Fragments are
short and recur, so workers remember them, and very long words cost no more than their parts.

Handled are tokenizers files with a BPE model with an end-of-word suffix over byte-level
symbols, NFC and lower case as normalizer and a regular expression that picks words: the
ids equal those of the tokenizers library with ``add_special_tokens=False``, and decoding
equals its ``decode(ids, skip_special_tokens=False)`` without a decoder.

Null and empty texts have no ids and decode to the empty string. Repeated rows and rows without
an id come back row by row; very long texts are cut word by word, and long words into fragments. Other columns,
whatever their names, are not looked at; there are no ties. An empty table makes no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusflow.llm import common
from corpusflow.llm.unit_encoder import WHITE_SPACE, _tokenizer, byte_symbols, is_latin

#: Units and fragments that one worker remembers before it starts afresh.
MAX_UNITS = 400_000
MAX_FRAGMENTS = 200_000
#: From so many symbols on, merges are taken from a heap.
LONG = 48

def _ranges(characters: list[str]) -> list[list[str]]:
    out: list[list[str]] = []
    for c in characters:
        if out and ord(out[-1][1]) == ord(c) - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return out


_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_UNIT = re.compile(f"[^{WHITE_SPACE}]+")


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.symbols = byte_symbols()
        self.plain = [vocab[c] for c in self.symbols]
        self.last = [vocab[c + self.suffix] for c in self.symbols]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = tuple({c[:2] for c in self.special})  # special tokens are found before lower-casing
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        picked = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(picked.replace(r"\s", WHITE_SPACE))
        self.library = _tokenizer(path)  # asked about code points that Python's tables don't know
        self._learn_pairs(vocab)
        self.fragments: dict[tuple[bytes, bool], tuple[int, ...]] = {}
        self.units: dict[str, tuple[int, str, str]] = {}

    @cached_property
    def has_newer(self) -> Callable[[str], object]:
        """Whether a text holds code points that Python's tables don't know."""
        unknown = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn"]
        return re.compile("[" + "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in _ranges(unknown)) + "]").search

    @cached_property
    def stand_in(self) -> dict[int, str]:
        """For those of them that the library takes for something else than the patterns here do: a character of that kind."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        out = {}
        for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))):
            if unicodedata.category(c) == "Cn":
                kind = "a" if len(split(f"a{c}")) == 1 else "1" if len(split(c + c)) == 2 else "#"
                if regex.fullmatch(r"\p{L}", c) is None or kind != "a":
                    out[ord(c)] = kind
        return out

    def _learn_pairs(self, vocab: dict[str, int]) -> None:
        """joined[end][a * 256 + b]: whether some token has a before b; end: b is a word's last byte, by its suffix."""
        number = {c: i for i, c in enumerate(self.symbols)}
        self.joined = (bytearray(1 << 16), bytearray(1 << 16))
        for token in vocab:
            end = token.endswith(self.suffix) and token != self.suffix
            body = [number[c] for c in (token[: -len(self.suffix)] if end else token) if c in number]
            for i in range(len(body) - 1):
                self.joined[end and i == len(body) - 2][body[i] * 256 + body[i + 1]] = 1

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments of a word between its forced boundaries."""
        inner, at_end = self.joined
        out, start, n = [], 0, len(word)
        for i in range(1, n):
            if not (at_end if i == n - 1 else inner)[word[i - 1] * 256 + word[i]]:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _fragment(self, piece: bytes, last: bool) -> tuple[int, ...]:
        if (ids := self.fragments.get((piece, last))) is not None:
            return ids
        parts = [self.plain[b] for b in piece]
        if last:
            parts[-1] = self.last[piece[-1]]
        ids = tuple(self._merge_long(parts) if len(parts) >= LONG else self._merge_short(parts))
        if len(self.fragments) >= MAX_FRAGMENTS:
            self.fragments.clear()
        if len(piece) < LONG:
            self.fragments[piece, last] = ids
        return ids

    def _merge_short(self, parts: list[int]) -> list[int]:
        get = self.merge.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                found = get((parts[i], parts[i + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            parts[at : at + 2] = [best[1]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """Lowest rank first, leftmost first, over a linked list."""
        get, n = self.merge.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(f[0], i, parts[i], parts[i + 1], f[1]) for i in range(n - 1) if (f := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if f := get((new, parts[k])):
                    heapq.heappush(heap, (f[0], i, new, parts[k], f[1]))
            if (h := before[i]) >= 0 and (f := get((parts[h], new))):
                heapq.heappush(heap, (f[0], h, parts[h], new, f[1]))
        return [x for x in parts if x >= 0]

    def _segment(self, text: str) -> list[int]:
        if text.isascii() or is_latin(text):
            words = self.words.findall(text.lower())
        elif self.has_newer(text):
            text = self.library.normalizer.normalize_str(text)
            words = [text[m.start() : m.end()] for m in self.words.finditer(text.translate(self.stand_in))]
        else:  # lower case is of each character alone: no final sigma
            words = self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        ids: list[int] = []
        for word in words:
            pieces = self.cuts(word.encode())
            for piece in pieces[:-1]:
                ids += self._fragment(piece, False)
            ids += self._fragment(pieces[-1], True)
        return ids

    def _unit(self, unit: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.special_re.split(unit)):
            ids += [self.special[part]] if i % 2 else self._segment(part)
        return ids

    def split(self, text: str) -> list[str]:
        """The parts between white space; words never cross it. Lower case already, where that changes nothing: NFC has nothing to compose in Latin-1."""
        if (text.isascii() or is_latin(text)) and not any(m in text for m in self.marks):
            text = text.lower()
        return _UNIT.findall(text) if any(x in text for x in _SEPARATORS) else text.split()

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.split(text) for i in self._unit(unit)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)

    def known(self, unit: str) -> tuple[int, str, str]:
        """Of a unit: how many ids, the ids in decimal, and the tokens, each joined by a space."""
        if len(self.units) >= MAX_UNITS:
            self.units.clear()
        ids = self._unit(unit)
        out = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        if len(unit) < 64:
            self.units[unit] = out
        return out


def codec(path: str) -> ForcedBoundaryBPE:
    """This process's codec: tasks that run in the same Python worker share what it has met."""
    return common.resident(f"codec {path}", lambda: ForcedBoundaryBPE(path))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array([codec(tokenizer).encode(t) for t in common.text_list(part)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([common.ids_of(part), ids], ["doc_id", "ids"])

    return common.map_slices(common.texts_only(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows that ``encode`` made."""
    def run(batches):
        for batch in batches:
            texts = pa.array([codec(tokenizer).decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return common.map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text, keeping only digests: no ids leave the worker."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(tokenizer)
        get, known = bpe.units.get, bpe.known
        counts, ids, texts = [], [], []
        for text in common.text_list(part):
            units = [get(u) or known(u) for u in bpe.split(text)]
            counts.append(sum([u[0] for u in units]))
            ids.append(hashlib.sha256(" ".join([u[1] for u in units if u[0]]).encode()).hexdigest())
            texts.append(hashlib.sha256(" ".join([u[2] for u in units if u[0]]).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([common.ids_of(part), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_slices(common.texts_only(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
