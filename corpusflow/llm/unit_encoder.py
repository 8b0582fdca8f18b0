"""Encode many texts with a tokenizers file, each distinct unit once.

A text is cut where the tokenizer's pre-tokenizer cuts in any case (before white space
that follows something else), so its units can be encoded one by one and their ids joined.
Units recur, so each worker keeps a bounded table of those it has met and hands the
library new ones only.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

#: The code points with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Units that one worker remembers before it starts afresh.
MAX_UNITS = 1_500_000

_UNIT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to Python, not to Unicode


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def vocabulary_size(path: str) -> int:
    """The vocabulary's size, added tokens included."""
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class _Numbers(dict):
    """Gives each new key the next number, and lists the new ones."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class UnitEncoder:
    """keeps_space: white space is part of tokens (byte-level); else it only separates words."""

    def __init__(self, path: str, keeps_space: bool):
        self.tok = _tokenizer(path)
        self.keeps_space = keeps_space
        spec = json.loads(self.tok.to_str())
        self.lowers = "Lowercase" in str(spec["normalizer"])
        self.marks = tuple({t["content"][:2] for t in spec["added_tokens"]})  # special tokens are found before lower-casing
        self._reset()

    def _reset(self) -> None:
        self.index = _Numbers()
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def units(self, text: str) -> list:
        """Where space is kept, a bare string stands for itself after a space, and a 1-tuple for itself."""
        odd = any(x in text for x in _SEPARATORS)
        if self.lowers and not any(m in text for m in self.marks) and (text.isascii() or is_latin(text)):
            text = text.lower()  # as the tokenizer will; here NFC has nothing to compose, and no special token can arise
        if self.keeps_space:
            if text and not odd and sum(map(text.count, WHITE_SPACE)) == len(text.split()) - 1:
                first, *rest = text.split(" ")  # single white space everywhere: what follows a space is a unit with it
                return [(first,), *rest]
            return [(x,) for x in _UNIT.findall(text)]
        return _UNIT.findall(text) if odd else text.split()

    def _learn(self) -> None:
        """Encode the units met for the first time; they got their numbers in the order of ``index.new``."""
        new, self.index.new = self.index.new, []
        plain = [x[0] if type(x) is tuple else " " + x for x in new] if self.keeps_space else new
        enc = self.tok.encode(plain, is_pretokenized=True, add_special_tokens=False)
        ids, word = np.array(enc.ids, np.uint32), np.array(enc.word_ids, np.int64)
        count = np.bincount(word, minlength=len(new)) if len(word) else np.zeros(len(new), np.int64)
        first = len(self.index) - len(new)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.index) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[first : first + len(new)] = count
        self.begin[first : first + len(new)] = self.used + np.cumsum(count) - count
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        if len(self.index) > MAX_UNITS:
            self._reset()
        per_text = list(map(self.units, texts))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(per_text)), np.int64)
        if self.index.new:
            self._learn()
        lengths = np.array([len(x) for x in per_text], np.int64)
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.begin[at] - (ends - size), size) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        return self.flat[take], np.diff(bounds)


class ByteLevelEncoder:
    """A byte-level file whose ids are in the order of its merges, for which tiktoken gives the same ids sooner.

    Only texts of Latin letters go that way, on which the two libraries' Unicode tables agree; others are cut into units.
    """

    _FAR = re.compile("[^\x00-\u024f\u2010-\u2027]")
    #: Fixed value: the pattern of byte-level pre-tokenizers with their own regular expression.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        self.units = UnitEncoder(path, True)
        spec = json.loads(self.units.tok.to_str())
        self.fast = self._tiktoken(spec) if self._plain(spec) else None

    @staticmethod
    def _plain(spec: dict) -> bool:
        pre, vocab = spec["pre_tokenizer"], spec["model"]["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        return spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and merged == list(range(256, 256 + len(merged)))

    def _tiktoken(self, spec: dict):
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        return tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        if self.fast is None:
            return self.units.encode(texts)
        parts: list[np.ndarray] = []
        for t in texts:
            if t.isascii() or not self._FAR.search(t):
                parts.append(self.fast.encode_to_numpy(t, allowed_special="all"))
            else:
                parts.append(self.units.encode([t])[0])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.array([len(p) for p in parts], np.int64)


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def encoder(path: str, keeps_space: bool) -> UnitEncoder | ByteLevelEncoder:
    return ByteLevelEncoder(path) if keeps_space else UnitEncoder(path, False)
