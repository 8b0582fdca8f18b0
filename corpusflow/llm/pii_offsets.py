"""Operator 5: personal data, also in disguise, with spans in the source text.

Transducers rewrite a text into a plainer one and carry along, for each character they
emit, the source span it came from: homoglyphs (full-width forms, foreign digits, Greek
and Cyrillic look-alikes, odd spaces and dashes, invisible characters), at/dot disguises
(``name [at] host (dot) org``, ``name[@]host[.]org``, ``name at host dot org``), dot
disguises between digits (``192 dot 168 dot 1 dot 10``) and spelled digits, in runs or
beside plain ones. The detectors run on the source and on the rewritten text, in each of
its readings; a find there that holds something rewritten and isn't
inside a plain find is mapped back to its source span. So a disguised find may hold plain ones, or reach beyond
one; but a single spelled digit beside a plain find is a word like any other.

Plain finds ("base") are never changed by the method. Of disguised finds of a kind where one holds another the longer counts. Very long
texts take about fifty times their size while they are rewritten, and time in proportion to it. Other columns, whatever their names, are not looked at. Null and empty texts have none. Repeated rows and
rows without an id come back row by row; an empty table makes no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusflow.llm import common

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")

#: (start, end, kind's place in KINDS); code points, end exclusive.
Span = tuple[int, int, int]

# Spelled digits of the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled digits count from this many in a row, neighbouring plain digits included.
LEAST_DIGIT_WORDS = 4

# Look-alikes of Latin letters, first Cyrillic and then Greek; odd dashes, spaces, signs; what is not seen.
LOOK_ALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝ", "ABEKMHOPCTYXaeopcyxijsdqw", strict=True)) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABEZHIKMNOPTYXaiknopux", strict=True))
SIGNS = dict.fromkeys("‐‑‒–—−﹣－", "-") | dict.fromkeys("\xa0     　", " ") | {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "﹢": "+", "（": "(", "）": ")", "＿": "_", "％": "%"}
UNSEEN = dict.fromkeys("\xad​‌‍⁠﻿", "")


def _glyphs() -> dict[str, str]:
    """All single characters that are rewritten: what is listed, full-width letters, and any script's decimal digits."""
    wide = {chr(0xFEE0 + c): chr(c) for c in range(0x30, 0x7B) if chr(c).isalnum()}
    digits = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"}
    return digits | wide | LOOK_ALIKES | SIGNS | UNSEEN


GLYPHS = _glyphs()
_GLYPH = re.compile("[" + "".join(map(re.escape, sorted(GLYPHS))) + "]")

_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_AT_BOX, _DOT_BOX = _OPEN + r"(?:at|arroba|arobase|@)" + _CLOSE, _OPEN + r"(?:dot|punkt|punto|point|\.)" + _CLOSE
_DOT_BARE = r"[ \t]+dot[ \t]+"
#: An address one of whose signs is a disguise: a bare "at" needs a disguised dot after it.
_ADDRESS = re.compile(
    rf"(?P<local>[A-Za-z0-9._%+-]+(?:(?:{_DOT_BOX}|{_DOT_BARE})[A-Za-z0-9._%+-]+)*)"
    rf"(?:(?P<box>{_AT_BOX})|(?P<bare>[ \t]+at[ \t]+)|[ \t]*@[ \t]*)"
    rf"(?P<host>[A-Za-z0-9-]+(?:(?:{_DOT_BOX}|{_DOT_BARE}|\.)[A-Za-z0-9-]+)+)",
    re.IGNORECASE,
)
_BOXED_OR_DOT = re.compile(r"[\[({<][ \t]*(?:at|arroba|arobase|@|dot|punkt|punto|point|\.)[ \t]*[\])}>]|[ \t]dot[ \t]", re.IGNORECASE)
_DOT_WORDS = ("dot", "punkt", "punto", "point", ".")
_AT_SIGN = re.compile(_AT_BOX + r"|[ \t]+at[ \t]+|[ \t]*@[ \t]*", re.IGNORECASE)
_DOT_SIGN = re.compile(_DOT_BOX + "|" + _DOT_BARE, re.IGNORECASE)

_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,-]{{1,2}})?{_WORD}(?:(?:[ ,-]{{1,2}}|[ ]?\.[ ]?|[ ](?:dot|point|punto|punkt)[ ]){_WORD}){{{LEAST_DIGIT_WORDS - 1},}}(?!\w)", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?<!\w)(?:(?P<plus>plus[ ,-]{{1,2}})|(?P<digit>{_WORD})(?!\w))|(?P<dot>[ ]?\.[ ]?|[ ](?:dot|point|punto|punkt)[ ])|(?P<gap>[ ,-]+)", re.IGNORECASE)

#: A sign between digit groups, as a word or in a box.
_DIGIT_DOT = re.compile(rf"(?<=[0-9])(?:{_DOT_BOX}|[ \t]+(?:dot|point|punto|punkt)[ \t]+)(?=[0-9])", re.IGNORECASE)
_DOT_PART = rf"{_DOT_BOX}|[ \t]+(?:dot|point|punto|punkt)[ \t]+|[ ]?\.[ ]?"
#: Two or more of digit words and digit groups in a row.
_MIXED = re.compile(rf"(?<!\w)(?:plus[ ,-]{{1,2}})?(?:{_WORD}|[0-9]++)(?:(?:{_DOT_PART}|[ ,-]{{1,2}})(?:{_WORD}|[0-9]++))+(?!\w)", re.IGNORECASE)
#: Without this there is nothing in such a row that a run of digit words doesn't have.
_BESIDE = re.compile(rf"[0-9](?:{_DOT_PART}|[ ,-]{{1,2}}){_WORD}(?!\w)|(?<!\w){_WORD}(?:(?:{_DOT_PART}|[ ,-]{{1,2}})[0-9]|{_DOT_BOX}{_WORD}(?!\w))", re.IGNORECASE)
_MIXED_PART = re.compile(rf"(?P<plus>plus[ ,-]{{1,2}})|(?P<digit>{_WORD})(?!\w)|(?P<plain>[0-9]+)|(?P<dot>{_DOT_PART})|(?P<gap>[ ,-]+)", re.IGNORECASE)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of the address pattern, found from their @ signs: a match's local part is all that may stand before it."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end(), 0))
            free = host.end()
        at = text.find("@", at + 1)
    return out


def detect(text: str) -> list[Span]:
    """Plain finds, by start and then kind; matches that fail their check are dropped without a retry."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


class Rewrite:
    """A text under rewriting; each character has its source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Non-overlapping (start, end, text) in ascending order; what is emitted stands for the whole stretch."""
        if not edits:
            return
        text: list[str] = []
        start: list[int] = []
        end: list[int] = []
        new = bytearray()
        at = 0
        for a, b, put in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            if put:
                text.append(put)
                start += [self.start[a]] * len(put)
                end += [self.end[b - 1]] * len(put)
                new += b"\1" * len(put)
            elif b > a and new:
                new[-1] = 1  # what is taken away marks the character before
            at = b
        self.text, self.start, self.end, self.new = "".join(text), start, end, new


def _homoglyphs(r: Rewrite) -> None:
    r.replace([(m.start(), m.end(), GLYPHS[m[0]]) for m in _GLYPH.finditer(r.text)])


def _addresses(r: Rewrite) -> None:
    edits = []
    at = 0
    while m := _next_address(r.text, at):
        at = m.end()
        if m["bare"] and not _DOT_SIGN.search(m["host"]):
            continue
        edits += [(m.start("local") + d.start(), m.start("local") + d.end(), ".") for d in _DOT_SIGN.finditer(m["local"])]
        edits.append((m.end("local"), m.start("host"), "@")) if r.text[m.end("local") : m.start("host")] != "@" else None
        edits += [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in _DOT_SIGN.finditer(m["host"])]
    r.replace(edits)


def _dot_before(text: str, low: int, end: int) -> int:
    """Where a dot sign that ends at end, spaces around it included, begins; -1 without one. Nothing before low is looked at."""
    i = end
    while i > low and text[i - 1] in " \t":
        i -= 1
    if i > low and text[i - 1] in "])}>":
        j = i - 1
        while j > low and text[j - 1] in " \t":
            j -= 1
        word = next((w for w in _DOT_WORDS if j - len(w) >= low and text[j - len(w) : j].lower() == w), None)
        if word is None:
            return -1
        j -= len(word)
        while j > low and text[j - 1] in " \t":
            j -= 1
        if j <= low or text[j - 1] not in "[({<":
            return -1
        j -= 1
    else:
        j = i - 3
        if i == end or j <= low or text[j:i].lower() != "dot" or text[j - 1] not in " \t":
            return -1
    while j > low and text[j - 1] in " \t":
        j -= 1
    return j


def _next_address(text: str, at: int) -> re.Match | None:
    """The next disguised address; looked for around at signs only, so that long words cost nothing.

    Its local part begins as far back as words and dot signs take turns, or else with the word beside the at sign.
    """
    far: dict[int, int] = {}  # of words that dot signs join, where the first begins
    for sign in _AT_SIGN.finditer(text, at):
        free = sign.start()
        near = start = None
        joined = []
        while True:
            begin = free
            while begin > at and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin == free:
                break
            near = begin if near is None else near
            if begin in far:
                start = far[begin]
                break
            start = begin
            joined.append(begin)
            free = _dot_before(text, at, begin)
            if free <= at:
                break
        far |= dict.fromkeys(joined, start)
        for begin in dict.fromkeys((start, near)):
            if begin is not None and (m := _ADDRESS.match(text, begin)) and m.end("local") == sign.start():
                return m
    return None


def _spelled_digits(r: Rewrite) -> None:
    edits = []
    for run in _SPELLED.finditer(r.text):
        for part in _SPELLED_PART.finditer(r.text, run.start(), run.end()):
            put = "+" if part["plus"] else "." if part["dot"] else DIGIT_WORDS[part["digit"].lower()] if part["digit"] else ""
            edits.append((part.start(), part.end(), put))
    r.replace(edits)


def _mixed_digits(joins: bool) -> Callable[[Rewrite], None]:
    """Digit words beside each other or digit groups; joins: a gap between a word and a group goes, too."""

    def transduce(r: Rewrite) -> None:
        edits = []
        for run in _MIXED.finditer(r.text):
            parts = list(_MIXED_PART.finditer(r.text, run.start(), run.end()))
            if not any(p["digit"] for p in parts) or sum(1 if p["digit"] else len(p["plain"] or "") for p in parts) < LEAST_DIGIT_WORDS:
                continue
            for i, part in enumerate(parts):
                if part["gap"]:
                    words = sum(bool(p["digit"]) for p in (parts[i - 1], parts[i + 1]))
                    if words == 2 or (words and joins):
                        edits.append((part.start(), part.end(), ""))
                elif not part["plain"] and part[0] != ".":
                    edits.append((part.start(), part.end(), "+" if part["plus"] else "." if part["dot"] else DIGIT_WORDS[part["digit"].lower()]))
        r.replace(edits)

    return transduce


def _digit_dots(r: Rewrite) -> None:
    r.replace([(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(r.text)])


def _has_glyph(text: str) -> bool:
    """As ``_GLYPH.search``; texts in Latin-1 can hold two of the glyphs only."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_GLYPH.search(text))
    return "\xa0" in text or "\xad" in text


#: A transducer, and the test without which it changes nothing.
Steps = tuple[tuple[Callable[[str], object], Callable[[Rewrite], None]], ...]
TRANSDUCERS: Steps = ((_has_glyph, _homoglyphs), (_SPELLED.search, _spelled_digits), (_BOXED_OR_DOT.search, _addresses))
#: Other readings of digits. As each can hide what another shows ("5 one nine two dot ..." is 5 and 192, "1 nine 2 dot ..." is 192), all are tried.
READINGS: tuple[Steps, ...] = tuple(((_has_glyph, _homoglyphs), (_BESIDE.search, _mixed_digits(joins)), (_DIGIT_DOT.search, _digit_dots), (_BOXED_OR_DOT.search, _addresses)) for joins in (False, True))


def _rewritten(text: str, steps: Steps) -> Rewrite | None:
    r = None
    for needs, transduce in steps:
        if needs(r.text if r else text):
            r = r or Rewrite(text)
            transduce(r)
    return r


class Cover:
    """Spans, to be asked for by place: how far those reach that begin before one is found by bisection."""

    def __init__(self, spans: list[Span]):
        self.starts = [s[0] for s in spans]
        self.reach = list(accumulate((s[1] for s in spans), max))

    def _reach(self, begun: int) -> int:
        return self.reach[begun - 1] if begun else -1

    def meets(self, a: int, b: int) -> bool:
        return self._reach(bisect_left(self.starts, b)) > a

    def holds(self, a: int, b: int) -> bool:
        return self._reach(bisect_right(self.starts, a)) >= b


def _says_more(r: Rewrite, a: int, b: int, plainly: Cover) -> bool:
    """Whether what a find has beyond plain ones is more than one spelled digit."""
    words = 0
    for i in range(a, b):
        if r.new[i] and not plainly.holds(r.start[i], r.end[i]):
            words += 1
            if words > 1 or r.end[i] - r.start[i] == 1 or not r.text[i].isdigit():
                return True
    return False


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain finds, finds in disguise); of two readings of one stretch as the same kind, the longer."""
    base = detect(text)
    first = _rewritten(text, TRANSDUCERS)
    plain = _rewritten(text, TRANSDUCERS[:1]) if _has_glyph(text) else None
    digits = plain.text if plain else text
    readings = [first]
    if _DIGIT_DOT.search(digits) or _BESIDE.search(digits):
        readings += [_rewritten(text, steps) for steps in READINGS]
    added = set()
    plainly = Cover(base)
    for r in readings:
        for a, b, kind in detect(r.text) if r else ():
            if 1 in r.new[a:b]:
                span = (r.start[a], r.end[b - 1], kind)
                if not plainly.meets(*span[:2]) or (not plainly.holds(*span[:2]) and _says_more(r, a, b, plainly)):
                    added.add(span)
    longest, reach = [], [0] * len(KINDS)
    for a, b, kind in sorted(added, key=lambda s: (s[0], -s[1])):
        if b > reach[kind]:
            longest.append((a, b, kind))
            reach[kind] = b
    return base, sorted(longest, key=lambda s: (s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def redact(text: str) -> str:
    """The text with each find replaced by its kind in brackets; overlapping finds become one."""
    base, added = find(text)
    spans = sorted([*base, *added], key=lambda s: (s[0], s[2]))
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: how many plain finds of each kind, their digest, all spans, and how many were in disguise."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], [], []]
        digest, every, hidden = [], [], []
        for text in common.text_list(part):
            base, added = find(text)
            for k in range(4):
                counts[k].append(sum(s[2] == k for s in base))
            digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(sorted([*base, *added], key=lambda s: (s[0], s[2]))))
            hidden.append(len(added))
        return pa.RecordBatch.from_arrays([common.ids_of(part), *[pa.array(x, pa.int64()) for x in counts], pa.array(digest), pa.array(every), pa.array(hidden, pa.int64())], [f.split()[0] for f in schema.split(", ")])

    return common.map_slices(common.texts_only(docs, id_col, text_col), run, schema)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text with all finds replaced."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([common.ids_of(part), pa.array([redact(t) for t in common.text_list(part)], pa.string())], ["doc_id", "text"])

    return common.map_slices(common.texts_only(docs, id_col, text_col), run, "doc_id long, text string")
