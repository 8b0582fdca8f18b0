"""Markdown into chunks for retrieval, and headings into anchors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a chunk at most, and below which it joins a neighbour; characters in a token.
MOST, LEAST, CHARS = 800, 100, 4
#: Pages whose pieces are made at once.
ROWS = 128

_PAGE = re.compile(r"<!--\s*kb:page\s*(\d+)\s*-->")
_REGION = re.compile(r"<!-- kb:begin id=(.*?) -->(.*?)<!-- kb:end id=\1 -->", re.S)


def _sections(body: str, level: int) -> list[tuple[str | None, str]]:
    """(heading, body) at exactly that level of headings, fences aside; an empty start is left out."""
    mark = re.compile(rf"\s*{'#' * level}(?!#)[ \t](.*)")
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    fenced = False
    for line in body.splitlines():
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        found = None if fenced else mark.fullmatch(line)
        if found:
            out.append((found[1].strip().rstrip("#").strip(), []))
        else:
            out[-1][1].append(line)
    if out[0][0] is None and not "".join(out[0][1]).strip() and len(out) > 1:
        out.pop(0)
    return [(h, "\n".join(x)) for h, x in out]


def _paragraphs(body: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n(?:[ \t]*\n)+", body) if p.strip()]


def _tokens(body: str) -> int:
    return len(body) // CHARS


def _pieces(body: str) -> list[tuple[str | None, str]]:
    """By second-level headings; what is too long by third-level ones, and then by paragraphs."""
    out: list[tuple[str | None, str]] = []
    for heading, text in _sections(body, 2):
        if _tokens(text.strip()) <= MOST:
            out.append((heading, text.strip()))
            continue
        below = _sections(text, 3)
        for sub, part in below if any(h is not None for h, _ in below) else [(None, text)]:
            label = heading if sub is None else sub
            out += [(label, part.strip())] if _tokens(part.strip()) <= MOST else [(label, p) for p in _paragraphs(part)]
    return [(h, t) for h, t in out if t]


def _span(a: tuple | None, b: tuple | None) -> tuple | None:
    return (min(a[0], b[0]), max(a[1], b[1])) if a and b else a or b


def _join(a: str, b: str) -> str:
    return "\n\n".join(x for x in (a, b) if x)


def chunk(body: str) -> list[tuple[str | None, str, int | None, int | None]]:
    """(heading, body, first page, last page) of each chunk, in order."""
    clean = _REGION.sub(lambda m: m[2], body)
    pages: list[tuple[tuple | None, list[str]]] = [(None, [])]
    for line in clean.splitlines():
        if m := _PAGE.fullmatch(line.strip()):
            pages.append(((int(m[1]), int(m[1])), []))
        else:
            pages[-1][1].append(line)
    found = [[h, t, span] for span, lines in pages for h, t in _pieces("\n".join(lines))]
    out: list[list] = []
    for c in found:
        if out and _tokens(c[1]) < LEAST:
            out[-1][1:] = [_join(out[-1][1], c[1]), _span(out[-1][2], c[2])]
        else:
            out.append(c)
    while len(out) >= 2 and _tokens(out[0][1]) < LEAST:
        head = out.pop(0)
        out[0][1:] = [_join(head[1], out[0][1]), _span(head[2], out[0][2])]
    return [(h, t, *(span or (None, None))) for h, t, span in out]


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of few rows, so that a task holds the objects of few pages at once, whatever a batch has."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def chunks(pages: DataFrame, id_col: str = "item_id", body_col: str = "body") -> DataFrame:
    """item_id, chunk_idx, heading, body, tokens, first_page, last_page. A fold over lines, document by document."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["item_id", "chunk_idx", "heading", "body", "tokens", "first_page", "last_page"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(i, n, h, t, _tokens(t), a, b) for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, (h, t, a, b) in enumerate(chunk(body or ""))]
            types = [batch.column(0).type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return pages.select(id_col, body_col).mapInArrow(run, f"item_id {kind}, chunk_idx int, heading string, body string, tokens int, first_page int, last_page int")


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HEADING = re.compile(r"(#{1,6})[ \t]+(\S.*)")
_OWN = re.compile(r"\{#([A-Za-z0-9_-]+)\}\s*$")


def _slug(title: str) -> str:
    return re.sub(r"[\W_]+", "-", title).strip("-").translate(_ASCII_LOWER)


def _headings(body: str) -> Iterator[tuple[int, int, str]]:
    """(line, level, rest of the line) of the headings outside fences."""
    fenced = False
    for n, line in enumerate(re.split(r"\r?\n", body)):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := _HEADING.fullmatch(line)):
            yield n, len(m[1]), m[2]


def anchors(body: str, most_level: int = 3) -> list[tuple[int, str]]:
    """(line, anchor) of headings; an anchor of their own in braces counts, and one that returns gets -2, -3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for line, level, rest in _headings(body):
        if level <= most_level:
            own = _OWN.search(rest)
            name = own[1] if own else _slug(re.sub(r"\s*(?:\{#[^}]*\}\s*)?#*\s*$", "", rest))
            seen[name] = seen.get(name, 0) + 1
            out.append((line, name if seen[name] == 1 else f"{name}-{seen[name]}"))
    return out


def transcript_anchors(body: str) -> list[str]:
    """Anchors of a transcript's headings up to the third level, but for those of turns (@...) and the list of speakers."""
    seen: dict[str, int] = {}
    out, fenced = [], False
    for line in body.splitlines():
        line = line.lstrip()
        if line.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := re.fullmatch(r"(#{1,3})(?!#)\s(.*)", line)):
            title = m[2].strip().rstrip("#").strip()
            name = _slug(title)
            if not name or (len(m[1]) == 2 and (title.startswith("@") or title == "Speakers")):
                continue
            seen[name.lower()] = n = seen.get(name.lower(), 0) + 1
            out.append(name if n == 1 else f"{name}-{n}")
    return out


def transcript_headings(pages: DataFrame, id_col: str = "page_id", body_col: str = "body") -> DataFrame:
    """page_id, place, anchor of a transcript's own headings."""
    return _each(pages, id_col, body_col, lambda body: list(enumerate(transcript_anchors(body))), "place int, anchor string", [pa.int32(), pa.string()])


def cut(body: str) -> list[tuple[str, str]]:
    """(anchor, body) from each heading to the next."""
    lines = re.split(r"\r?\n", body)
    at = [(n, rest) for n, _, rest in _headings(body)]
    ends = [n for n, _ in at[1:]] + [len(lines)]
    return [(_slug(rest), "\n".join(lines[n + 1 : end])) for (n, rest), end in zip(at, ends, strict=True)]


def _each(pages: DataFrame, id_col: str, body_col: str, fold, schema: str, types: list[pa.DataType]) -> DataFrame:
    """A fold of each page's text into rows behind its id, page by page: nothing is shuffled."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["page_id", *[f.split()[0] for f in schema.split(", ")]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(i, *r) for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in fold(body or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([batch.column(0).type, *types])], names)

    return pages.select(id_col, body_col).mapInArrow(run, f"page_id {kind}, {schema}")


def heading_anchors(pages: DataFrame, id_col: str = "page_id", body_col: str = "body", most_level: int = 3) -> DataFrame:
    """page_id, line, anchor of headings outside fences."""
    return _each(pages, id_col, body_col, lambda body: anchors(body, most_level), "line int, anchor string", [pa.int32(), pa.string()])


def anchor_index(anchors: DataFrame) -> DataFrame:
    """anchor and the different pages that have it, in order."""
    return anchors.groupBy("anchor").agg(F.array_sort(F.collect_set("page_id")).alias("pages"))


def sections(pages: DataFrame, id_col: str = "page_id", body_col: str = "body") -> DataFrame:
    """page_id, section, anchor, body from each heading to the next; what stands before the first heading is left out."""
    numbered = lambda body: [(n + 1, *part) for n, part in enumerate(cut(body))]
    return _each(pages, id_col, body_col, numbered, "section int, anchor string, body string", [pa.int32(), pa.string(), pa.string()])
