"""Checks of a knowledge base: quotations, links, sources, revisions, artifacts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import matching

#: Fixed value: edits allowed in each whole hundred characters of a quotation.
FUZZ = 2


def quote_citations(pages: DataFrame) -> DataFrame:
    """page_id, quote, source_id, anchor, first_page, last_page of quotations before or after a citation; of equal ones one."""
    body = T.fold_quotes(F.col("body"))
    note = r"(?:#([A-Za-z0-9][A-Za-z0-9_-]*))?(?:\s+(pp?\.[0-9]+(?:-[0-9]+)?))?"
    source, quote = r"(src-[A-Za-z0-9][A-Za-z0-9_-]*)", r'"([^"\r\n]+)"'
    shapes = [(rf"{quote}\s*\[{source}{note}\]", 1, 2, 3, 4), (rf"\[{source}{note}\]\s+{quote}", 4, 1, 2, 3), (rf"{quote}\s*\({source}\)", 1, 2, None, None)]
    found = []
    for pattern, q, s, a, p in shapes:
        part = lambda group: F.regexp_extract_all(body, F.lit(pattern), group) if group else None  # noqa: B023, E731
        columns = [F.col("page_id"), part(q).alias("q"), part(s).alias("s"), (part(a) if a else F.transform(part(q), lambda x: F.lit(""))).alias("a"), (part(p) if p else F.transform(part(q), lambda x: F.lit(""))).alias("p")]
        found.append(pages.select(*columns).select("page_id", F.explode(F.arrays_zip("q", "s", "a", "p")).alias("z")).select("page_id", "z.*"))
    every = found[0].unionByName(found[1]).unionByName(found[2])
    first = F.regexp_extract("p", r"^pp?\.([0-9]+)", 1)
    last = F.when(F.col("p").startswith("pp."), F.regexp_extract("p", "-([0-9]+)$", 1)).otherwise(first)
    number = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    fine = number(last) >= number(first)
    return every.select("page_id", F.col("q").alias("quote"), F.col("s").alias("source_id"), F.nullif("a", F.lit("")).alias("anchor"), F.when(fine, number(first)).alias("first_page"), F.when(fine, number(last)).alias("last_page")).distinct()


def quote_in(quote: Column, source: Column) -> Column:
    """Whether the quotation stands in the source, quotation marks, emphasis, case and spacing aside."""
    return F.contains(T.match_form(source), T.match_form(quote))


def find_quotes(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quote_id, source_id of every source that holds a quotation, in their forms for comparing. quotes: quote_id, quote; sources: source_id, text."""
    patterns = quotes.select(F.col("quote_id").alias("pattern_id"), T.match_form(F.col("quote")).alias("pattern"))
    texts = sources.select(F.col("source_id").alias("text_id"), T.match_form(F.col("text")).alias("text"))
    return matching.contained(patterns, texts).select(F.col("pattern_id").alias("quote_id"), F.col("text_id").alias("source_id"))


def _starts(quote: str, source: str, budget: int) -> list[int]:
    """Where a window within the budget may begin: of budget + 1 parts of the quotation at least one stands there unchanged, moved by the budget at most."""
    cuts = [len(quote) * i // (budget + 1) for i in range(budget + 2)]
    found: set[int] = set()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = source.find(quote[a:b])
        while at >= 0:
            found.update(range(max(0, at - a - budget), at - a + budget + 1))
            at = source.find(quote[a:b], at + 1)
    return sorted(x for x in found if x < len(source))


def within(quote: str, source: str, budget: int) -> int | None:
    """Edits between a quotation and the first window of a source, from the left and then by length, that is within the budget."""
    q, n = len(quote), len(source)
    for start in _starts(quote, source, budget) if q > budget else range(n):
        row = list(range(min(q + budget, n - start) + 1))  # distances of the empty prefix to windows of each length
        for i in range(1, q + 1):
            low, high = max(1, i - budget), min(len(row) - 1, i + budget)
            new = [budget + 1] * len(row)
            if i <= budget:
                new[0] = i
            for j in range(low, high + 1):
                new[j] = min(row[j - 1] + (quote[i - 1] != source[start + j - 1]), row[j] + 1, new[j - 1] + 1)
            row = new
            if min(row[max(0, i - budget) : high + 1], default=budget + 1) > budget:
                break
        else:
            for length in range(max(0, q - budget), len(row)):
                if row[length] <= budget:
                    return row[length]
    return None


def verify_quotes(quotes: DataFrame, sources: DataFrame, fuzz: int = FUZZ) -> DataFrame:
    """quotes (page_id, quote, source_id) with status source_missing, exact, fuzzy or absent, and the edits of a fuzzy match.

    Sources are joined once; only quotations of a hundred characters and more that aren't found as they are go to Python.
    """
    held = sources.select("source_id", T.match_form(F.col("text")).alias("_text"), F.lit(True).alias("_there"))
    joined = quotes.join(held, "source_id", "left").withColumn("_quote", T.match_form(F.col("quote")))
    exact = F.contains("_text", "_quote")
    status = F.when(F.col("_there").isNull(), "source_missing").when(exact, "exact").when(F.length("_quote") < 100, "absent").otherwise("look")
    marked = joined.withColumn("status", status)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            edits = [within(r["_quote"], r["_text"], len(r["_quote"]) // 100 * fuzz) for r in rows]
            status = ["absent" if e is None else "fuzzy" for e in edits]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(status), pa.array(edits, pa.int32())], ["page_id", "quote", "source_id", "status", "edits"])

    plain = marked.where("status != 'look'").select("page_id", "quote", "source_id", "status", F.lit(None).cast("int").alias("edits"))
    kinds = {f.name: f.dataType.simpleString() for f in marked.schema}
    schema = f"page_id {kinds['page_id']}, quote string, source_id {kinds['source_id']}, status string, edits int"
    looked = marked.where("status = 'look'").select("page_id", "quote", "source_id", "_quote", "_text").mapInArrow(run, schema)
    return plain.unionByName(looked)


def missing_targets(links: DataFrame, pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """links: page_id, target, anchor (null: none). Those whose page or whose anchor on it isn't there, in a column ``kind``."""
    there = pages.select(F.col("page_id").alias("target"), F.lit(True).alias("_page"))
    anchored = anchors.select(F.col("page_id").alias("target"), "anchor", F.lit(True).alias("_anchor")).distinct()
    joined = links.join(there, "target", "left").join(anchored, ["target", "anchor"], "left")
    kind = F.when(F.col("_page").isNull(), "missing_page").when(F.col("anchor").isNotNull() & F.col("_anchor").isNull(), "missing_anchor")
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").select("page_id", "target", "anchor", "kind")


def stale_citations(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """page_id, source_id of citations whose source isn't known, each once."""
    return cited.join(sources.select("source_id"), "source_id", "left_anti").select("page_id", "source_id").distinct()


def orphan_sources(sources: DataFrame, used: DataFrame, exempt: list[str] = ()) -> DataFrame:
    """Sources that nothing cites or links to, but for those whose id fits an exempt pattern."""
    left = sources.select("source_id").join(used.select("source_id").distinct(), "source_id", "left_anti")
    for glob in exempt:
        left = left.where(~F.col("source_id").rlike(glob_pattern(glob)))
    return left


def glob_pattern(glob: str) -> str:
    """A publish or ignore glob as a regular expression: /** takes all below, /* one level."""
    import re

    if glob.endswith("/**"):
        return f"^{re.escape(glob[:-3])}/.*$"
    if glob.endswith("/*"):
        return f"^{re.escape(glob[:-2])}/[^/]+$"
    return f"^{re.escape(glob)}$"


def published(pages: DataFrame, globs: list[str]) -> DataFrame:
    """Pages whose id fits one of the globs; all, if there are none."""
    if not globs:
        return pages
    return pages.where(F.col("page_id").rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)))


def revision_state(pages: DataFrame, documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """page_id and state of pages (page_id, doc_id, revision_id): orphan (no such document), revision_missing (it has none that is live), stale (others are live), current."""
    doc = documents.select("doc_id", F.lit(True).alias("_doc"))
    live = revisions.groupBy("doc_id").agg(F.collect_set("revision_id").alias("_live"))
    joined = pages.join(doc, "doc_id", "left").join(live, "doc_id", "left")
    state = F.when(F.col("_doc").isNull(), "orphan").when(F.col("_live").isNull(), "revision_missing").when(~F.array_contains("_live", F.col("revision_id")), "stale").otherwise("current")
    return joined.groupBy("page_id").agg(F.max(F.struct(F.when(state == "current", 3).when(state == "stale", 2).when(state == "revision_missing", 1).otherwise(0).alias("o"), state.alias("state"))).alias("m")).select("page_id", "m.state")


def artifact_state(manifest: DataFrame, records: DataFrame, outputs: DataFrame) -> DataFrame:
    """manifest: path, record_id, fingerprint. State: output_missing, record_missing, fingerprint_mismatch or fine."""
    r = records.select("record_id", F.col("fingerprint").alias("_fp"), F.lit(True).alias("_record"))
    o = outputs.select("path", F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "output_missing").when(F.col("_record").isNull(), "record_missing").when(~F.col("fingerprint").eqNullSafe(F.col("_fp")), "fingerprint_mismatch").otherwise("fine")
    return manifest.join(o, "path", "left").join(r, "record_id", "left").select("path", state.alias("state"))


def artifact_issues(manifest: DataFrame, records: DataFrame, outputs: DataFrame) -> DataFrame:
    """path, record_id, kind of all that is wrong: output_missing, record_missing and fingerprint_mismatch of the manifest's entries, record_output_missing of records none of whose outputs is there.

    manifest: path, record_id, fingerprint; records: record_id, fingerprint, output_paths; outputs: path.
    """
    there = outputs.select("path", F.lit(True).alias("_there"))
    known = records.select("record_id", F.col("fingerprint").alias("_fp"), F.lit(True).alias("_record"))
    at = manifest.join(there, "path", "left").join(known, "record_id", "left")
    wrong = F.array_compact(F.array(F.when(F.col("_there").isNull(), "output_missing"), F.when(F.col("_record").isNull(), "record_missing").when(~F.col("fingerprint").eqNullSafe(F.col("_fp")), "fingerprint_mismatch")))
    listed = at.select("path", "record_id", F.explode(wrong).alias("kind"))
    made = records.where(F.size("output_paths") > 0).select("record_id", F.col("output_paths")[0].alias("_first"), F.explode("output_paths").alias("path"))
    gone = made.join(there, "path", "left").groupBy("record_id", "_first").agg(F.count("_there").alias("n")).where("n = 0")
    return listed.unionByName(gone.select(F.col("_first").alias("path"), "record_id", F.lit("record_output_missing").alias("kind")))


def thin(concepts: DataFrame, least: int = 12) -> DataFrame:
    """Concepts (page_id, body) of fewer than ``least`` words, once regions and the title are gone."""
    body = F.regexp_replace(F.regexp_replace(F.col("body"), r"(?s)<!-- kb:begin id=(.*?) -->.*?<!-- kb:end id=\1 -->", " "), r"(?m)^# .*$", " ")
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    return concepts.select("page_id", words.alias("words")).where(F.col("words") < least)


def captions_due(pages: DataFrame) -> DataFrame:
    """page_id, target of local images whose text says nothing: empty, generic, or the file's own name."""
    images = pages.select("page_id", F.explode(T.image_references(F.col("body"))).alias("i")).select("page_id", "i.alt", "i.target")
    stem = F.regexp_extract("target", r"([^/]*?)(?:\.[^./]*)?$", 1)
    generic = F.lower(F.trim("alt")).isin("", "image", "img", "picture", "photo", "figure", "screenshot")
    return images.where(~F.col("target").rlike("^(?:data:|https?://)") & (generic | (F.lower("alt") == F.lower(stem)))).select("page_id", "target").distinct()
