"""Pages of a wiki as data: the index built from them, backlinks, lints, identities, merges, jobs and sessions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.functions.readable import answer_json
from corpusflow.operators import mining, names, state, verify
from corpusflow.sources import cells

#: Pages that only list others.
INDEX_PAGES = ("wiki/index.md", "wiki/concepts/index.md", "wiki/sources/index.md", "wiki/questions/index.md")
#: What a session may be called.
SESSION_ID = r"^[A-Za-z0-9_-]{1,64}$"
#: Rows of a side, counted just before, that go to every task.
BROADCAST_ROWS = 1 << 19


def _kind(page_id: Column) -> Column:
    return F.when(page_id.startswith("wiki/sources/"), "source").when(page_id.startswith("wiki/concepts/"), "concept").when(page_id.startswith("wiki/questions/"), "question").otherwise("other")


def index_entries(pages: DataFrame) -> DataFrame:
    """item_id, title, aliases, headings, summary of source and concept pages (page_id, body).

    Of sources the summary region and the captions are text; concepts have their name, aliases and no text.
    """
    body = F.regexp_replace("body", r"\A---\r?\n(?s:.*?)\r?\n---(?:\r?\n|\z)", "")
    named = F.regexp_extract_all("body", F.lit(r"(?s)<!-- kb:begin id=(caption-[^ ]*) -->(.*?)<!-- kb:end id=\1 -->"), 2)
    captions = F.filter(F.transform(named, lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), lambda c: c != "")
    own = F.regexp_replace(T.region(F.col("body"), "summary"), r"^\s+|\s+$", "")
    summary = F.array_join(F.concat(F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")), captions), "\n\n")
    source = F.col("kind") == "source"
    rows = pages.withColumn("kind", _kind(F.col("page_id"))).where(F.col("kind").isin("source", "concept") & ~F.col("page_id").isin(*INDEX_PAGES))
    title = F.when(source, T.frontmatter_value(F.col("body"), "title")).otherwise(T.frontmatter_value(F.col("body"), "name"))
    aliases = F.when(source, F.array().cast("array<string>")).otherwise(T.frontmatter_list(F.col("body"), "aliases"))
    return rows.select(F.col("page_id").alias("item_id"), F.coalesce(title, F.lit("")).alias("title"), aliases.alias("aliases"), T.heading_lines(body).alias("headings"), F.when(source, summary).otherwise("").alias("summary"))


def title_of(page_id: Column, body: Column) -> Column:
    """The first heading, else the title in the front matter, else the file's name."""
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.*?)[ \t#]*$", 1)), F.lit(""))
    return F.coalesce(heading, T.frontmatter_value(body, "title"), F.nullif(F.regexp_extract(page_id, r"([^/]*?)(?:\.md)?$", 1), F.lit("")), page_id)


def anchor_backlinks(cited: DataFrame, anchors: DataFrame, homes: DataFrame, allowed: DataFrame) -> DataFrame:
    """concept_id, page_id: pages of the documents that have a heading a concept cites.

    cited: concept_id, anchor. anchors: anchor, doc_id. homes: doc_id, page_id. allowed: concept_id, doc_id; a
    concept that lists documents gets those only, and all of those.
    """
    free = cited.join(allowed.select("concept_id").distinct(), "concept_id", "left_anti").select("concept_id", "anchor").distinct()
    # pairs are as many as the result, so they are never shuffled: one that meets by several anchors is made by the first of them
    every = Window.partitionBy("concept_id").orderBy("anchor")
    free = free.withColumn("_before", F.collect_list("anchor").over(every.rowsBetween(Window.unboundedPreceding, -1)))
    if free.count() <= BROADCAST_ROWS:
        free = F.broadcast(free)  # counted; pages then need not move with all their anchors
    shown = anchors.join(homes, "doc_id").groupBy("page_id").agg(F.collect_set("anchor").alias("_anchors")).select("page_id", "_anchors", F.explode("_anchors").alias("anchor"))
    met = shown.join(free, "anchor").where((F.size("_before") == 0) | ~F.arrays_overlap("_before", "_anchors")).select("concept_id", "page_id")
    return met.unionByName(allowed.join(homes, "doc_id").select("concept_id", "page_id").distinct())


def backlinks(links: DataFrame, anchored: DataFrame, mentioned: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id and its referrers, in order: from links (page_id, target), headings and mentions (concept_id, page_id or source_id). Both ends must be pages; index pages don't count."""
    live = pages.where(~F.col("page_id").isin(*INDEX_PAGES)).select("page_id")
    pairs = links.select(F.col("target").alias("page_id"), F.col("page_id").alias("referrer"))
    for df, other in ((anchored, "page_id"), (mentioned, "source_id")):
        pairs = pairs.union(df.select(F.col("concept_id").alias("page_id"), F.col(other).alias("referrer"))).union(df.select(F.col(other).alias("page_id"), F.col("concept_id").alias("referrer")))
    kept = pairs.where("page_id != referrer").join(live, "page_id", "left_semi").join(live.select(F.col("page_id").alias("referrer")), "referrer", "left_semi")
    return kept.groupBy("page_id").agg(F.array_sort(F.collect_set("referrer")).alias("referrers"))


def missing_citations(pages: DataFrame) -> DataFrame:
    """page_id, region, missing of written regions on pages (page_id, body) without source ids or without citations; index and question pages are spared."""
    body = F.col("body")
    front = T.frontmatter(body)
    has_ids = front.rlike(r"(?m)^source_(?:document|revision)_ids?:[ \t]*(?:\S|\r?\n[ \t]*- )")
    listed = front.rlike(r"(?m)^sources:[ \t]*\r?\n[ \t]*- ")
    text = F.regexp_replace(body, r"\A---\r?\n(?s:.*?)\r?\n---(?:\r?\n|\z)", "")
    cites = (F.size(T.source_references(text)) > 0) | ((_kind(F.col("page_id")) == "concept") & listed)
    regions = F.regexp_extract_all(text, F.lit(r"<!-- kb:begin id=(\S+) -->"), 1)
    spared = F.col("page_id").rlike(r"(?i)(?:^|/)index\.md$") | F.col("page_id").startswith("wiki/questions")
    missing = F.when(~has_ids & ~cites, "sources and citations").when(~has_ids, "sources").otherwise("citations")
    rows = pages.where(~spared).select("page_id", has_ids.alias("_ids"), cites.alias("_cites"), missing.alias("missing"), front.rlike(r"(?m)^source_(?:document|revision)_ids?:").alias("_shape"), F.explode(regions).alias("region"))
    exempt = (F.col("region") == "citations") | (F.col("_shape") & (F.col("region") == "title"))
    return rows.where(~(F.col("_ids") & F.col("_cites")) & ~exempt).select("page_id", "region", "missing")


def issues(found: dict[str, DataFrame]) -> DataFrame:
    """Lint results under their rules in one table: rule, page_id, target, severity. found: rule to rows with page_id or name, and target if they have one."""
    severe = {"broken_links", "missing_targets"}

    def row(rule: str, df: DataFrame) -> DataFrame:
        page = F.col("page_id") if "page_id" in df.columns else F.lit(None)
        target = next((F.col(c) for c in ("target", "source_id", "region", "name") if c in df.columns), F.lit(None))
        return df.select(F.lit(rule).alias("rule"), page.cast("string").alias("page_id"), target.cast("string").alias("target"), F.lit("error" if rule in severe else "warning").alias("severity"))

    return reduce(DataFrame.unionByName, [row(rule, df) for rule, df in found.items()])


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, target, anchor of the wiki links and Markdown links on pages (page_id, body), code and front matter aside; both may be relative to the page."""
    plain = T.without_frontmatter(F.regexp_replace(T.strip_code_blocks(F.col("body")), "`[^`\n]*`", " "))
    raw = F.concat(F.regexp_extract_all(plain, F.lit(r"\[\[([^\]\r\n]+)\]\]"), 1), T.markdown_links(plain))
    found = pages.select("page_id", F.explode(raw).alias("raw")).select("page_id", T.link_target(F.col("raw"), F.col("page_id")).alias("t"))
    return found.where("t IS NOT NULL").select("page_id", "t.target", "t.anchor")


#: Rules of ``lint``.
RULES = ("broken_links", "missing_citations", "stale_citations", "orphan_sources", "unverified_quotes", "drift", "thin_concepts", "missing_concepts")


def lint(pages: DataFrame, anchors: DataFrame, sources: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """The rules that need pages, anchors and sources alone; some of them, by name, with dashes or underscores. pages: page_id, body; anchors: page_id, anchor; sources: source_id, page_id, text."""
    wanted = [r.replace("-", "_") for r in rules]
    if not wanted or set(wanted) - set(RULES):
        raise ValueError(f"no such rules: {sorted(set(wanted) - set(RULES))}")
    links = page_links(pages)
    if {"broken_links", "orphan_sources"} <= set(wanted):  # both read them
        links = cells.stored(links, "lint-links")
    cited = pages.select("page_id", F.explode(T.source_references(F.col("body"))).alias("source_id"))
    listed = pages.select(F.explode(T.frontmatter_list(F.col("body"), "source_document_ids")).alias("source_id"))
    used = cited.select("source_id").union(listed).union(links.join(sources.select(F.col("page_id").alias("target"), "source_id"), "target").select("source_id"))
    concepts = pages.where(F.col("page_id").startswith("wiki/concepts/"))

    @cache
    def unverified() -> DataFrame:
        quotes = verify.verify_quotes(verify.quote_citations(concepts).select("page_id", "quote", "source_id"), sources)
        rows = quotes.where(F.col("status").isin("absent", "source_missing"))
        return cells.stored(rows, "lint-quotes") if {"unverified_quotes", "drift"} <= set(wanted) else rows

    found = {
        "broken_links": lambda: verify.missing_targets(links, pages, anchors),
        "missing_citations": lambda: missing_citations(pages),
        "stale_citations": lambda: verify.stale_citations(cited, sources),
        "orphan_sources": lambda: verify.orphan_sources(sources, used),
        "unverified_quotes": unverified,
        "drift": lambda: unverified().where("status = 'absent'"),
        "thin_concepts": lambda: verify.thin(concepts),
        "missing_concepts": lambda: mining.missing_terms(sources.select(F.col("source_id").alias("doc_id"), "text"), pages.select(T.frontmatter_value(F.col("body"), "name").alias("name")).where("name IS NOT NULL")),
    }
    return issues({rule: found[rule]() for rule in wanted})


def category_listing(pages: DataFrame) -> DataFrame:
    """category, position and body of an index page's parts: a heading, and a link for each page by title. pages: page_id, title, category."""
    known = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Uncategorized"))
    rows = pages.select("page_id", "title", F.lower(known).alias("key"))
    links = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("title", "page_id"))).alias("p"))
    listed = F.array_join(F.transform("p", lambda x: F.concat(F.lit("- [["), x["page_id"], F.lit("|"), x["title"], F.lit("]]"))), "\n")
    heads = mining.category_index(pages).select("category", "position", F.lower("category").alias("key"))
    return heads.join(links, "key").select("category", "position", F.concat(F.lit("## "), "category", F.lit("\n\n"), listed).alias("body"))


def resolve_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (input) to id, kind and status: found or ambiguous in the first kind where the input is an id or starts one, else missing. known: id, kind, rank of the kind."""
    hits = names.beginnings(known.select("id", "kind", "rank"), wanted, "id", "input")
    per_kind = hits.groupBy("input", "kind", "rank").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.max((F.col("id") == F.col("input")).cast("int")).alias("exact"), F.max(F.when(F.col("id") == F.col("input"), F.col("id"))).alias("same"))
    first = per_kind.groupBy("input").agg(F.min_by(F.struct("kind", "n", "exact", F.coalesce("same", "id").alias("id")), "rank").alias("m"))
    status = F.when(F.col("m").isNull(), "missing").when((F.col("m.exact") == 1) | (F.col("m.n") == 1), "found").otherwise("ambiguous")
    return wanted.join(first, "input", "left").select("input", "m.kind", F.when(status == "found", F.col("m.id")).alias("id"), status.alias("status"))


def merge_concepts(concepts: DataFrame, groups: DataFrame) -> DataFrame:
    """Concepts after merges: members join their canonical concept, whose own names and sources stay first. concepts: concept_id, aliases, source_ids; groups: concept_id, canonical_id."""
    at = concepts.join(groups, "concept_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "concept_id"))
    order = F.struct((F.col("concept_id") != F.col("canonical_id")).alias("o"), "concept_id", "aliases", "source_ids")
    gathered = at.groupBy("canonical_id").agg(F.array_sort(F.collect_list(order)).alias("m"))
    union = lambda c: F.array_distinct(F.flatten(F.transform("m", lambda x: x[c])))
    return gathered.select(F.col("canonical_id").alias("concept_id"), union("aliases").alias("aliases"), union("source_ids").alias("source_ids"), F.size("m").alias("members"))


def keep_one_page(pages: DataFrame) -> DataFrame:
    """Of the pages of one source id (page_id, source_id) the newest stays; the others, in a column ``stale``, go."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("modified"), "page_id")
    return pages.withColumn("stale", F.row_number().over(newest) > 1)


def jobs(runs: DataFrame, statuses: list[str], page: int, size: int) -> DataFrame:
    """A page (from 1) of job runs of some statuses, newest first. runs: job_id, status, started."""
    picked = runs.where(F.col("status").isin(*statuses)) if statuses else runs
    return picked.orderBy(F.desc("started"), "job_id").offset((page - 1) * size).limit(size)


def jobs_to_prune(runs: DataFrame, older_than: Column) -> DataFrame:
    """Job runs that have ended and started before a time."""
    return runs.where(~F.col("status").isin("running", "queued") & (F.col("started") < older_than)).select("job_id")


def sessions(turns: DataFrame) -> DataFrame:
    """session_id, turns, last of sessions with a proper name, newest first. turns: session_id, turn, at."""
    return turns.where(F.col("session_id").rlike(SESSION_ID)).groupBy("session_id").agg(F.count("*").alias("turns"), F.max("at").alias("last")).orderBy(F.desc("last"), "session_id")


def missing_origins(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources (source_id, stable_location) whose file isn't there any more; addresses on the web are passed over."""
    local = sources.where(~F.col("stable_location").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"))
    return local.join(files.select(F.col("path").alias("stable_location")), "stable_location", "left_anti").select("source_id", "stable_location")


def build_dag(documents: DataFrame, citations: DataFrame, pages: DataFrame) -> DataFrame:
    """src_id, dst_id from documents to their pages, from these to the concepts that cite them, and from all to the index pages. documents: doc_id, page_id; citations: page_id, source_page."""
    a = documents.select(F.col("doc_id").alias("src_id"), F.col("page_id").alias("dst_id"))
    b = citations.select(F.col("source_page").alias("src_id"), F.col("page_id").alias("dst_id"))
    c = pages.select(F.col("page_id").alias("src_id"), F.concat(F.lit("wiki/"), _kind(F.col("page_id")), F.lit("s/index.md")).alias("dst_id"))
    return a.union(b).union(c).where("src_id != dst_id").distinct()


def changed_inputs(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents that aren't in the stored state, or under another revision; and those that are gone. Both: node_id, hash."""
    return state.changed(stored, inputs)


def inspect(ids: DataFrame, records: DataFrame, jobs_of: DataFrame, cited: DataFrame) -> DataFrame:
    """For each id: how many records, job runs and citations name it."""
    out = ids
    for name, df in (("records", records), ("jobs", jobs_of), ("citations", cited)):
        out = out.join(df.groupBy("id").agg(F.count("*").alias(name)), "id", "left").na.fill(0, [name])
    return out


def staged_images(pages: DataFrame, files: DataFrame, most_bytes: int = 10 << 20, kinds: str = "png|jpe?g|gif|webp|svg") -> DataFrame:
    """page_id, target, asset: local images that exist, aren't too large and are of a known kind, under names that differ."""
    refs = pages.select("page_id", F.explode(T.image_references(F.col("body"))).alias("i")).select("page_id", F.col("i.target").alias("target")).distinct()
    fine = refs.join(files.select(F.col("path").alias("target"), "length"), "target").where((F.col("length") <= most_bytes) & F.lower("target").rlike(rf"\.(?:{kinds})$"))
    name = F.regexp_extract("target", r"([^/]+)$", 1)
    n = F.dense_rank().over(Window.partitionBy(name).orderBy("target"))
    return fine.select("page_id", "target", F.when(n == 1, name).otherwise(F.regexp_replace(name, r"(\.[^.]*)$", F.concat(F.lit("-"), n.cast("string"), F.lit("$1")))).alias("asset"))


def review_counts(items: DataFrame) -> DataFrame:
    """kind (null: all) with total, pending, approved and rejected review items; kinds without a pending one are left out. items: kind, status."""
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    counts = [F.count("*").alias("total"), *map(n, ("pending", "approved", "rejected"))]
    return items.agg(*counts).select(F.lit(None).cast("string").alias("kind"), "*").unionByName(items.groupBy("kind").agg(*counts).where("pending > 0"))


def build_records_of(records: DataFrame, output_id: str) -> DataFrame:
    """Build records that made an output, newest first. records: record_id, created, output_ids."""
    return records.where(F.array_contains("output_ids", output_id)).orderBy(F.desc("created"), "record_id")


def heading_citations(revisions: DataFrame) -> DataFrame:
    """citation_id, revision_id, anchor: a citation for each key heading of a revision (revision_id, anchors), or one of the whole where there is none."""
    rows = revisions.select("revision_id", F.explode_outer("anchors").alias("anchor"))
    return rows.select(F.concat("revision_id", F.coalesce(F.concat(F.lit("#"), "anchor"), F.lit(""))).alias("citation_id"), "revision_id", "anchor")


def extracted_concepts(answers: DataFrame) -> DataFrame:
    """source_id, name of the concepts that a model's answers (source_id, answer) list: JSON with ``concepts``, or a list of them, bare, in a fence or amid prose; remarks on a concept are no concepts, and what can't be read lists none."""
    read = answers.select("source_id", answer_json(F.col("answer")).alias("json"))
    listed = F.when(F.ltrim("json").startswith("["), F.concat(F.lit('{"concepts":'), "json", F.lit("}"))).otherwise(F.col("json"))
    parsed = F.from_json(listed, "concepts array<struct<name string>>")
    rows = read.select("source_id", F.explode(parsed["concepts"]).alias("c")).select("source_id", F.trim("c.name").alias("name"))
    return rows.where((F.col("name") != "") & ~T.meta_slug(T.link_slug(F.col("name"))))


def merge_outcomes(groups: DataFrame) -> DataFrame:
    """group_id, outcome, path: confident merges become pages, the others wait for a review. groups: group_id, canonical, confident."""
    slug = T.link_slug(F.col("canonical"))
    return groups.select("group_id", F.when(F.col("confident"), "page").otherwise("review").alias("outcome"), F.when(F.col("confident"), F.concat(F.lit("wiki/concepts/"), slug, F.lit(".md"))).otherwise(F.concat(F.lit("reviews/merges/"), F.col("group_id").cast("string"), F.lit(".json"))).alias("path"))


def imputed_body(existing: Column, name: Column, definition: Column, sources: Column) -> Column:
    """A concept page with a drafted definition and the addresses (array) behind it: front matter and managed regions of the existing page (null: none) stay."""
    front = F.coalesce(F.nullif(F.regexp_extract(existing, r"\A(---\r?\n(?s:.*?)\r?\n---\r?\n)", 1), F.lit("")), F.concat(F.lit("---\nid: concept:"), T.link_slug(name), F.lit("\nname: "), name, F.lit("\norigin: imputed\n---\n")))
    regions = F.coalesce(F.array_join(F.regexp_extract_all(existing, F.lit(r"(?s)<!-- kb:begin id=(.*?) -->.*?<!-- kb:end id=\1 -->"), 0), "\n\n"), F.lit(""))
    listed = F.when(F.size(sources) > 0, F.concat(F.lit("\n## Sources\n\n"), F.array_join(F.transform(sources, lambda s: F.concat(F.lit("- "), s)), "\n"), F.lit("\n"))).otherwise("")
    drafted = F.when(F.trim(definition) != "", F.concat(F.lit("\n"), F.trim(definition), F.lit("\n"))).otherwise("")
    return F.concat(front, F.lit("\n# "), name, F.lit("\n"), drafted, listed, F.when(regions != "", F.concat(F.lit("\n"), regions, F.lit("\n"))).otherwise(""))


def promoted_body(existing: Column, answer: Column, citations: Column) -> Column:
    """The body of a question page: an answer and its citations (array) in regions of their own; what else an existing body (null: none) says stays."""
    said = F.regexp_replace(answer, r"^\s+|\s+$", "")
    listed = F.when(F.size(citations) == 0, "_No citations._").otherwise(F.array_join(F.transform(citations, lambda c: F.concat(F.lit("- "), F.trim(c))), "\n"))
    region = lambda name, content: F.concat(F.lit(f"<!-- kb:begin id={name} -->\n"), content, F.lit(f"\n<!-- kb:end id={name} -->"))
    fresh = F.concat(F.lit("## Answer\n"), region("answer", said), F.lit("\n\n## Citations\n"), region("citations", listed), F.lit("\n"))
    kept = T.put_region(T.put_region(T.without_frontmatter(existing), "answer", said), "citations", listed)
    return F.when(existing.isNull(), fresh).otherwise(kept)


def tree(files: DataFrame) -> DataFrame:
    """path, kind (dir or file), depth of all that isn't hidden below a root, folders before files and then by name, in ``position``. files: path."""
    parts = F.split("path", "/")
    seen = files.where(~F.exists(parts, lambda x: x.startswith("."))).select(parts.alias("p"))
    every = seen.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(F.slice("p", 1, n).alias("p"), (n < F.size("p")).alias("dir")))).alias("e")).select("e.*").distinct()
    step = F.transform(F.col("p"), lambda x, i: F.struct((~F.col("dir") & (i + 1 == F.size("p"))).alias("file"), x.alias("name")))
    return every.select(F.array_join("p", "/").alias("path"), F.when(F.col("dir"), "dir").otherwise("file").alias("kind"), F.size("p").alias("depth"), step.alias("position")).orderBy("position")


def eval_runs(files: DataFrame) -> DataFrame:
    """name and time of the evaluations whose results are stored, newest first. files: path, modified."""
    return files.where(F.col("path").rlike(r"\.json$")).select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("name"), "modified").orderBy(F.desc("modified"), "name")


def with_assets(pages: DataFrame, staged: DataFrame, folder: str = "assets") -> DataFrame:
    """pages (page_id, body) whose staged images (page_id, target, asset) point to their assets."""
    moved = staged.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("target", "asset"))).alias("_moved"))
    swap = lambda text, m: F.replace(text, F.concat(F.lit("]("), m["target"], F.lit(")")), F.concat(F.lit(f"]({folder}/"), m["asset"], F.lit(")")))
    joined = pages.join(moved, "page_id", "left")
    return joined.select(*[c for c in pages.columns if c != "body"], F.coalesce(F.aggregate("_moved", F.col("body"), swap), F.col("body")).alias("body"))


def with_captions(pages: DataFrame, captions: DataFrame) -> DataFrame:
    """pages (page_id, body) with a region for each caption (page_id, target, caption), named after the image's file; a caption that is there already is replaced."""
    stem = F.regexp_extract("target", r"([^/]*?)(?:\.[^./]*)?$", 1)
    listed = captions.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("caption-"), T.link_slug(stem)).alias("name"), "caption"))).alias("_c"))

    def put(body: Column, c: Column) -> Column:
        start, end = F.concat(F.lit("<!-- kb:begin id="), c["name"], F.lit(" -->")), F.concat(F.lit("<!-- kb:end id="), c["name"], F.lit(" -->"))
        at, stop = F.call_function("instr", body, start), F.call_function("instr", body, end)
        whole = F.concat(start, F.lit("\n"), c["caption"], F.lit("\n"), end)
        return F.when((at > 0) & (stop > at), F.concat(F.substring(body, F.lit(1), at - 1), whole, F.substring(body, stop + F.length(end), F.length(body)))).otherwise(F.concat(body, F.lit("\n\n"), whole))

    joined = pages.join(listed, "page_id", "left")
    return joined.select(*[c for c in pages.columns if c != "body"], F.coalesce(F.aggregate("_c", F.col("body"), put), F.col("body")).alias("body"))


def kind_counts(items: DataFrame, ingested: int) -> DataFrame:
    """kind, n, and how many of the ingested a kind still lacks. items: kind."""
    return items.groupBy("kind").agg(F.count("*").alias("n")).withColumn("pending", F.greatest(F.lit(0), F.lit(ingested) - F.col("n")).cast("long"))


def pushed_turns(turns: DataFrame, pushed: DataFrame) -> DataFrame:
    """session_id, turn, role, text of turns that are pushed to sessions (session_id, at, role, text), numbered on from those that are there (session_id, turn); sessions without a proper name take none."""
    last = turns.groupBy("session_id").agg(F.max("turn").alias("_last"))
    order = Window.partitionBy("session_id").orderBy("at")
    new = pushed.where(F.col("session_id").rlike(SESSION_ID)).join(last, "session_id", "left").withColumn("turn", (F.coalesce(F.col("_last"), F.lit(-1)) + F.row_number().over(order)).cast("long"))
    return new.select("session_id", "turn", "role", "text")


def candidate_draft(docs: DataFrame, categories: DataFrame, term: str, most: int = 12) -> DataFrame:
    """One row for a concept to write: name, path, snippets around its mentions (array, by document), and the categories there are (array, in order)."""
    found = mining.snippets(docs, term, most=most).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    known = categories.agg(F.array_sort(F.collect_set(F.nullif(F.trim("category"), F.lit("")))).alias("categories"))
    return found.crossJoin(known).select(F.lit(term).alias("name"), F.concat(F.lit("wiki/concepts/"), T.slug(F.lit(term)), F.lit(".md")).alias("path"), "snippets", "categories")
