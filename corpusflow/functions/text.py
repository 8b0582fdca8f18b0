"""Scalar text functions as columns: tokens, slugs, headings, links, quotes, token estimates.

All stay in the JVM. Patterns keep to what RE2 knows too, but for those with a
back-reference (managed regions).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.words import QUERY_STOPWORDS

# Patterns of slugs that are remarks on a concept.
META_SLUGS = (r"^.+-trade-off$", r"^.+-handling$", r"^.+-behavior$", r"^.+-implementation$", r"^.+-considerations?$", r"^.+-approach$")
#: Double and single quotation marks that fold into one.
DOUBLE_QUOTES = "“”„‟«»"
SINGLE_QUOTES = "‘’‚‛"


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, cut at lower-to-upper case, of at least two bytes."""
    cut = F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(cut), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 1)


def tokens_among(text: Column, terms: list[str]) -> Column:
    """Those tokens of a text that are one of some terms, in order, without making the others: one scan for the terms between what isn't a letter or a digit."""
    cut = F.lower(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2"))
    wanted = "|".join(map(re.escape, sorted(set(terms), key=lambda t: (-len(t), t))))
    return F.regexp_extract_all(cut, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{wanted})(?![\p{{L}}\p{{N}}])"), 0)


def query_tokens(text: Column) -> Column:
    """Tokens without stopwords; repeated ones stay."""
    stop = F.array(*map(F.lit, QUERY_STOPWORDS))
    return F.filter(tokens(text), lambda w: ~F.array_contains(stop, w))


def query_terms(query: str) -> list[str]:
    """query_tokens of a string, on the driver."""
    cut = "".join(a + " " if a.islower() and b.isupper() else a for a, b in zip(query, [*query[1:], " "], strict=False))
    words = re.split(r"[\W_]+", cut.lower())
    return [w for w in words if len(w.encode()) > 1 and w not in QUERY_STOPWORDS]


def only_stopwords(text: Column) -> Column:
    """There are tokens, and all are stopwords."""
    return (F.size(tokens(text)) > 0) & (F.size(query_tokens(text)) == 0)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slug(title: Column) -> Column:
    """Runs of other than letters and digits become a dash; only A-Z are lowered."""
    return F.translate(F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", ""), _UPPER, _LOWER)


def file_slug(title: Column, most: int = 60) -> Column:
    """ASCII letters and digits only; what is longer ends at the last dash within, and is empty without one."""
    whole = F.regexp_replace(F.regexp_replace(F.translate(title, _UPPER, _LOWER), "[^a-z0-9]+", "-"), r"^-+|-+$", "")
    head = F.substring(whole, 1, most)
    cut = F.when(F.substring(whole, most + 1, 1) == "-", head).otherwise(F.regexp_extract(head, "^(.*)-[^-]*$", 1))
    return F.when(F.length(whole) <= most, whole).otherwise(F.regexp_replace(cut, "-+$", ""))


def link_slug(raw: Column) -> Column:
    """Lower case; spaces, dashes and underscores become one dash, other signs go."""
    kept = F.regexp_replace(F.lower(F.trim(raw)), r"[^\p{L}\p{N}\s_-]+", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s_-]+", "-"), r"^-+|-+$", "")


def heading_lines(body: Column) -> Column:
    """Every line that starts with #, without its hashes; fences don't matter."""
    return F.transform(F.filter(lines(body), lambda x: x.startswith("#")), lambda x: F.trim(F.regexp_replace(x, "^#+", "")))


def region(body: Column, name: str) -> Column:
    """The content of the first managed region of that name, or the empty string."""
    return F.regexp_extract(body, rf"(?s)<!-- kb:begin id={re.escape(name)} -->(.*?)<!-- kb:end id={re.escape(name)} -->", 1)


def without_region_marks(body: Column) -> Column:
    """Managed regions give way to their content."""
    return F.regexp_replace(body, r"(?s)<!-- kb:begin id=(.*?) -->(.*?)<!-- kb:end id=\1 -->", "$2")


def put_region(body: Column, name: str, content: Column) -> Column:
    """Replace a managed region's content, or append the region; text outside stays as it is."""
    start, end = f"<!-- kb:begin id={name} -->", f"<!-- kb:end id={name} -->"
    at, stop = F.instr(body, start), F.instr(body, end)
    whole = F.concat(F.lit(start + "\n"), content, F.lit("\n" + end))
    swapped = F.concat(F.substring(body, F.lit(1), at - 1), whole, F.substring(body, stop + len(end), F.length(body)))
    return F.when((at > 0) & (stop > at), swapped).otherwise(F.concat(body, F.lit("\n\n"), whole))


def frontmatter(body: Column) -> Column:
    """What stands between the leading --- lines, or the empty string."""
    return F.regexp_extract(body, r"\A---\r?\n((?s:.*?))\r?\n---(?:\r?\n|\z)", 1)


def frontmatter_value(body: Column, key: str) -> Column:
    """A scalar of the front matter, without quotes; null if it isn't there."""
    found = F.regexp_extract(frontmatter(body), rf"(?m)^{re.escape(key)}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    return F.nullif(found, F.lit(""))


def frontmatter_list(body: Column, key: str) -> Column:
    """A block list of scalars of the front matter."""
    block = F.regexp_extract(frontmatter(body), rf"(?m)^{re.escape(key)}:[ \t]*\r?\n((?:[ \t]*- .*(?:\r?\n|\z))+)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*- [\"']?(.*?)[\"']?[ \t]*$"), 1), lambda x: F.trim(x))


def wiki_links(body: Column) -> Column:
    """Targets of [[...]]: without alias, anchor, leading ./ or /, and .md."""
    raw = F.regexp_extract_all(body, F.lit(r"\[\[([^\]\r\n]+)\]\]"), 1)
    return F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(x, r"^([^|#]*)", 1)), r"^(?:\./|/)+", ""), r"\.md$", ""))


def source_references(body: Column) -> Column:
    """src-ids in brackets, with or without anchor or note, or in parentheses, in the order of the text."""
    return F.regexp_extract_all(fold_quotes(body), F.lit(r"[\[(](src-[A-Za-z0-9][A-Za-z0-9_-]*)(?:#[A-Za-z0-9_-]+)?(?:\s[^\]\r\n]*)?[\])]"), 1)


def fold_quotes(text: Column) -> Column:
    return F.translate(text, DOUBLE_QUOTES + SINGLE_QUOTES, '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES))


def match_form(text: Column) -> Column:
    """For comparing quotations: folded quotes, no emphasis marks, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(fold_quotes(text), "*_`", "")), r"\s+", " "))


def strip_code(body: Column) -> Column:
    """Blank fenced blocks and inline code."""
    return F.regexp_replace(F.regexp_replace(body, r"(?ms)^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$", " "), "`[^`\n]*`", " ")


def strip_code_blocks(body: Column) -> Column:
    """Blank blocks fenced by backticks; tildes fence nothing here, and inline code stays."""
    return F.regexp_replace(body, r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)", " ")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_frontmatter(body: Column) -> Column:
    return F.regexp_replace(body, r"\A---\r?\n(?s:.*?)\r?\n---(?:\r?\n|\z)", "")


#: Fixed value: bytes of a page's first paragraph that count.
PARAGRAPH_BYTES = 800


def first_paragraph(body: Column) -> Column:
    """The lines of the first paragraph after the title, joined by spaces; headings and comments are passed over, and a second-level heading ends the search. Null if there is none.

    What is longer than 800 bytes is cut at the last whole character within.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))
    put = lambda a, text, done: F.struct(text.alias("text"), done.alias("done"))

    def step(a: Column, line: Column) -> Column:
        t = _trimmed(line)
        more = F.when(a["text"] == "", t).otherwise(F.concat(a["text"], F.lit(" "), t))
        blank = t.startswith("<!--") | (t == "")
        return (
            F.when(a["done"] | t.startswith("# "), a)
            .when(t.startswith("## "), put(a, a["text"], F.lit(True)))
            .when(blank, put(a, a["text"], a["text"] != ""))
            .otherwise(put(a, more, F.octet_length(more) >= PARAGRAPH_BYTES))
        )

    whole = F.aggregate(lines(without_frontmatter(body)), start, step)["text"]
    raw = F.encode(whole, "UTF-8")
    parts = [F.substring(raw, F.lit(1), F.lit(PARAGRAPH_BYTES - k)).cast("string") for k in range(4)]
    cut = F.coalesce(*[F.when(F.is_valid_utf8(x), x) for x in parts])
    return F.nullif(F.when(F.octet_length(whole) <= PARAGRAPH_BYTES, whole).otherwise(cut), F.lit(""))


def definition_hint(body: Column) -> Column:
    """The text of a concept before its first second-level heading, managed region or gap of two blank lines, without the title, in single spaces."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("started"), F.lit(False).alias("gap"), F.lit(False).alias("done"))
    put = lambda text, started, gap, done: F.struct(text.alias("text"), F.lit(started).alias("started"), F.lit(gap).alias("gap"), F.lit(done).alias("done"))

    def step(a: Column, line: Column) -> Column:
        t = _trimmed(line)
        return (
            F.when(a["done"] | (~a["started"] & ((t == "") | (t.startswith("#") & ~t.startswith("## ")))), a)
            .when(t.startswith("## ") | t.startswith("<!-- kb:begin") | ((t == "") & a["gap"]), put(a["text"], True, False, True))
            .when(t == "", put(a["text"], True, True, False))
            .otherwise(put(F.concat(a["text"], F.lit(" "), t), True, False, False))
        )

    return F.trim(F.regexp_replace(F.aggregate(lines(body), start, step)["text"], r"\s+", " "))


def markdown_links(body: Column) -> Column:
    """Destinations of Markdown links that aren't images: what <> enclose, or all up to white space."""
    pattern = F.lit(r"(!?)\[[^\]]*\]\(([^)]+)\)")
    pairs = F.arrays_zip(F.regexp_extract_all(body, pattern, 1).alias("sign"), F.regexp_extract_all(body, pattern, 2).alias("raw"))
    plain = F.transform(F.filter(pairs, lambda p: p["sign"] == ""), lambda p: F.trim(p["raw"]))
    return F.filter(F.transform(plain, lambda x: F.when(x.startswith("<"), F.regexp_extract(x, r"^<[^>]*>", 0)).otherwise(F.regexp_extract(x, r"^\S+", 0))), lambda x: x != "")


def link_target(raw: Column, page_id: Column) -> Column:
    """struct(target, anchor) of a link on a page: its path from the root of the wiki, with .md; null for other places than the wiki.

    Paths that don't begin at the wiki are relative to the page; . and .. are resolved; an alias goes; without a path the page itself is meant.
    """
    plain = F.trim(F.regexp_extract(F.trim(raw), r"^([^|]*)", 1))
    path = F.trim(F.regexp_replace(F.trim(F.regexp_extract(plain, r"^([^#]*)", 1)), r"^<+|>+$", ""))
    anchor = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(plain, r"#(.*)$", 1), r">+$", "")), F.lit(""))
    bare = F.regexp_replace(path, r"\.md$", "")
    folder = F.regexp_extract(page_id, r"^(.*)/[^/]*$", 1)
    joined = F.when(bare.startswith("wiki"), bare).otherwise(F.concat(folder, F.lit("/"), bare))
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x.isin("", "."), a).otherwise(F.array_append(a, x))
    clean = F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")
    target = F.when(path == "", page_id).when(clean.startswith("wiki/"), F.concat(clean, F.lit(".md")))
    away = (plain == "") | plain.rlike(r"^(?:https?://|mailto:)")
    return F.when(~away & target.isNotNull(), F.struct(target.alias("target"), anchor.alias("anchor")))


def drop_narration(text: Column) -> Column:
    """An answer from its first heading on; without one its last paragraph; without paragraphs all of it."""
    plain = F.regexp_replace(text, r"^[\r\n]+", "")
    heading = F.regexp_extract(plain, r"(?sd)(?:\A|(?<=\n))#{1,6} .*\z", 0)
    broken = plain.rlike(r"\n[ \t]*\n")
    last = F.regexp_extract(plain, r"(?sd)\A.*\n[ \t]*\n(.*)\z", 1)
    return F.regexp_replace(F.when(heading != "", heading).when(broken, last).otherwise(plain), r"\s+$", "")


def rebased(body: Column, prefix: str) -> Column:
    """Relative links and images with a prefix before their path, as a page in another folder needs them; addresses, roots and anchors stay."""
    return F.regexp_replace(body, r"(!?\[[^\]]*\])\((?![A-Za-z][A-Za-z0-9+.-]*:|#|/)(?:\./)?([^)\s]+)", f"$1({prefix}$2")


def kb_path(uri: Column) -> Column:
    """The path that a kb:// address names, without fragment, query and leading slashes; null for anything else."""
    rest = F.regexp_extract(uri, r"^kb://([^#?]*)", 1)
    return F.nullif(F.trim(F.regexp_replace(rest, "^/+", "")), F.lit(""))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def entry_estimate(text: Column) -> Column:
    """Tokens of an index entry: a quarter of the bytes, rounded up, 32 at least."""
    return F.greatest(F.lit(32), F.ceil(F.octet_length(text) / 4)).cast("long")


def text_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def chunk_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def page_span(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("p."), first)).otherwise(F.concat(F.lit("pp."), first, F.lit("-"), last))


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


def contains_word(text: Column, word: Column) -> Column:
    """Whether the word stands in the text between ASCII word boundaries. A plain look comes first, as a pattern must be made for each word; one that would end the quoting is left to the pattern."""
    return (F.contains(text, word) | F.contains(word, F.lit(r"\E"))) & F.regexp_like(text, F.concat(F.lit(r"(?:^|[^A-Za-z0-9_])\Q"), word, F.lit(r"\E(?:$|[^A-Za-z0-9_])")))


def meta_slug(value: Column) -> Column:
    """Whether a slug is a remark on a concept rather than one."""
    return value.rlike("|".join(META_SLUGS))


def url_identity(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no closing slashes but the root's, query pairs in order."""
    plain = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    trimmed = F.regexp_replace(path, "/+$", "")
    pairs = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(head, F.when(trimmed == "", "/").otherwise(trimmed), F.when(query == "", "").otherwise(F.concat(F.lit("?"), pairs)))


def looks_like_markdown(text: Column) -> Column:
    """No HTML opening within 4096 characters, and a heading first."""
    head = F.lower(F.substring(text, 1, 4096))
    return ~head.contains("<html") & ~head.contains("<!doctype") & F.ltrim(text).startswith("# ")


def html_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags; common entities resolved; single spaces."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


#: Elements that frame a page's text.
FRAMES = ("nav", "header", "footer", "aside", "form")


def html_main(html: Column) -> Column:
    """The visible text of what a page is about: its main part or article if it marks one, without navigation, headers, footers, asides and forms."""
    bare = F.regexp_replace(html, "(?is)" + "|".join(f"<{x}\\b.*?</{x}>" for x in FRAMES), " ")
    marked = F.regexp_extract(bare, r"(?is)<(?:main|article)\b[^>]*>(.*)</(?:main|article)>", 1)
    return html_text(F.when(marked != "", marked).otherwise(F.regexp_replace(bare, r"(?is)<head\b.*?</head>", " ")))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)


def semantically_empty(text: Column) -> Column:
    """Nothing but white space once front matter is gone; an unclosed front matter counts as nothing."""
    opened = text.rlike(r"\A---\r?\n")
    body = F.regexp_replace(text, r"\A---\r?\n(?s:.*?)\r?\n---(?:\r?\n|\z)", "")
    return (opened & body.rlike(r"\A---\r?\n")) | (F.trim(F.regexp_replace(body, r"\s+", " ")) == "")


def image_references(body: Column) -> Column:
    """struct(alt, target) of each Markdown image."""
    alts = F.regexp_extract_all(body, F.lit(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), 1)
    targets = F.regexp_extract_all(body, F.lit(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), 2)
    return F.zip_with(alts, targets, lambda a, t: F.struct(a.alias("alt"), t.alias("target")))


def fingerprint(*parts: Column) -> Column:
    """A digest of parts that no other parts share."""
    return F.sha2(F.concat_ws("\0", *parts), 256)
