"""Lexical retrieval: weighted token counts, explained, and a greedy plan within a token budget.

The corpus is never shuffled for a query: its tokens meet the query's few terms inside the
scan, and only entries with a positive score move on.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators.graph import settle

# How much a match in each field counts, in the order in which reasons are listed.
WEIGHTS = {"title": 4, "alias": 3, "heading": 2, "summary": 1}
#: Candidates that a plan considers.
PLAN_CANDIDATES = 25
#: Fixed value: matches below which a plan falls back on index pages and the newest sources.
FALLBACK = 3


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_words: int = 8) -> DataFrame:
    """Index entries of plain documents: the first words as title, the text as summary."""
    words = F.split(F.col(text_col), r"\s+", title_words + 1)  # the rest stays uncut
    return docs.select(F.col(id_col).alias("item_id"), F.array_join(F.slice(words, 1, title_words), " ").alias("title"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("headings"), F.col(text_col).alias("summary"))


def _count(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w == term))


def _texts() -> dict[str, Column]:
    return {"title": F.col("title"), "alias": F.array_join("aliases", " "), "heading": F.array_join("headings", " "), "summary": F.col("summary")}


def _may_match(weights: dict[str, int], terms: list[str]) -> Column:
    """Whether some term stands anywhere in a field, be it within a word: a plain look that spares most entries the taking apart.

    Cuts between words don't change how letters are lowered, sigmas aside.
    """
    if any(set(t) & set("σς") for t in terms):
        return F.lit(True)
    low = [F.lower(text) for name, text in _texts().items() if name in weights]
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(x, F.lit(t)), F.lit(False)) for x in low for t in dict.fromkeys(terms)])


def _fields(weights: dict[str, int], terms: list[str]) -> list[tuple[str, int, Column]]:
    """Name, weight and the tokens that are among the terms of each field."""
    text = _texts()
    return [(name, w, T.tokens_among(F.coalesce(text[name], F.lit("")), terms)) for name, w in weights.items()]


def _hits(index: DataFrame, query: str, weights: dict[str, int]) -> DataFrame:
    """item_id and, for each field and different query term found there: field_order, field, term_order, term, found, adds."""
    terms = Counter(T.query_terms(query))
    per_field = [
        F.array(*[F.struct(F.lit(i).alias("field_order"), F.lit(name).alias("field"), F.lit(j).alias("term_order"), F.lit(term).alias("term"), _count(F.col(f"_{name}"), term).alias("found"), F.lit(n * weights[name]).alias("weight")) for j, (term, n) in enumerate(terms.items())])
        for i, name in enumerate(weights)
    ]
    marked = index.select("*", *[toks.alias(f"_{name}") for name, _, toks in _fields(weights, list(terms))])
    return marked.select("*", F.filter(F.concat(*per_field), lambda h: h["found"] > 0).alias("hits")).drop(*[f"_{name}" for name in weights])


def score(index: DataFrame, query: str, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """index with score (long) and hits; entries that match nothing are left out. A query of stopwords matches nothing."""
    if not T.query_terms(query):
        return index.select("*", F.lit(0).cast("long").alias("score")).limit(0)
    total = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + (h["found"] * h["weight"]).cast("long"))
    matches = [F.size(tokens) > 0 for _, _, tokens in _fields(weights, T.query_terms(query))]
    # weights are positive, so what matches has a score
    some = index.where(_may_match(weights, T.query_terms(query))).where(reduce(lambda a, b: a | b, matches))
    return _hits(some, query, weights).withColumn("score", total)


def search(index: DataFrame, query: str, k: int = 10) -> DataFrame:
    """item_id and score of the best k; ties by id."""
    return score(index, query).orderBy(F.desc("score"), "item_id").limit(k).select("item_id", "score")


def reasons(scored: DataFrame) -> DataFrame:
    """A row for each reason of a score, in order."""
    h = F.posexplode("hits").alias("reason", "h")
    text = F.format_string("%s matched '%s' %dx (+%d)", F.col("h.field"), F.col("h.term"), F.col("h.found"), F.col("h.found") * F.col("h.weight"))
    return scored.select("item_id", h).select("item_id", "reason", text.alias("message"))


def within_budget(candidates: DataFrame, budget: int, order: list[Column], cost: str = "tokens", most: int = PLAN_CANDIDATES, used: DataFrame | None = None) -> DataFrame:
    """Walk the best candidates in order; take each that still fits, pass over those that don't and go on.

    One row carries at most ``most`` candidates, so the fold is a single expression. used: one row with what is spent already, in its first column.
    """
    columns = candidates.columns
    ranked = candidates.orderBy(*order).limit(most).withColumn("_pos", F.row_number().over(Window.orderBy(*order)))
    rows = ranked.groupBy().agg(F.array_sort(F.collect_list(F.struct("_pos", *columns))).alias("r"))
    spent = F.lit(0)
    if used is not None:
        rows, spent = rows.crossJoin(F.broadcast(used.select(F.col(used.columns[0]).alias("_used")))), F.col("_used")  # broadcast: one row
    kind = rows.schema["r"].dataType.simpleString()
    start = F.struct(spent.cast("long").alias("used"), F.array().cast(kind).alias("taken"))
    step = lambda a, x: F.when(a["used"] + x[cost] <= budget, F.struct((a["used"] + x[cost]).cast("long").alias("used"), F.array_append(a["taken"], x).alias("taken"))).otherwise(a)
    taken = rows.select(F.aggregate("r", start, step).alias("a")).select(F.posexplode("a.taken").alias("_i", "t"))
    return taken.select((F.col("_i") + 1).alias("position"), *[F.col(f"t.{c}") for c in columns])


def plan(index: DataFrame, query: str, budget: int, pages: DataFrame | None = None, newest: DataFrame | None = None) -> DataFrame:
    """position, item_id, score, tokens of the entries to read within the budget.

    pages and newest (item_id, tokens, order) are fallen back on where fewer than three entries match at all.
    """
    text = F.concat_ws(" ", "title", F.array_join("aliases", " "), F.array_join("headings", " "), "summary")
    scored = score(index, query).select("item_id", "score", T.entry_estimate(text).alias("tokens"))
    planned = within_budget(scored, budget, [F.desc("score"), F.col("item_id")])
    if pages is None or newest is None:
        return planned
    matches = scored.limit(FALLBACK).agg(F.count("*").alias("matches"))
    return with_fallback(settle(planned), pages, newest, budget, matches=settle(matches))  # 25 rows at most, and one, that are looked at several times


def with_fallback(planned: DataFrame, pages: DataFrame, newest: DataFrame, budget: int, least: int = FALLBACK, matches: DataFrame | None = None) -> DataFrame:
    """Where fewer than ``least`` candidates match, add index pages and then the newest sources (5 at most) that the budget still holds, passing over those that it doesn't.

    pages and newest: item_id, tokens, and order. Added candidates have score 0 and follow the plan's. matches: one row, how many match at all; by default how many the plan has.
    """
    state = planned.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("used"))
    state = state.crossJoin(matches) if matches is not None else state.withColumn("matches", F.col("n"))
    more = pages.select("item_id", "tokens", F.lit(0).alias("tier"), "order").unionByName(newest.orderBy("order", "item_id").limit(5).select("item_id", "tokens", F.lit(1).alias("tier"), "order"))
    more = more.groupBy("item_id").agg(F.min(F.struct("tier", "order", "tokens")).alias("m")).select("item_id", "m.*").join(planned.select("item_id"), "item_id", "left_anti")
    more = more.crossJoin(F.broadcast(state.select("matches"))).where(F.col("matches") < least).drop("matches")  # broadcast: one row
    fits = within_budget(more, budget, [F.col("tier"), F.col("order"), F.col("item_id")], used=state.select("used"))
    added = fits.crossJoin(F.broadcast(state.select("n"))).select((F.col("n") + F.col("position")).cast("int").alias("position"), "item_id", F.lit(0).cast("long").alias("score"), F.col("tokens").cast("long").alias("tokens"))
    return planned.select("position", "item_id", "score", "tokens").unionByName(added)


def section_scores(sections: DataFrame, query: str) -> DataFrame:
    """sections: item_id, section, anchor, body. Twice the anchor's count of each query token and once the body's; repeated tokens count again."""
    terms = Counter(T.query_terms(query))

    def hits(tokens: Column) -> Column:
        return sum((_count(tokens, t) * n for t, n in terms.items()), F.lit(0))

    if not terms:
        return sections.withColumn("score", F.lit(0).cast("long"))
    return sections.withColumn("score", (2 * hits(T.tokens_among(F.col("anchor"), list(terms))) + hits(T.tokens_among(F.col("body"), list(terms)))).cast("long"))
