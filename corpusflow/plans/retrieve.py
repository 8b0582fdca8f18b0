"""Whole retrievals: hybrid search, hybrid plans, the context for an answer, and what becomes of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import evaluate, fusion, graph, lexical, many, semantic


def seeds(tiers: list[DataFrame]) -> DataFrame:
    """item_id and place of what some limited tiers (item_id, rank) found: by tier, then by rank, each item once."""
    every = None
    for number, tier in enumerate(tiers):
        rows = tier.select("item_id", F.struct(F.lit(number).alias("tier"), F.col("rank").alias("rank")).alias("at"))
        every = rows if every is None else every.unionByName(rows)
    first = every.groupBy("item_id").agg(F.min("at").alias("at"))
    return first.select("item_id", F.row_number().over(Window.orderBy("at.tier", "at.rank", "item_id")).alias("place"))


def hybrid_search(index: DataFrame, chunks: DataFrame, query: str, vector: DataFrame, edges: DataFrame | None, limit: int = 10, floors: tuple[float, float] = semantic.FLOORS["hash"], rrf_k: int = fusion.RRF_K, rerank: bool = False) -> DataFrame:
    """position, item_id, score and ranks: lexical, semantic above its floor, PageRank from what both found, fused, and reranked if asked for and the tiers disagree. An index with a column body lends its first paragraph to reranking."""
    pool = max(limit, fusion.RERANK_POOL) if rerank else limit
    # tiers are a few dozen rows that are read several times: each is computed once
    lex = graph.settle(lexical.search(index, query, pool))
    lexical_tier = semantic.ranks(lex, "lexical")
    sem = graph.settle(semantic.above_floor(semantic.semantic_items(chunks, vector, pool), lex, *floors))
    semantic_tier = semantic.ranks(sem, "semantic")
    tiers = [lexical_tier, semantic_tier]
    if edges is not None:
        both = seeds(tiers).select("item_id")
        tiers.append(graph.settle(semantic.ranks_among(graph.pagerank(edges, both), both, pool, "structural")))
    fused = graph.settle(fusion.fuse(tiers, pool, rrf_k))
    if rerank:
        paragraph = T.first_paragraph(F.col("body")) if "body" in index.columns else F.lit(None).cast("string")
        text = fusion.rich_text(F.col("title"), F.col("summary"), paragraph, F.col("item_id"))
        return fusion.rerank(fused, index.select("item_id", text.alias("text")), fusion.overlap_scorer(T.query_terms(query))).where(F.col("position") <= limit)
    return fused.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "item_id"))).where(F.col("position") <= limit)


def hybrid_plan(index: DataFrame, chunks: DataFrame, query: str, vector: DataFrame, edges: DataFrame | None, budget: int, floors: tuple[float, float] = semantic.FLOORS["hash"]) -> DataFrame:
    """A lexical plan; if semantic hits survive, those not in it follow while the budget lasts, and all are ordered by fused ranks. PageRank reorders and never adds."""
    planned = graph.settle(lexical.plan(index, query, budget))
    sem = graph.settle(semantic.above_floor(semantic.semantic_items(chunks, vector, lexical.PLAN_CANDIDATES), planned, *floors))
    cost = index.select("item_id", T.entry_estimate(F.concat_ws(" ", "title", F.array_join("aliases", " "), F.array_join("headings", " "), "summary")).alias("tokens"))
    tail = sem.join(planned.select("item_id"), "item_id", "left_anti").join(cost, "item_id").select("item_id", F.col("score").alias("semantic_score"), "tokens")
    used = planned.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("used"))
    tail = lexical.within_budget(tail, budget, [F.desc("semantic_score"), F.col("item_id")], used=used).drop("position")
    members = planned.select("item_id", "tokens", F.col("position").alias("lexical_rank")).unionByName(tail.select("item_id", "tokens", F.lit(None).cast("int").alias("lexical_rank")))
    ranked = members.join(semantic.ranks(sem, "semantic").select("item_id", F.col("rank").alias("semantic_rank")), "item_id", "left")
    if edges is not None:
        structural = semantic.ranks_among(graph.pagerank(edges, members.select("item_id")), members.select("item_id"), 0, "structural").select("item_id", F.col("rank").alias("structural_rank"))
        ranked = ranked.join(structural, "item_id", "left")
    else:
        ranked = ranked.withColumn("structural_rank", F.lit(None).cast("int"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(fusion.RRF_K) + F.col(c)), F.lit(0.0))
    fused = ranked.withColumn("score", part("lexical_rank") + part("semantic_rank") + part("structural_rank"))
    return fused.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")))


def assemble(planned: DataFrame, pages: DataFrame, sections: DataFrame, query: str, budget: int) -> DataFrame:
    """seq, item_id, anchor, kind, text, start, end: in the plan's order each page in whole if it fits, else its summary and then its best sections that fit.

    planned: position, item_id. pages: item_id, body, summary. sections: item_id, section, anchor, body. A plan holds a few dozen candidates at most.
    """
    scored = lexical.section_scores(sections.join(F.broadcast(planned.select("item_id")), "item_id", "left_semi"), query)
    parts = scored.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "section", "anchor", "body"))).alias("sections"))
    one = F.broadcast(planned.select("position", "item_id")).join(pages.select("item_id", "body", "summary"), "item_id").join(parts, "item_id", "left").withColumn("_plan", F.lit(0))
    schema = "seq int, item_id string, anchor string, kind string, text string, start long, end long"

    def fold(table: pa.Table) -> pa.Table:
        left, at, out = budget, 0, []

        def put(item: str, anchor: str | None, kind: str, text: str) -> bool:
            nonlocal left, at
            cost = -(-len(text.encode()) // 4)
            if not text or cost > left:
                return False
            size = len(text.encode())
            out.append((len(out) + 1, item, anchor, kind, text, at, at + size))
            left, at = left - cost, at + size
            return True

        for r in table.sort_by("position").to_pylist():
            item = str(r["item_id"])
            if put(item, None, "document", r["body"] or ""):
                continue
            put(item, None, "summary", r["summary"] or "")
            for s in r["sections"] or []:
                put(item, s["anchor"], "section", s["body"])
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    return one.groupBy("_plan").applyInArrow(fold, schema)


def citation_manifest(context: DataFrame) -> DataFrame:
    """number and label of each piece of a context."""
    label = F.concat(F.col("item_id"), F.coalesce(F.concat(F.lit("#"), "anchor"), F.lit("")))
    return context.select(F.row_number().over(Window.orderBy("seq")).alias("number"), label.alias("label"))


def cited_numbers(answer: Column) -> Column:
    """The different numbers in brackets, in the order in which they come."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6})\]"), 1), lambda x: x.cast("int")))


def postprocess(answers: DataFrame, manifest_size: Column) -> DataFrame:
    """answers (answer_id, answer) with valid and invalid numbers, and whether to warn: no valid one, or more invalid ones."""
    numbers = cited_numbers(F.col("answer"))
    fine = lambda n: (n >= 1) & (n <= manifest_size)
    out = answers.withColumn("valid", F.filter(numbers, fine)).withColumn("invalid", F.filter(numbers, lambda n: ~fine(n)))
    return out.withColumn("banner", (F.size("valid") == 0) | (F.size("invalid") > F.size("valid")))


def linked_answer(answer: Column, labels: Column) -> Column:
    """The answer with each valid [N] as a wiki link; labels: array of labels, the first is number 1."""
    return F.aggregate(F.sequence(F.lit(1), F.size(labels)), answer, lambda text, n: F.replace(text, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.concat(F.lit("[["), F.element_at(labels, n), F.lit("]]"))))


def images(context: DataFrame, most: int = 5) -> DataFrame:
    """The first different local images of a context, in order."""
    found = context.select("seq", F.posexplode(T.image_references(F.col("text"))).alias("i", "image")).select("seq", "i", F.col("image.target").alias("target")).where(~F.col("target").rlike("^(?:data:|https?://)"))
    return found.groupBy("target").agg(F.min(F.struct("seq", "i")).alias("at")).orderBy("at").limit(most).select("target")


def sources_of(page: DataFrame, pages: DataFrame, backlinks: DataFrame) -> DataFrame:
    """page_id, source_id: a page's own sources, else those of the pages that link to it, else of those that link to these.

    pages: page_id, source_ids. backlinks: page_id, referrer.
    """
    own = pages.where(F.size("source_ids") > 0).select("page_id", "source_ids")
    asked = page.select("page_id", F.col("page_id").alias("at"))
    answers, left = [], asked
    for depth in range(3):
        found = left.join(own.withColumnRenamed("page_id", "at"), "at").select("page_id", F.explode("source_ids").alias("source_id"))
        answers.append(found)
        if depth < 2:
            left = left.join(found.select("page_id").distinct(), "page_id", "left_anti").join(backlinks.withColumnRenamed("page_id", "at"), "at").select("page_id", F.col("referrer").alias("at")).distinct()
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out.distinct()


def embedding_inputs(chunks: DataFrame, pages: DataFrame, backend: str) -> DataFrame:
    """chunk_id, item_id, text, content_hash: what is embedded of each chunk (title, aliases, heading, body), and the key that says whether it must be anew."""
    meta = pages.select("item_id", "title", "aliases")
    head = F.concat_ws(" | ", "title", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ", "), "heading")
    joined = chunks.join(meta, "item_id", "left").withColumn("text", F.concat_ws("\n", head, "body"))
    return joined.select(F.concat("item_id", F.lit("#"), "chunk_idx").alias("chunk_id"), "item_id", "text", T.fingerprint(F.lit(backend), F.col("text")).alias("content_hash"))


def write_context(context: DataFrame, path: str) -> None:
    context.write.mode("overwrite").json(path)


def write_answer(answers: DataFrame, context: DataFrame, planned: DataFrame, path: str) -> None:
    """An answer's artifacts below a folder, as JSON: the answers, and beside them what they were given to read and the plan of it."""
    for name, rows in (("answer", answers), ("context", context), ("plan", planned)):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def eval_run(index: DataFrame, golden: DataFrame | list[tuple[str, str, list[str]]], k: int = 10, budget: int = 20_000) -> DataFrame:
    """The ranking measures of each query of a golden set (query_id, query, expected names): the first k of its plan. All queries are planned in one scan."""
    asked = golden if isinstance(golden, DataFrame) else index.sparkSession.createDataFrame(golden, "query_id string, query string, expected array<string>")
    top = many.lexical_plans(index, asked.select("query_id", "query"), budget).where(F.col("position") <= k)
    rows = top.join(asked.select("query_id", "expected"), "query_id")
    return evaluate.ranking_metrics(rows.select("query_id", "position", evaluate.relevant(F.col("item_id").cast("string"), F.col("expected")).alias("relevant")), k)
