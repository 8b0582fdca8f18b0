"""The registered queries of the library's own operators over the driver's tables, and DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions import readable
from corpusflow.functions import text as T
from corpusflow.functions import vectors as V
from corpusflow.functions.words import CONCEPT_STOPWORDS, PHRASE_STOPWORDS, QUERY_STOPWORDS
from corpusflow.operators import chunks, evaluate, fusion, graph, graph_paths, lexical, lexical_index, many, mining, nearest_names, push, semantic, state, transcript, verify, wiki
from corpusflow.plans import retrieve
from corpusflow.sources import cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The query of the retrieval examples: words of the corpus, some of them stopwords, one repeated.
QUESTION = "the thing ering and onthe ering of hein thand leon est"


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(words: list[str]) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace({x},'(\p{{Ll}})(\p{{Lu}})','\1 \2','g')),'[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) > 1)"


TERMS = T.query_terms(QUESTION)
_TERM_ROWS = ",".join(f"('{t}',{TERMS.count(t)},{i})" for i, t in enumerate(dict.fromkeys(TERMS)))
_TITLE = r"array_to_string(regexp_split_to_array(text,'\s+')[1:8],' ')"
_SCORES = f"""
 terms(term, n, o) AS (VALUES {_TERM_ROWS}),
 toks AS (SELECT doc_id, {_tokens(_TITLE)} AS t, {_tokens('text')} AS s FROM documents),
 hits AS (SELECT doc_id, term, n, o, len(list_filter(t, lambda w: w = term)) AS in_title, len(list_filter(s, lambda w: w = term)) AS in_summary FROM toks, terms),
 scores AS (SELECT doc_id AS item_id, CAST(sum((4 * in_title + in_summary) * n) AS BIGINT) AS score FROM hits GROUP BY doc_id HAVING sum((4 * in_title + in_summary) * n) > 0)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.entries(table(spark, sf_dir, "documents"))


# Text functions


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS different, CAST(list_sum(list_transform(t, lambda w: strlen(w))) AS BIGINT) AS bytes FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)")
def token_counts(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("different"), F.aggregate("t", F.lit(None).cast("long"), lambda a, w: F.coalesce(a, F.lit(0)) + F.octet_length(w)).alias("bytes"))


@query(f"SELECT item_id, len(t) > 0 AND len(list_filter(t, lambda w: NOT list_contains({_list(QUERY_STOPWORDS)}, w))) = 0 AS only_stopwords FROM (SELECT item_id, {_tokens('text')} AS t FROM (SELECT doc_id AS item_id, text FROM documents UNION ALL SELECT -doc_id - 1, array_to_string(regexp_split_to_array(text, ' ')[1:2], ' ') FROM documents))")
def stopword_guard(spark, sf_dir):
    """Whole documents, and their first two words."""
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    short = b.select((-F.col("item_id") - 1).alias("item_id"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("text"))
    return b.unionByName(short).select("item_id", T.only_stopwords(F.col("text")).alias("only_stopwords"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"


@query(rf"""WITH t AS (SELECT doc_id, {_TITLE} AS title FROM documents),
 f AS (SELECT doc_id, title, regexp_replace(regexp_replace(translate(title,{_AZ}),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') AS w FROM t)
 SELECT doc_id, translate(regexp_replace(regexp_replace(title,'[^\p{{L}}\p{{N}}]+','-','g'),'^-+|-+$','','g'),{_AZ}) AS slug,
  CASE WHEN length(w) <= 60 THEN w ELSE regexp_replace(CASE WHEN substring(w,61,1) = '-' THEN substring(w,1,60) ELSE regexp_extract(substring(w,1,60),'^(.*)-[^-]*$',1) END,'-+$','') END AS file_slug,
  regexp_replace(regexp_replace(regexp_replace(lower(trim(title)),'[^\p{{L}}\p{{N}}\s_-]+','','g'),'[\s_-]+','-','g'),'^-+|-+$','','g') AS link_slug FROM f""")
def title_slugs(spark, sf_dir):
    t = _index(spark, sf_dir)
    return t.select(F.col("item_id").alias("doc_id"), T.slug(F.col("title")).alias("slug"), T.file_slug(F.col("title")).alias("file_slug"), T.link_slug(F.col("title")).alias("link_slug"))


@query("""SELECT item_id, md5(trim(regexp_replace(lower(translate(translate(text,'“”„‟«»‘’‚‛',repeat(chr(34), 6) || repeat(chr(39), 4)),'*_`','')),'\\s+',' ','g'))) AS form FROM (SELECT doc_id AS item_id, '“' || text || '” *said* ‘x’' AS text FROM documents)""")
def match_forms(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("“"), "text", F.lit("” *said* ‘x’")).alias("text"))
    return b.select("item_id", F.md5(T.match_form(F.col("text")).cast("binary")).alias("form"))


@query("SELECT doc_id, CAST(greatest(32, ceil(strlen(text) / 4.0)) AS BIGINT) AS entry_tokens, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS text_tokens, CAST(floor(length(text) / 4.0) AS BIGINT) AS chunk_tokens FROM documents")
def token_estimates(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.entry_estimate(x).alias("entry_tokens"), T.text_estimate(x).alias("text_tokens"), T.chunk_estimate(x).alias("chunk_tokens"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url,'#.*$','') AS u FROM pages),
 q AS (SELECT page_id, lower(regexp_extract(u,'^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)',1)) AS h, regexp_replace(regexp_extract(u,'^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)',1),'/+$','') AS p, regexp_extract(u,'\?(.*)$',1) AS s FROM p)
 SELECT page_id, h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN s = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(s,'&')),'&') END AS identity FROM q""")
def url_identities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_identity(F.col("url")).alias("identity"))


@query(r"""WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(html,'(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->',' ','g'),'(?s)<[^>]*>',' ','g') AS x FROM pages)
 SELECT page_id, regexp_extract(html,'(?is)<title>(.*?)</title>',1) AS title, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(x,'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',chr(39)),'&amp;','&'),'\s+',' ','g'))) AS text_md5,
  (NOT contains(lower(substring(html,1,4096)),'<html') AND NOT contains(lower(substring(html,1,4096)),'<!doctype') AND starts_with(ltrim(html),'# ')) AS markdown FROM b""")
def html_pages(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(h).alias("title"), F.md5(T.html_text(h).cast("binary")).alias("text_md5"), T.looks_like_markdown(h).alias("markdown"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(CASE WHEN page_id % 2 = 0 THEN replace(replace(html, '<body>', '<body><main class="x">'), '</body>', '</main><footer>f</footer></body>') ELSE html END,'(?is)<nav\b.*?</nav>|<header\b.*?</header>|<footer\b.*?</footer>|<aside\b.*?</aside>|<form\b.*?</form>',' ','g') AS h FROM pages),
 m AS (SELECT page_id, h, regexp_extract(h,'(?is)<(?:main|article)\b[^>]*>(.*)</(?:main|article)>',1) AS m FROM a), c AS (SELECT page_id, CASE WHEN m <> '' THEN m ELSE regexp_replace(h,'(?is)<head\b.*?</head>',' ','g') END AS c FROM m),
 b AS (SELECT page_id, regexp_replace(regexp_replace(c,'(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->',' ','g'),'(?s)<[^>]*>',' ','g') AS x FROM c)
 SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(x,'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',chr(39)),'&amp;','&'),'\s+',' ','g'))) AS text_md5 FROM b""")
def html_main_texts(spark, sf_dir):
    """Every second page marks its main part."""
    h, k = F.col("html"), F.col("page_id")
    marked = F.replace(F.replace(h, F.lit("<body>"), F.lit('<body><main class="x">')), F.lit("</body>"), F.lit("</main><footer>f</footer></body>"))
    p = table(spark, sf_dir, "pages").select("page_id", F.when(k % 2 == 0, marked).otherwise(h).alias("html"))
    return p.select("page_id", F.md5(T.html_main(F.col("html")).cast("binary")).alias("text_md5"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article>(.*)</article>', 1) AS h FROM pages),
 t AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<nav\b.*?</nav>|<footer\b.*?</footer>|<aside\b.*?</aside>', '', 'g'), '(?s)<[^>]*>', '', 'g') AS x, regexp_extract(h, '(?is)<h1>(.*?)</h1>', 1) AS head FROM a)
 SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(x,'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',chr(39)),'&amp;','&'), '[^\p{L}\p{N}]', '', 'g')) AS letters_md5,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(head,'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',chr(39)),'&amp;','&'), '\s+', ' ', 'g')) AS heading FROM t""")
def pages_markdown(spark, sf_dir):
    """Pages as Markdown: its letters and digits are those of the article, and its first line is the article's heading."""
    m = table(spark, sf_dir, "pages").select("page_id", readable.html_markdown(F.col("html")).alias("m"))
    letters = F.regexp_replace(F.regexp_replace("m", r"\]\([^)]*\)", ""), r"[^\p{L}\p{N}]", "")
    return m.select("page_id", F.md5(letters.cast("binary")).alias("letters_md5"), F.regexp_extract("m", r"\A# (.*)", 1).alias("heading"))


@query(r"""SELECT href, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html,'<a\s[^>]*href="([^"]*)"',1)) AS href FROM pages) GROUP BY href""")
def page_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(T.hrefs(F.col("html"))).alias("href"))
    return rows.groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


# Retrieval


@query(f"WITH {_SCORES} SELECT item_id, score FROM scores ORDER BY score DESC, item_id LIMIT 10")
def lex_search_topk(spark, sf_dir):
    return lexical.search(_index(spark, sf_dir), QUESTION, 10)


@query(f"""WITH {_SCORES}, best AS (SELECT item_id FROM scores ORDER BY score DESC, item_id LIMIT 10),
 r AS (SELECT h.doc_id AS item_id, 0 AS f, o, 'title' AS field, term, in_title AS found, in_title * n * 4 AS adds FROM hits h JOIN best b ON h.doc_id = b.item_id WHERE in_title > 0
  UNION ALL SELECT h.doc_id, 1, o, 'summary', term, in_summary, in_summary * n FROM hits h JOIN best b ON h.doc_id = b.item_id WHERE in_summary > 0)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY f, o) - 1 AS INTEGER) AS reason, field || ' matched ''' || term || ''' ' || found || 'x (+' || adds || ')' AS message FROM r""")
def lex_reasons(spark, sf_dir):
    scored = lexical.score(_index(spark, sf_dir), QUESTION)
    return lexical.reasons(scored.orderBy(F.desc("score"), "item_id").limit(10))


@query(f"WITH {_SCORES} SELECT item_id, score FROM scores ORDER BY score DESC, item_id LIMIT 10")
def lex_search_stored(spark, sf_dir):
    """The same, from an index that is built first."""
    path = cells.shared_folder(spark, "lexical-index")
    lexical_index.build(_index(spark, sf_dir), path)
    return lexical_index.search(spark, path, QUESTION, 10)


_BUDGET = 2500
_ENTRY = f"CAST(greatest(32, ceil(strlen({_TITLE} || '   ' || text) / 4.0)) AS BIGINT)"



def _plan_sql(budget: int) -> str:
    return f"""{_SCORES}, c AS (SELECT s.item_id, s.score, {_ENTRY} AS tokens, row_number() OVER (ORDER BY score DESC, item_id) AS pos FROM scores s JOIN documents d ON d.doc_id = s.item_id),
 walk(pos, item_id, score, tokens, used, takes) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false
  UNION ALL SELECT c.pos, c.item_id, c.score, c.tokens, w.used + CASE WHEN w.used + c.tokens <= {budget} THEN c.tokens ELSE 0 END, w.used + c.tokens <= {budget} FROM walk w JOIN c ON c.pos = w.pos + 1 WHERE c.pos <= 25),
 planned AS (SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS position, item_id, score, tokens FROM walk WHERE takes)"""


@query(f"WITH RECURSIVE {_plan_sql(_BUDGET)} SELECT position, item_id, score, tokens FROM planned")
def lex_plan_budget(spark, sf_dir):
    return lexical.plan(_index(spark, sf_dir), QUESTION, _BUDGET)


@query(f"WITH RECURSIVE {_plan_sql(_BUDGET).replace('FROM documents', 'FROM (SELECT * FROM documents WHERE doc_id % 101 <> 5)')} SELECT position, item_id, score, tokens FROM planned")
def lex_plan_updated(spark, sf_dir):
    """A plan from an index that was built of all documents with a few taken for another text, and then mended: one of each hundred and one goes, five get their own text back."""
    path = cells.shared_folder(spark, "lexical-index")
    d = table(spark, sf_dir, "documents")
    wrong = d.withColumn("text", F.when(F.col("doc_id") % 101 < 6, F.concat(F.lit("hein leon thand "), F.col("text"))).otherwise(F.col("text")))
    lexical_index.build(lexical.entries(wrong), path)
    lexical_index.update(path, lexical.entries(d.where("doc_id % 101 < 5")), d.where("doc_id % 101 = 5").select(F.col("doc_id").alias("item_id")))
    return lexical_index.plan(spark, path, QUESTION, _BUDGET)


_ASKED = """asked AS (SELECT 'c' || conv_id || '-' || turn AS query_id, text AS query FROM conversations UNION ALL SELECT 'b' || item_id, text FROM benchmark),
 words AS (SELECT query_id, unnest(query_tokens) AS term FROM (SELECT query_id, list_filter({t}, lambda w: NOT list_contains({s}, w)) AS query_tokens FROM asked)),
 wanted AS (SELECT query_id, term, count(*) AS n FROM words GROUP BY ALL),
 posted AS (SELECT doc_id, term, sum(w) AS impact FROM (SELECT doc_id, unnest({a}) AS term, 4 AS w FROM documents UNION ALL SELECT doc_id, unnest({b}), 1 FROM documents) GROUP BY ALL),
 every AS (SELECT query_id, doc_id AS item_id, CAST(sum(impact * n) AS BIGINT) AS score FROM wanted JOIN posted USING (term) GROUP BY ALL),
 best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS position FROM every)""".format(t=_tokens("query"), s=_list(QUERY_STOPWORDS), a=_tokens(_TITLE), b=_tokens("text"))


def _asked(spark, sf_dir):
    """Every turn of a conversation, and every text of the benchmark, is a question."""
    turns = table(spark, sf_dir, "conversations").selectExpr("'c' || conv_id || '-' || turn AS query_id", "text AS query")
    return turns.unionByName(table(spark, sf_dir, "benchmark").selectExpr("'b' || item_id AS query_id", "text AS query"))


@query(f"WITH {_ASKED} SELECT query_id, position, item_id, score FROM best WHERE position <= 10")
def lex_search_many(spark, sf_dir):
    return many.lexical_search(_index(spark, sf_dir), _asked(spark, sf_dir), 10)


_MANY_PLANS = f"""{_ASKED}, c AS (SELECT query_id, position AS pos, item_id, score, {_ENTRY} AS tokens FROM best JOIN documents ON doc_id = item_id WHERE position <= 25),
 walk(query_id, pos, item_id, score, tokens, used, takes) AS (SELECT DISTINCT query_id, CAST(0 AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM c
  UNION ALL SELECT c.query_id, c.pos, c.item_id, c.score, c.tokens, w.used + CASE WHEN w.used + c.tokens <= {_BUDGET} THEN c.tokens ELSE 0 END, w.used + c.tokens <= {_BUDGET} FROM walk w JOIN c ON c.query_id = w.query_id AND c.pos = w.pos + 1),
 plans AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS position, item_id, score, tokens FROM walk WHERE takes)"""


@query(f"WITH RECURSIVE {_MANY_PLANS} SELECT query_id, position, item_id, score, tokens FROM plans")
def lex_plans_many(spark, sf_dir):
    return many.lexical_plans(_index(spark, sf_dir), _asked(spark, sf_dir), _BUDGET)


@query(f"""WITH RECURSIVE {_MANY_PLANS}, p AS (SELECT query_id, position, contains(CAST(item_id AS VARCHAR), substring(query_id, 2, 1)) AS relevant FROM plans WHERE position <= 5),
 m AS (SELECT query_id, count(*) FILTER (relevant) AS hits, min(CASE WHEN relevant THEN position END) AS first, sum(CASE WHEN relevant THEN 1.0 / log2(position + 1) ELSE 0.0 END) AS dcg FROM p GROUP BY query_id)
 SELECT query_id, round(hits / 5, 6) AS precision_at_k, round(coalesce(1.0 / first, 0.0), 6) AS mrr, round(CASE WHEN hits = 0 THEN 0.0 ELSE dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1.0 / log2(i + 1))) END, 6) AS ndcg_at_k FROM m""")
def eval_questions(spark, sf_dir):
    """An evaluation of all questions; an item is held relevant if its id has the first digit of the question's."""
    golden = _asked(spark, sf_dir).select("query_id", "query", F.array(F.substring("query_id", 2, 1)).alias("expected"))
    return retrieve.eval_run(_index(spark, sf_dir), golden, 5, _BUDGET).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "mrr", "ndcg_at_k")])


@query("""WITH k AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, greatest(0.0, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score FROM embeddings q, embeddings c),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS position FROM k)
 SELECT query_id, position, chunk_id, round(score, 6) AS score FROM r WHERE position <= 10""")
def knn_many(spark, sf_dir):
    """The nearest of every vector, itself included."""
    e = table(spark, sf_dir, "embeddings")
    found = many.nearest(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)
    return found.select("query_id", "position", "chunk_id", F.round("score", 6).alias("score"))


def _chunks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("item_id"), "embedding")


def _vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding")


_KNN = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
 k AS (SELECT vec_id AS chunk_id, label AS item_id, greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], q)) AS score FROM embeddings, q)"""


@query(f"WITH {_KNN} SELECT chunk_id, item_id, round(score, 6) AS score FROM k ORDER BY k.score DESC, chunk_id LIMIT 20")
def knn_chunks(spark, sf_dir):
    return semantic.nearest(_chunks(spark, sf_dir), _vector(spark, sf_dir), 20).select("chunk_id", "item_id", F.round("score", 6).alias("score"))


_ITEMS = f"""{_KNN}, top AS (SELECT * FROM k ORDER BY score DESC, chunk_id LIMIT 32),
 items AS (SELECT item_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, CAST(chunk_id AS VARCHAR)) AS n FROM top) WHERE n = 1 ORDER BY score DESC, item_id LIMIT 8)"""


@query(f"WITH {_ITEMS} SELECT item_id, chunk_id, round(score, 6) AS score FROM items")
def knn_items(spark, sf_dir):
    return semantic.semantic_items(_chunks(spark, sf_dir), _vector(spark, sf_dir), 8).select("item_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_ITEMS} SELECT item_id, round(score, 6) AS score FROM items WHERE score >= 0.2 AND (SELECT max(score) FROM items) >= 0.45")
def semantic_floor(spark, sf_dir):
    items = semantic.semantic_items(_chunks(spark, sf_dir), _vector(spark, sf_dir), 8)
    return semantic.above_floor(items, items.limit(0), 0.2, 0.45).select("item_id", F.round("score", 6).alias("score"))


_HASH = "list_reduce(list_prepend(37, list_transform(range(1, strlen(gram) + 1), lambda i: ('0x' || substring(hex(encode(gram)), 2 * i - 1, 2))::INTEGER)), lambda h, b: (xor(h, b) * 179) & 255)"


@query(rf"""WITH p AS (SELECT p_partkey, lower(p_name) AS low FROM part),
 g AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(low,'\s+'), lambda w: w <> '')) AS gram FROM p
  UNION ALL SELECT p_partkey, substring(low, i, n) FROM p, (VALUES (3),(4),(5)) t(n), range(1, 200) r(i) WHERE i <= length(low) - n + 1)
 SELECT p_partkey, CAST({_HASH} AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL""")
def hash_embed_buckets(spark, sf_dir):
    return semantic.bucket_counts(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(rf"""WITH p AS (SELECT p_partkey, lower(p_name) AS low FROM part),
 g AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(low,'\s+'), lambda w: w <> '')) AS gram FROM p
  UNION ALL SELECT p_partkey, substring(low, i, n) FROM p, (VALUES (3),(4),(5)) t(n), range(1, 200) r(i) WHERE i <= length(low) - n + 1),
 b AS (SELECT p_partkey, CAST({_HASH} AS INTEGER) AS bucket, count(*) AS n FROM g GROUP BY ALL)
 SELECT p_partkey, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)), 5) AS value FROM b""")
def hash_embedding_values(spark, sf_dir):
    """The unit vectors themselves, where they aren't zero."""
    e = semantic.hash_embeddings(table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return e.select("p_partkey", F.posexplode("embedding").alias("bucket", "value")).where("value > 0").select("p_partkey", "bucket", F.round(F.col("value").cast("double"), 5).alias("value"))


_RANKS = f"""{_SCORES}, lex AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM (SELECT * FROM scores ORDER BY score DESC, item_id LIMIT 30)),
 {_KNN}, sem AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM (SELECT chunk_id AS item_id, score FROM k ORDER BY score DESC, chunk_id LIMIT 30))"""


def _tiers(spark, sf_dir):
    lex = lexical.search(_index(spark, sf_dir), QUESTION, 30)
    e = _chunks(spark, sf_dir).withColumn("item_id", F.col("chunk_id"))
    sem = semantic.nearest(e, _vector(spark, sf_dir), 30).select("item_id", "score")
    return [semantic.ranks(lex, "lexical"), semantic.ranks(sem, "semantic")]


@query(f"""WITH {_RANKS} SELECT coalesce(l.item_id, s.item_id) AS item_id, CAST(l.rank AS INTEGER) AS lexical_rank, CAST(s.rank AS INTEGER) AS semantic_rank, round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS score
 FROM lex l FULL OUTER JOIN sem s ON l.item_id = s.item_id ORDER BY coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) DESC, 1 LIMIT 20""")
def rrf_fuse(spark, sf_dir):
    return fusion.fuse(_tiers(spark, sf_dir), 20).select("item_id", "lexical_rank", "semantic_rank", F.round("score", 9).alias("score"))


@query(f"WITH {_RANKS} SELECT (SELECT item_id FROM lex WHERE rank = 1) AS lexical_first, (SELECT item_id FROM sem WHERE rank = 1) AS semantic_first, coalesce((SELECT item_id FROM lex WHERE rank = 1) <> (SELECT item_id FROM sem WHERE rank = 1), false) AS rerank")
def rerank_gate(spark, sf_dir):
    return fusion.disagree(fusion.fuse(_tiers(spark, sf_dir), 60))


# Graphs


def _trade_edges(spark, sf_dir):
    """A graph of suppliers, nations and regions, and back from regions to their first nation."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    a = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src_id"), F.concat(F.lit("n"), "s_nationkey").alias("dst_id"))
    b = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src_id"), F.concat(F.lit("r"), "n_regionkey").alias("dst_id"))
    c = n.where("n_regionkey < 3").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k")).select(F.concat(F.lit("r"), "n_regionkey").alias("src_id"), F.concat(F.lit("n"), "k").alias("dst_id"))
    return a.union(b).union(c)


_EDGES = """edges AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION SELECT 'r' || n_regionkey, 'n' || min(n_nationkey) FROM nation WHERE n_regionkey < 3 GROUP BY n_regionkey),
 nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src)"""


def _rank_sql(rounds: int) -> str:
    steps = [f"tele AS (SELECT id, CASE WHEN id = 's1' THEN 2.0/3 WHEN id = 's2' THEN 1.0/3 ELSE 0.0 END AS t FROM nodes)", "r0 AS (SELECT id, t AS score FROM tele)"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT t.id, coalesce(g.got, 0) + t.t * (0.15 + 0.85 * (SELECT coalesce(sum(score), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM deg))) AS score
 FROM tele t LEFT JOIN (SELECT e.dst, sum(0.85 * r.score / d.d) AS got FROM edges e JOIN r{i} r ON r.id = e.src JOIN deg d ON d.src = e.src GROUP BY e.dst) g ON g.dst = t.id)""")
    return f"WITH {_EDGES}, {', '.join(steps)} SELECT id AS item_id, round(score, 6) AS score FROM r{rounds} WHERE score > 0"


def _seeds(spark):
    return spark.createDataFrame([("s1",), ("s1",), ("s2",), ("nowhere",)], "item_id string")


@query(_rank_sql(graph.ROUNDS).replace("round(score, 6)", "round(score, 4)").replace("WHERE score > 0", f"WHERE score > {graph.EPSILON} / (SELECT count(*) FROM nodes)"))
def ppr_seeded(spark, sf_dir):
    return graph.pagerank(_trade_edges(spark, sf_dir), _seeds(spark)).select("item_id", F.round("score", 4).alias("score"))


@query(_rank_sql(6))
def ppr_pushed(spark, sf_dir):
    """By forward push over stored links: all residuals of six rounds."""
    path = cells.shared_folder(spark, "links")
    push.store_links(_trade_edges(spark, sf_dir), path, 8)
    return push.pagerank(spark, path, _seeds(spark), rounds=6, epsilon=0.0, least=0.0).select("item_id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_EDGES}, walk(a, b) AS (SELECT src, dst FROM edges UNION SELECT w.a, e.dst FROM walk w JOIN edges e ON e.src = w.b), ring AS (SELECT a FROM walk WHERE a = b)
 SELECT DISTINCT i.b AS item_id FROM walk i JOIN walk o ON o.a = i.b WHERE i.a IN (SELECT a FROM ring) AND o.b IN (SELECT a FROM ring)""")
def graph_core(spark, sf_dir):
    return graph_paths.core(_trade_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, walk(a, b) AS (SELECT src, dst FROM edges UNION SELECT w.a, e.dst FROM walk w JOIN edges e ON e.src = w.b), ring AS (SELECT a FROM walk WHERE a = b),
 c AS (SELECT DISTINCT i.b AS id FROM walk i JOIN walk o ON o.a = i.b WHERE i.a IN (SELECT a FROM ring) AND o.b IN (SELECT a FROM ring)),
 step AS (SELECT src, min(dst) AS dst FROM edges WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c) GROUP BY src),
 go(a, b) AS (SELECT src, dst FROM step UNION SELECT g.a, s.dst FROM go g JOIN step s ON s.src = g.b), first AS (SELECT min(a) AS id FROM go WHERE a = b),
 path(position, id) AS (SELECT CAST(0 AS BIGINT), id FROM first UNION ALL SELECT position + 1, s.dst FROM path p JOIN step s ON s.src = p.id WHERE s.dst <> (SELECT id FROM first))
 SELECT position, id AS item_id FROM path""")
def graph_cycle(spark, sf_dir):
    """One cycle, its smallest node first."""
    return graph_paths.cycle(_trade_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, reach(id, depth) AS (SELECT 's1', 0 UNION SELECT e.dst, depth + 1 FROM reach r JOIN edges e ON e.src = r.id WHERE depth < 40)
 SELECT id AS item_id, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY id""")
def closure_downstream(spark, sf_dir):
    return graph.closure(_trade_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "item_id string"))


_ACYCLIC = "edges AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem), nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"


def _order_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src_id"), F.concat(F.lit("o"), "o_orderkey").alias("dst_id"))
    p = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src_id"), F.concat(F.lit("p"), "l_partkey").alias("dst_id"))
    return o.union(p)


@query(f"""WITH RECURSIVE {_ACYCLIC}, walk(id, d) AS (SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, d + 1 FROM walk w JOIN edges e ON e.src = w.id)
 SELECT id AS item_id, CAST(max(d) AS INTEGER) AS layer FROM walk GROUP BY id""")
def topological_layers(spark, sf_dir):
    return graph.layers(_order_edges(spark, sf_dir))


@query("SELECT src_id, dst_id, string_agg(edge_type, ',' ORDER BY edge_type) AS edge_types FROM (SELECT DISTINCT l_orderkey AS src_id, l_suppkey AS dst_id, l_returnflag AS edge_type FROM lineitem) GROUP BY ALL")
def edge_type_labels(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"), F.col("l_returnflag").alias("edge_type"))
    return graph.edge_labels(e)


@query("""WITH cites AS (SELECT DISTINCT o_custkey AS page_id, o_orderpriority AS source_id FROM orders), home AS (SELECT c_mktsegment AS seg, c_custkey AS page_id FROM customer),
 pages AS (SELECT c_custkey AS page_id, CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-HIGH' WHEN 'AUTOMOBILE' THEN '3-MEDIUM' END AS source_id FROM customer),
 first AS (SELECT source_id, min(page_id) AS dst FROM pages WHERE source_id IS NOT NULL GROUP BY source_id)
 SELECT page_id AS src_id, dst AS dst_id, 'cites' AS edge_type FROM cites JOIN first USING (source_id) WHERE page_id <> dst
 UNION SELECT DISTINCT o_custkey, o_orderkey % 2000, 'links' FROM orders WHERE o_orderkey % 2000 IN (SELECT page_id FROM pages) AND o_custkey <> o_orderkey % 2000""")
def citation_graph(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    seg = F.col("c_mktsegment")
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.when(seg == "BUILDING", "1-URGENT").when(seg == "MACHINERY", "2-HIGH").when(seg == "AUTOMOBILE", "3-MEDIUM").alias("source_id"))
    cites = o.select(F.col("o_custkey").alias("page_id"), F.col("o_orderpriority").alias("source_id")).distinct()
    links = o.select(F.col("o_custkey").alias("page_id"), (F.col("o_orderkey") % 2000).alias("target"))
    return graph.citation_edges(cites, pages, links)


# Incremental state


def _old_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("node_id"), F.col("o_orderstatus").alias("hash"))
    new = o.where("o_orderkey % 10 != 3").select(F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("hash"))
    return rows.where("node_id % 11 != 5"), new


_OLD_NEW = "old AS (SELECT o_orderkey AS node_id, o_orderstatus AS hash FROM orders WHERE o_orderkey % 11 <> 5), new AS (SELECT o_orderkey AS node_id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 10 <> 3)"


@query(f"WITH {_OLD_NEW} SELECT node_id, hash, 'insert' AS change FROM (FROM new EXCEPT ALL FROM old) UNION ALL SELECT node_id, hash, 'delete' FROM (FROM old EXCEPT ALL FROM new)")
def edge_delta(spark, sf_dir):
    return state.delta(*_old_new(spark, sf_dir))


_CHANGED = f"{_OLD_NEW}, ch AS (SELECT node_id, CASE WHEN old.hash IS NULL THEN 'new' WHEN new.hash IS NULL THEN 'deleted' ELSE 'changed' END AS kind FROM old FULL OUTER JOIN new USING (node_id) WHERE old.hash IS DISTINCT FROM new.hash)"


@query(f"WITH {_CHANGED} SELECT node_id, kind FROM ch")
def changed_nodes(spark, sf_dir):
    return state.changed(*_old_new(spark, sf_dir))


@query(f"""WITH {_CHANGED}, dep AS (SELECT DISTINCT l_orderkey AS dep_id, 10000000 + l_partkey AS node_id FROM lineitem UNION SELECT DISTINCT 10000000 + l_partkey, 20000000 + l_suppkey FROM lineitem),
 one AS (SELECT DISTINCT d.node_id FROM dep d JOIN ch ON ch.node_id = d.dep_id), two AS (SELECT DISTINCT d.node_id FROM dep d JOIN one ON one.node_id = d.dep_id)
 SELECT node_id AS item_id, 0 AS depth FROM ch UNION ALL SELECT node_id, 1 FROM one UNION ALL SELECT node_id, 2 FROM two""")
def stale_propagation(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    part, supp = F.col("l_partkey") + 10000000, F.col("l_suppkey") + 20000000
    depends = l.select(part.alias("node_id"), F.col("l_orderkey").alias("dep_id")).union(l.select(supp.alias("node_id"), part.alias("dep_id"))).distinct()
    return state.stale(*_old_new(spark, sf_dir), depends)


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'new_source' WHEN d.doc_id % 3 = 1 THEN 'new_revision' ELSE 'skipped' END AS outcome FROM documents d""")
def ingest_outcomes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("content_hash"))
    known = d.where("doc_id % 3 != 0")
    revisions = known.select("doc_id", F.when(F.col("doc_id") % 3 == 1, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return state.ingest_outcome(d, known, revisions).select("doc_id", "outcome")


@query("SELECT min(doc_id) AS first_id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def content_copies(spark, sf_dir):
    return state.copies(table(spark, sf_dir, "documents")).select("first_id", "n")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'run' ELSE 'skip' END AS decision FROM documents")
def explain_compile(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    keys = state.stage_keys(d, "template", "model")
    stored = state.stage_keys(d.where("doc_id % 8 != 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text")), "template", "model")
    return state.explain_stages(keys, stored)


@query("""WITH live AS (SELECT vec_id AS chunk_id, label AS item_id, vec_id % 13 AS h FROM embeddings WHERE vec_id % 17 <> 2), stored AS (SELECT vec_id AS chunk_id, label AS item_id, CASE WHEN label = 3 THEN -1 ELSE vec_id % 13 END AS h FROM embeddings WHERE label <> 5)
 SELECT (SELECT count(*) FROM stored) AS stored_chunks, (SELECT count(DISTINCT coalesce(l.item_id, s.item_id)) FROM live l FULL OUTER JOIN stored s USING (chunk_id) WHERE l.h IS DISTINCT FROM s.h) AS stale_items""")
def semantic_index_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("item_id"), (F.col("vec_id") % 13).alias("content_hash"))
    stored = e.where("item_id != 5").withColumn("content_hash", F.when(F.col("item_id") == 3, -1).otherwise(F.col("content_hash")))
    return state.index_stats(e.where("chunk_id % 17 != 2"), stored)


@query("SELECT CASE WHEN vec_id % 9 = 4 THEN 'broken' || vec_id ELSE 'i' || label || '#' || vec_id END AS chunk_id FROM embeddings WHERE vec_id % 9 = 4 OR vec_id % 5 = 2")
def chunks_retired(spark, sf_dir):
    """Stored chunks that aren't live any more, and those whose ids are no ids of chunks."""
    stored = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CASE WHEN vec_id % 9 = 4 THEN 'broken' || vec_id ELSE 'i' || label || '#' || vec_id END AS chunk_id")
    return state.retire_chunks(stored, stored.where("vec_id % 5 != 2")).select("chunk_id")


@query("SELECT item_id, CAST(r AS INTEGER) AS place FROM (SELECT c_custkey AS item_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 30 UNION ALL SELECT -1, 31")
def seeds_in_order(spark, sf_dir):
    """What two tiers found, the first tier's first, each once."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank")).where("rank <= 30")
    other = c.where("rank <= 5").union(spark.createDataFrame([(-1, 9)], "item_id long, rank int"))
    return retrieve.seeds([c, other])


@query("""WITH p AS (SELECT l_orderkey AS page_id, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY l_orderkey)
 SELECT page_id, CASE WHEN len(s) = 1 THEN 'delete' ELSE 'scrub' END AS action, CAST(len(s) - 1 AS INTEGER) AS left_over FROM p WHERE list_contains(s, 7)""")
def forget_cascade(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("source_ids"))
    return state.forget_plan(pages, F.lit(7).cast("long")).select("page_id", "action", F.size("remaining").alias("left_over"))


# Mining


_WORD_SPLIT = r"string_split(trim(regexp_replace(regexp_replace(text,'([^\p{L}\p{N}\s_/''-])',' \1 ','g'),'\s+',' ','g')),' ')"
_PHRASES = rf"""tok AS (SELECT doc_id, pos, token, regexp_replace(token,'^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$','','g') AS word FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {_WORD_SPLIT} AS w FROM documents))),
 cut AS (SELECT *, (regexp_replace(word,'[^\p{{L}}\p{{N}}]','','g') = '' OR list_contains({_list(sorted(set(PHRASE_STOPWORDS)))}, lower(word)) OR list_contains({_list(sorted(set(PHRASE_STOPWORDS)))}, lower(token)) OR regexp_matches(word,'^[0-9.]+$')) AS c FROM tok),
 num AS (SELECT *, sum(c::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS ph FROM cut), runs AS (SELECT doc_id, ph, list(word ORDER BY pos) AS words FROM num WHERE NOT c GROUP BY ALL),
 ws AS (SELECT doc_id, ph, words, unnest(words) AS w FROM runs), sc AS (SELECT doc_id, lower(w) AS w, sum(len(words))::DOUBLE / count(*) AS s FROM ws GROUP BY ALL),
 scored AS (SELECT ws.doc_id, ph, array_to_string(words, ' ') AS name, sum(s) AS s FROM ws JOIN sc ON sc.doc_id = ws.doc_id AND sc.w = lower(ws.w) WHERE len(words) BETWEEN 2 AND 4 GROUP BY ALL),
 found AS (SELECT doc_id, lower(name) AS k, sum(s) AS score, arg_min(name, ph) AS phrase FROM scored GROUP BY ALL),
 best AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase) AS rank, phrase, score FROM found QUALIFY rank <= 8)"""


@query(f"WITH {_PHRASES} SELECT doc_id, CAST(rank AS INTEGER) AS rank, phrase, round(score, 6) AS score FROM best")
def rake_phrases(spark, sf_dir):
    return mining.key_phrases(table(spark, sf_dir, "documents")).select("doc_id", "rank", "phrase", F.round("score", 6).alias("score"))


@query(f"WITH {_PHRASES} SELECT phrase, count(DISTINCT doc_id) AS sources, count(*) AS mentions FROM best GROUP BY phrase HAVING count(*) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 24")
def rake_corpus(spark, sf_dir):
    return mining.corpus_phrases(table(spark, sf_dir, "documents"))


_STOP = _list(sorted(set(CONCEPT_STOPWORDS)))


@query(rf"""WITH raw AS (SELECT doc_id, unnest(regexp_extract_all(text,'\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){{1,3}}\b')) AS raw FROM (SELECT doc_id, unnest(regexp_split_to_array(text,'\n\s*\n')) AS text FROM documents)),
 w AS (SELECT doc_id, string_split(regexp_replace(raw,'\s+',' ','g'),' ') AS w FROM raw),
 k AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_STOP}, lower(w[i]))) AS keep FROM w),
 t AS (SELECT doc_id, array_to_string(w[keep[1]:keep[-1]], ' ') AS term FROM k WHERE len(keep) > 0 AND keep[-1] - keep[1] >= 1)
 SELECT lower(term) AS key, count(DISTINCT doc_id) AS sources, count(*) AS mentions FROM t WHERE strlen(term) BETWEEN 3 AND 80 AND lower(term) NOT IN (SELECT lower(p_name) FROM part) GROUP BY lower(term) HAVING count(DISTINCT doc_id) >= 3 AND count(*) >= 5""")
def missing_concepts(spark, sf_dir):
    existing = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return mining.missing_terms(table(spark, sf_dir, "documents"), existing).select(F.lower("name").alias("key"), "sources", "mentions")


_BIGRAM = """n AS (SELECT min(p_partkey) AS id, lower(trim(p_name)) || ' ' || lower(trim(p_type)) AS low FROM part GROUP BY 2),
 g AS (SELECT id, substring(low, i, 2) AS g, count(*) AS c FROM n, range(1, 200) r(i) WHERE i < length(low) GROUP BY ALL), s AS (SELECT id, sum(c) AS n FROM g GROUP BY id)"""


@query(f"WITH {_BIGRAM} SELECT a.id AS a, b.id AS b, round(2.0 * sum(least(a.c, b.c)) / (any_value(sa.n) + any_value(sb.n)), 6) AS similarity FROM g a JOIN g b ON a.g = b.g AND a.id < b.id JOIN s sa ON sa.id = a.id JOIN s sb ON sb.id = b.id GROUP BY a.id, b.id HAVING 2.0 * sum(least(a.c, b.c)) / (any_value(sa.n) + any_value(sb.n)) >= 0.85")
def near_duplicate_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lower(F.trim("p_name")), F.lit(" "), F.lower(F.trim("p_type"))).alias("name"), "p_partkey")
    names = p.groupBy("name").agg(F.min("p_partkey").alias("id")).select("id", "name", F.lit(None).cast("string").alias("definition"))
    return mining.near_names(names).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(r"""WITH n AS (SELECT item_id, lower(array_to_string(string_split(text,' ')[2:3],' ')) AS name FROM benchmark),
 w AS (SELECT item_id, list_filter(regexp_split_to_array(name,'[^\p{L}\p{N}_]+'), lambda x: x <> '') AS want FROM n),
 d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text),'[^\p{L}\p{N}_]+'), lambda x: x <> ''),' ') || ' ' AS body FROM documents)
 SELECT item_id AS concept_id, doc_id AS source_id FROM w, d WHERE contains(body, ' ' || array_to_string(want, ' ') || ' ')""")
def mention_backlinks(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("concept_id"), F.array(F.array_join(F.slice(F.split("text", " "), 2, 2), " ")).alias("names"))
    return mining.mentions(names, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@query("""SELECT category, CAST(row_number() OVER (ORDER BY key = 'uncategorized', key) AS INTEGER) AS position, n FROM (SELECT lower(coalesce(c, 'Uncategorized')) AS key, arg_min(coalesce(c, 'Uncategorized'), c_custkey) AS category, count(*) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c FROM customer) GROUP BY 1)""")
def category_pages(spark, sf_dir):
    seg, key = F.col("c_mktsegment"), F.col("c_custkey")
    return mining.category_index(table(spark, sf_dir, "customer").select(key.alias("page_id"), F.when(key % 5 == 0, None).when(key % 2 == 0, F.lower(seg)).otherwise(seg).alias("category")))


@query("""WITH s AS (SELECT 0 AS stream, p_brand AS name, count(*) AS sources FROM part GROUP BY p_brand UNION ALL SELECT 1, lower(p_brand), 1000 FROM part GROUP BY 2 UNION ALL SELECT 1, p_type, count(*) FROM part GROUP BY p_type)
 SELECT name, sources, stream FROM (SELECT *, row_number() OVER (PARTITION BY translate(regexp_replace(regexp_replace(name,'[^\\p{L}\\p{N}]+','-','g'),'^-+|-+$','','g'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') ORDER BY stream, sources DESC, name) AS n FROM s) WHERE n = 1""")
def merge_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("sources"))
    b = p.select(F.lower("p_brand").alias("name")).distinct().withColumn("sources", F.lit(1000).cast("long")).unionByName(p.groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("sources")))
    return mining.merge_candidates([a, b]).select("name", "sources", "stream")


# Verification


_FORM = r"trim(regexp_replace(lower(translate({x},'*_`','')),'\s+',' ','g'))"


@query(f"SELECT item_id, doc_id FROM (SELECT item_id, {_FORM.format(x='text')} AS q FROM benchmark) b, (SELECT doc_id, {_FORM.format(x='text')} AS s FROM documents) d WHERE contains(s, q)")
def quotes_found(spark, sf_dir):
    """Quotations are few and meet every document in one pass."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    found = verify.find_quotes(quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))
    return found.select(F.col("quote_id").alias("item_id"), F.col("source_id").alias("doc_id"))


_VERIFIED = f"""q AS (SELECT item_id, item_id % 5 AS k, CASE item_id % 5 WHEN 1 THEN 'zzz ' || text WHEN 2 THEN substring(text, 1, 90) || 'qqq' ELSE text END AS quote FROM benchmark), s AS (SELECT item_id AS source_id, '<p>“' || text || '”  *x*' AS text FROM benchmark WHERE item_id % 5 <> 3),
 j AS (SELECT q.*, s.text, {_FORM.format(x='q.quote')} AS a, {_FORM.format(x='s.text')} AS b FROM q LEFT JOIN s ON s.source_id = q.item_id)"""


@query(f"WITH {_VERIFIED} SELECT item_id AS page_id, CASE WHEN text IS NULL THEN 'source_missing' WHEN contains(b, a) THEN 'exact' ELSE 'absent' END AS status FROM j WHERE text IS NULL OR contains(b, a) OR length(a) < 100")
def quotes_verified(spark, sf_dir):
    """Quotations with their sources: some changed, some without a source. Long changed ones, which may be found with edits, are left to quotes_fuzzy."""
    b, k, x = table(spark, sf_dir, "benchmark"), F.col("item_id") % 5, F.col("text")
    quote = F.when(k == 1, F.concat(F.lit("zzz "), x)).when(k == 2, F.concat(F.substring(x, 1, 90), F.lit("qqq"))).otherwise(x)
    sources = b.where("item_id % 5 != 3").select(F.col("item_id").alias("source_id"), F.concat(F.lit("<p>“"), "text", F.lit("”  *x*")).alias("text"))
    done = verify.verify_quotes(b.select(F.col("item_id").alias("page_id"), quote.alias("quote"), F.col("item_id").alias("source_id")), sources)
    return done.where((F.col("status") != "fuzzy") & ((F.col("status") != "absent") | (F.length(T.match_form(F.col("quote"))) < 100))).select("page_id", "status")


@query(None)
def quotes_fuzzy(spark, sf_dir):
    """Benchmark passages with a letter changed, against the documents that hold a passage."""
    held = QUERIES["quotes_found"](spark, sf_dir).groupBy("item_id").agg(F.min("doc_id").alias("source_id"))
    b = table(spark, sf_dir, "benchmark").join(held, "item_id").select(F.col("item_id").alias("page_id"), F.concat(F.substring("text", 1, 20), F.lit("x"), F.substring("text", F.lit(22), F.length("text"))).alias("quote"), "source_id")
    sources = table(spark, sf_dir, "documents").join(held.select(F.col("source_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("source_id"), "text")
    return verify.verify_quotes(b, sources).select("page_id", "status", "edits")


@query("SELECT DISTINCT o_custkey AS page_id, o_orderkey % 700 AS source_id FROM orders WHERE o_orderkey % 700 NOT IN (SELECT s_suppkey FROM supplier) ")
def stale_references(spark, sf_dir):
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), (F.col("o_orderkey") % 700).alias("source_id"))
    return verify.stale_citations(cited, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id")))


@query("SELECT 'part/' || p_partkey AS source_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) AND NOT regexp_matches('part/' || p_partkey, '^part/1[^/]*$')")
def orphan_sources(spark, sf_dir):
    name = lambda c: F.concat(F.lit("part/"), c).alias("source_id")
    found = verify.orphan_sources(table(spark, sf_dir, "part").select(name("p_partkey")), table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(name("l_partkey")), ["none/**"])
    return found.where(~F.col("source_id").rlike("^part/1[^/]*$"))


@query("""WITH b AS (SELECT DISTINCT replace(p_name, 'e', 'o') AS target FROM part WHERE replace(p_name, 'e', 'o') NOT IN (SELECT p_name FROM part)), n AS (SELECT DISTINCT p_name AS name FROM part),
 d AS (SELECT target, name, levenshtein(target, name) AS e FROM b, n)
 SELECT target, arg_min(name, {'e': e, 'n': name}) AS suggestion, CAST(min(e) AS INTEGER) AS edits FROM d WHERE e <= greatest(3, floor(greatest(length(target), length(name)) / 2)) GROUP BY target""")
def broken_link_suggestions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    links = p.select(F.lit("index").alias("page_id"), F.replace("name", F.lit("e"), F.lit("o")).alias("target"), F.lit(None).cast("string").alias("anchor")).distinct()
    pages = p.select(F.col("name").alias("page_id")).distinct()
    broken = verify.missing_targets(links, pages, pages.select("page_id", F.lit("top").alias("anchor")))
    return nearest_names.suggestions(broken, p)


@query("""SELECT l_orderkey AS page_id, CASE max(CASE WHEN p.p_partkey IS NULL THEN 0 WHEN p.p_size > 40 THEN 1 WHEN l_linenumber <> p.p_size % 7 + 1 THEN 2 ELSE 3 END) WHEN 0 THEN 'orphan' WHEN 1 THEN 'revision_missing' WHEN 2 THEN 'stale' ELSE 'current' END AS state
 FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 6 <> 0) p ON p.p_partkey = l_partkey GROUP BY l_orderkey""")
def revision_states(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("revision_id"))
    p = table(spark, sf_dir, "part").where("p_partkey % 6 != 0")
    return verify.revision_state(pages, p.select(F.col("p_partkey").alias("doc_id")), p.where("p_size <= 40").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 7 + 1).alias("revision_id")))


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderkey % 9 = 4 THEN 'output_missing' WHEN o_custkey % 10 = 3 OR c_custkey IS NULL THEN 'record_missing' WHEN o_orderstatus <> CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END THEN 'fingerprint_mismatch' ELSE 'fine' END AS state FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def artifact_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    manifest = o.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("record_id"), F.col("o_orderstatus").alias("fingerprint"))
    records = table(spark, sf_dir, "customer").where("c_custkey % 10 != 3").select(F.col("c_custkey").alias("record_id"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("fingerprint"))
    return verify.artifact_state(manifest, records, o.where("o_orderkey % 9 != 4").select(F.col("o_orderkey").alias("path")))


@query("SELECT doc_id AS page_id, CAST(len(list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents WHERE len(list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w <> '')) < 12")
def thin_pages(spark, sf_dir):
    return verify.thin(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("body")))


# Evaluation


_EVAL = "r AS (SELECT d.source AS query_id, row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id) AS position, l.toxic = 1 OR l.doc_id % 7 = 0 AS relevant FROM labels l JOIN documents d USING (doc_id))"


def _ranked(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return rows.select(F.col("source").alias("query_id"), place.alias("position"), ((F.col("toxic") == 1) | (F.col("doc_id") % 7 == 0)).alias("relevant"))


_METRICS = f"""{_EVAL}, m AS (SELECT query_id, sum(CASE WHEN relevant AND position <= 10 THEN 1 ELSE 0 END) / 10.0 AS p, coalesce(1.0 / min(CASE WHEN relevant THEN position END), 0) AS mrr,
 sum(CASE WHEN relevant AND position <= 10 THEN 1 / log2(position + 1) ELSE 0 END) AS dcg, sum(relevant::INT) AS h FROM r GROUP BY query_id),
 e AS (SELECT query_id, p, mrr, CASE WHEN h = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(h, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) END AS ndcg FROM m)"""


@query(f"WITH {_METRICS} SELECT query_id, round(p, 6) AS precision_at_k, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg_at_k FROM e")
def eval_metrics(spark, sf_dir):
    m = evaluate.ranking_metrics(_ranked(spark, sf_dir), 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "mrr", "ndcg_at_k")])


@query(f"WITH {_METRICS} SELECT round(avg(p), 6) AS precision_at_k, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_k FROM e")
def eval_means(spark, sf_dir):
    m = evaluate.mean_metrics(evaluate.ranking_metrics(_ranked(spark, sf_dir), 10))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"WITH {_METRICS} SELECT coalesce(a.query_id, b.query_id) AS query_id, round(a.ndcg, 6) AS now, round(b.p, 6) AS before, round(a.ndcg - b.p, 6) AS change FROM (SELECT * FROM e WHERE query_id <> 'src3') a FULL OUTER JOIN (SELECT * FROM e WHERE query_id <> 'src5') b ON a.query_id = b.query_id")
def eval_compare(spark, sf_dir):
    m = evaluate.ranking_metrics(_ranked(spark, sf_dir), 10)
    c = evaluate.compare_runs(m.where("query_id != 'src3'"), m.where("query_id != 'src5'").withColumn("ndcg_at_k", F.col("precision_at_k")))
    return c.select("query_id", *[F.round(x, 6).alias(x) for x in ("now", "before", "change")])


@query("""WITH x AS (SELECT DISTINCT p_brand AS query_id, p_type AS title FROM part WHERE p_partkey % 3 = 0), f AS (SELECT DISTINCT p_brand AS query_id, lower('kind ' || p_type) AS found FROM part WHERE p_partkey % 3 = 1)
 SELECT query_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.query_id = x.query_id AND contains(f.found, lower(x.title))) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM x GROUP BY query_id""")
def eval_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    expected = p.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("query_id"), F.col("p_type").alias("title")).distinct()
    found = p.where("p_partkey % 3 = 1").select(F.col("p_brand").alias("query_id"), F.concat(F.lit("kind "), "p_type").alias("found"))
    return evaluate.coverage(expected, found).select("query_id", F.round("coverage", 6).alias("coverage"))


_ANSWERS = """a AS (SELECT user_id AS answer_id, sum((event_type = 'click')::INT) AS valid, sum((event_type = 'signup')::INT) AS invalid, count(*) % 5 AS manifest, user_id % 4 AS expected, least(user_id % 4, sum((event_type = 'view')::INT) % 4) AS cited, sum(value) > 500 AS banner, user_id % 2 = 0 AS should FROM events GROUP BY user_id),
 m AS (SELECT answer_id, CASE WHEN valid + invalid = 0 THEN CASE WHEN manifest = 0 THEN 1.0 ELSE 0.0 END ELSE valid / (valid + invalid) END AS p, CASE WHEN expected = 0 THEN 1.0 ELSE cited / expected END AS r, CASE WHEN valid + invalid = 0 THEN 0.0 ELSE invalid / (valid + invalid) END AS h, banner = should AS u FROM a)"""


def _answers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = lambda t: F.sum((F.col("event_type") == t).cast("int"))
    a = e.groupBy(F.col("user_id").alias("answer_id")).agg(n("click").alias("valid"), n("signup").alias("invalid"), (F.count("*") % 5).alias("manifest"), n("view").alias("views"), (F.sum("value") > 500).alias("banner"))
    a = a.withColumn("expected", F.col("answer_id") % 4).withColumn("cited_expected", F.least(F.col("answer_id") % 4, F.col("views") % 4)).withColumn("should_banner", F.col("answer_id") % 2 == 0)
    return evaluate.grounding(a)


@query(f"WITH {_ANSWERS} SELECT answer_id, round(p, 6) AS precision, round(r, 6) AS recall, round(h, 6) AS hallucination, CASE WHEN h > 0.25 THEN 'ungrounded' WHEN p >= 0.9 AND r >= 0.6 THEN 'strong' WHEN p >= 0.7 AND r >= 0.4 THEN 'acceptable' ELSE 'weak' END AS verdict FROM m")
def grounding_verdicts(spark, sf_dir):
    return _answers(spark, sf_dir).select("answer_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "hallucination")], "verdict")


@query(f"WITH {_ANSWERS} SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(h), 6) AS hallucination, round(avg(u::INT), 6) AS uncertainty_match, avg(p) >= 0.8 AND avg(r) >= 0.5 AND avg(h) <= 0.1 AND avg(u::INT) >= 0.8 AS passes FROM m")
def grounding_summary(spark, sf_dir):
    s = evaluate.grounding_summary(_answers(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "hallucination", "uncertainty_match")], "passes")


# Transcripts


def _segments(spark, sf_dir):
    """Events as segments of speech: users record, types speak."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    zero = F.min(start).over(Window.partitionBy("user_id"))
    return e.select(F.col("user_id").alias("rec"), seq.alias("seq"), ((start - zero) / 600).alias("start_s"), ((start - zero) / 600 + F.col("value") % 20).alias("end_s"), F.col("event_type").alias("text"))


_SEG = """s AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id)) / 600 AS start_s, value, event_type AS text FROM events),
 seg AS (SELECT rec, seq, start_s, start_s + fmod(value, 20) AS end_s, text FROM s)"""


@query(f"""WITH RECURSIVE {_SEG}, walk(rec, seq, speaker, a, b, turn) AS (SELECT rec, seq, text, CAST(trunc(start_s) AS INTEGER), CAST(trunc(greatest(end_s, start_s)) AS INTEGER), 0 FROM seg WHERE seq = 1
 UNION ALL SELECT s.rec, s.seq, s.text, CASE WHEN t.same THEN w.a ELSE CAST(trunc(s.start_s) AS INTEGER) END, CAST(trunc(greatest(s.end_s, s.start_s)) AS INTEGER), CASE WHEN t.same THEN w.turn ELSE w.turn + 1 END
  FROM walk w JOIN seg s ON s.rec = w.rec AND s.seq = w.seq + 1, LATERAL (SELECT s.text = w.speaker AND s.start_s - w.b < 10 AND greatest(s.end_s, s.start_s) - w.a < 300 AS same) t)
 SELECT rec, turn, any_value(speaker) AS speaker, min(a) AS start_s, arg_max(b, seq) AS end_s, string_agg(speaker, ' ' ORDER BY seq) AS text FROM walk GROUP BY rec, turn""")
def turns_merge(spark, sf_dir):
    return transcript.merge_turns(_segments(spark, sf_dir).withColumn("speaker", F.col("text")))


@query(f"WITH {_SEG}, t AS (SELECT rec, seq, CAST(floor(start_s) AS INTEGER) AS a, lag(CAST(floor(end_s) AS INTEGER)) OVER (PARTITION BY rec ORDER BY seq) AS b FROM seg) SELECT rec, CAST(seq AS INTEGER) AS turn, a - b AS pause_s FROM t WHERE a - b >= 5")
def turn_pauses(spark, sf_dir):
    t = _segments(spark, sf_dir).select("rec", F.col("seq").alias("turn"), F.floor("start_s").cast("int").alias("start_s"), F.floor("end_s").cast("int").alias("end_s"))
    return transcript.pauses(t)


@query(f"""WITH {_SEG}, i AS (SELECT rec, seq, text, seq - row_number() OVER (PARTITION BY rec, text ORDER BY seq) AS g FROM seg), n AS (SELECT *, count(*) OVER (PARTITION BY rec, text, g) AS c, row_number() OVER (PARTITION BY rec, text, g ORDER BY seq) AS k FROM i)
 SELECT rec, CAST(seq AS INTEGER) AS seq, text FROM n WHERE c < 2 OR k = 1""")
def runs_collapse(spark, sf_dir):
    return transcript.collapse_runs(_segments(spark, sf_dir).select("rec", "seq", "text"), 2)


@query(f"""WITH {_SEG}, v AS (SELECT rec, seq AS vseq, start_s AS vs, end_s - 0.5 * (end_s - start_s) AS ve, text AS speaker FROM seg WHERE seq % 3 = 0), a AS (SELECT rec, seq, (start_s + end_s) / 2 AS mid FROM seg),
 d AS (SELECT a.rec, a.seq, speaker, vseq, CASE WHEN mid BETWEEN vs AND ve THEN 0 ELSE 1 END AS o, CASE WHEN mid < vs THEN vs - mid WHEN mid > ve THEN mid - ve ELSE 0 END AS dist FROM a JOIN v ON v.rec = a.rec),
 b AS (SELECT rec, seq, arg_min(speaker, {{'o': o, 'd': CASE WHEN o = 0 THEN 0.0 ELSE dist END, 'v': vseq}}) AS speaker FROM d GROUP BY ALL)
 SELECT rec, CAST(seq AS INTEGER) AS seq, coalesce(speaker, format('speaker_unknown_{{:04d}}', seq)) AS speaker FROM seg LEFT JOIN b USING (rec, seq)""")
def speaker_nearest(spark, sf_dir):
    s = _segments(spark, sf_dir)
    v = s.where("seq % 3 = 0").select("rec", "seq", "start_s", (F.col("end_s") - 0.5 * (F.col("end_s") - F.col("start_s"))).alias("end_s"), F.col("text").alias("speaker"))
    return transcript.speakers(s.select("rec", "seq", "start_s", "end_s"), v).select("rec", "seq", "speaker")


_TWICE = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN repeat('a', 80) WHEN 2 THEN substring(text, 1, 50) || repeat('é', 40) || 'x' || repeat('é', 40) ELSE repeat('ab', 60) END"


@query(f"""WITH t AS (SELECT doc_id, hex(encode(coalesce({_TWICE}, ''))) AS h FROM documents)
 SELECT doc_id, length(h) >= 240 AND len(list_distinct(list_transform(range(0, greatest(0, length(h) // 2 - 59)), lambda i: substring(h, 2 * i + 1, 120)))) < length(h) // 2 - 59 AS repeats FROM t""")
def self_repetition(spark, sf_dir):
    """Windows of 60 bytes in texts of 120 bytes at least: 80 letters are too few, and 40 accented ones are a window and more."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TWICE} AS text").select("doc_id", transcript.repeats_itself(F.col("text")).alias("repeats"))


@query("SELECT source AS source_id, doc_id AS pos FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) ORDER BY r, source LIMIT 50")
def contradiction_quotes(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("pos"))
    return transcript.round_robin(q, 50).select("source_id", "pos")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3")
def last_turns(spark, sf_dir):
    return transcript.last_turns(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def job_page(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return transcript.page(e, [F.desc("ts"), F.col("event_id")], 2, 25).select("event_id", "event_type")


@query("SELECT event_type AS kind, count(*) AS n, CAST(greatest(0, 3000 - count(*)) AS BIGINT) AS pending FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return wiki.kind_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind")), 3000)


@query(None)
def voice_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("rec"), F.col("vec_id").alias("seq"), "embedding")
    return transcript.cluster_voices(e)


# Whole retrievals


def _pages(spark, sf_dir):
    """Pages as Markdown: a title, a section for each paragraph, a reference to a source."""
    p = table(spark, sf_dir, "pages")
    text = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<nav>.*?</nav>", " ")
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<p>(.*?)(?:</p>|<br>)"), 1), lambda x: T.html_text(x))
    body = F.concat(F.lit("# "), T.html_title(F.col("html")), F.lit("\n\n"), F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("## Part "), i, F.lit("\n\n"), x)), "\n\n"))
    return p.select(F.col("page_id").cast("string").alias("item_id"), body.alias("body"), T.html_title(F.col("html")).alias("summary"))


@query(None)
def chunk_pages(spark, sf_dir):
    return chunks.chunks(_pages(spark, sf_dir))


@query(None)
def hybrid_search(spark, sf_dir):
    edges = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 500).alias("src_id"), F.pmod(F.col("vec_id") * 7 + 3, F.lit(500)).alias("dst_id"))
    e = _chunks(spark, sf_dir).withColumn("item_id", F.col("chunk_id"))
    return retrieve.hybrid_search(_index(spark, sf_dir), e, QUESTION, _vector(spark, sf_dir), edges, 10, rerank=True).drop("rerank")


_HYBRID = 9000


@query(f"""WITH RECURSIVE {_plan_sql(_HYBRID)}, {_KNN}, top AS (SELECT chunk_id AS item_id, score FROM k ORDER BY score DESC, chunk_id LIMIT 100), near AS (SELECT * FROM top ORDER BY score DESC, item_id LIMIT 25),
 sem AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM near WHERE score >= 0.05 AND ((SELECT count(*) FROM planned) > 0 OR (SELECT max(score) FROM near) >= 0.45)),
 tail AS (SELECT s.item_id, {_ENTRY} AS tokens, row_number() OVER (ORDER BY s.score DESC, s.item_id) AS pos FROM sem s JOIN documents d ON d.doc_id = s.item_id WHERE s.item_id NOT IN (SELECT item_id FROM planned)),
 go(pos, item_id, tokens, used, takes) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST((SELECT coalesce(sum(tokens), 0) FROM planned) AS BIGINT), false
  UNION ALL SELECT t.pos, t.item_id, t.tokens, g.used + CASE WHEN g.used + t.tokens <= {_HYBRID} THEN t.tokens ELSE 0 END, g.used + t.tokens <= {_HYBRID} FROM go g JOIN tail t ON t.pos = g.pos + 1),
 members AS (SELECT item_id, tokens, position AS lexical_rank FROM planned UNION ALL SELECT item_id, tokens, NULL FROM go WHERE takes)
 SELECT m.item_id, m.tokens, m.lexical_rank, CAST(s.rank AS INTEGER) AS semantic_rank, round(coalesce(1.0 / (60 + m.lexical_rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS score FROM members m LEFT JOIN sem s ON s.item_id = m.item_id""")
def hybrid_plan(spark, sf_dir):
    """The floor is low, so that a tail of semantic hits meets the budget: what doesn't fit is passed over."""
    e = _chunks(spark, sf_dir).withColumn("item_id", F.col("chunk_id"))
    found = retrieve.hybrid_plan(_index(spark, sf_dir), e, QUESTION, _vector(spark, sf_dir), None, _HYBRID, (0.05, 0.45))
    return found.select("item_id", "tokens", "lexical_rank", "semantic_rank", F.round("score", 9).alias("score"))


@query(None)
def context_assembly(spark, sf_dir):
    pages = cells.stored(_pages(spark, sf_dir), "pages")
    index = pages.select("item_id", F.col("summary").alias("title"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("headings"), F.col("body").alias("summary"))
    planned = graph.settle(lexical.plan(index, QUESTION, 8000))
    pages = pages.join(F.broadcast(planned.select("item_id")), "item_id", "left_semi")  # broadcast: the candidates of a plan; no other page is cut
    found = chunks.sections(pages, "item_id").withColumnRenamed("page_id", "item_id")
    return retrieve.assemble(planned, pages, found, QUESTION, 4000)


@query(r"""WITH a AS (SELECT conv_id * 100 + turn AS answer_id, text || ' See [' || (turn + 1) || '] and [' || (conv_id % 9) || '], [' || (turn + 1) || '].' AS t FROM conversations),
 n AS (SELECT answer_id, list_transform(regexp_extract_all(t,'\[(\d{1,6})\]',1), lambda x: x::INT) AS n FROM a), d AS (SELECT answer_id, list_distinct(n) AS n FROM n), v AS (SELECT answer_id, len(list_filter(n, lambda x: x BETWEEN 1 AND 4)) AS valid, len(list_filter(n, lambda x: x NOT BETWEEN 1 AND 4)) AS invalid FROM d)
 SELECT answer_id, CAST(valid AS INTEGER) AS valid, CAST(invalid AS INTEGER) AS invalid, valid = 0 OR invalid > valid AS banner FROM v""")
def answer_citations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.lit(" See ["), F.col("turn") + 1, F.lit("] and ["), F.col("conv_id") % 9, F.lit("], ["), F.col("turn") + 1, F.lit("]."))
    done = retrieve.postprocess(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), text.alias("answer")), F.lit(4))
    return done.select("answer_id", F.size("valid").alias("valid"), F.size("invalid").alias("invalid"), "banner")


@query("SELECT c_custkey AS page_id FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment || '/' || c_custkey = 'MACHINERY/12'")
def published_pages(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_mktsegment", "c_custkey").alias("page_id"), "c_custkey")
    return verify.published(c, ["BUILDING/**", "MACHINERY/12"]).select(F.col("c_custkey").alias("page_id"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


# Pages and admin


@query("""WITH k AS (SELECT 'src-' || lower(c_mktsegment) || '-' || c_custkey AS id, 'source' AS kind, 0 AS rank FROM customer UNION ALL SELECT 'src-machinery-' || s_suppkey || 'x', 'concept', 1 FROM supplier),
 w AS (SELECT DISTINCT 'src-' || lower(c_mktsegment) || '-' || (c_custkey % 90) AS input FROM customer UNION SELECT 'q-none'),
 p AS (SELECT input, kind, rank, count(*) AS n, min(id) AS id, max((id = input)::INT) AS exact, max(CASE WHEN id = input THEN id END) AS same FROM w JOIN k ON starts_with(k.id, w.input) GROUP BY ALL),
 f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY input ORDER BY rank) = 1)
 SELECT w.input, kind, CASE WHEN exact = 1 OR n = 1 THEN coalesce(same, id) END AS id, CASE WHEN f.input IS NULL THEN 'missing' WHEN exact = 1 OR n = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM w LEFT JOIN f USING (input)""")
def id_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = lambda n: F.concat(F.lit("src-"), F.lower("c_mktsegment"), F.lit("-"), n)
    known = c.select(name(F.col("c_custkey")).alias("id"), F.lit("source").alias("kind"), F.lit(0).alias("rank"))
    known = known.union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("src-machinery-"), "s_suppkey", F.lit("x")), F.lit("concept"), F.lit(1)))
    wanted = c.select(name(F.col("c_custkey") % 90).alias("input")).union(spark.createDataFrame([("q-none",)], "input string")).distinct()
    return wiki.resolve_ids(wanted, known)


@query("""WITH c AS (SELECT p_brand || '/' || p_type AS concept_id, p_brand AS canonical_id, list(DISTINCT p_name) AS a, list(DISTINCT p_size) AS s FROM part GROUP BY ALL)
 SELECT canonical_id AS concept_id, CAST(len(list_distinct(flatten(list(a)))) AS INTEGER) AS aliases, CAST(len(list_distinct(flatten(list(s)))) AS INTEGER) AS sources, CAST(count(*) AS INTEGER) AS members FROM c GROUP BY canonical_id""")
def concept_merge(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("concept_id"), "p_brand").agg(F.collect_set("p_name").alias("aliases"), F.collect_set("p_size").alias("source_ids"))
    merged = wiki.merge_concepts(c.drop("p_brand"), c.select("concept_id", F.col("p_brand").alias("canonical_id")))
    return merged.select("concept_id", F.size("aliases").alias("aliases"), F.size("source_ids").alias("sources"), "members")


@query("SELECT event_id AS job_id, event_type AS status FROM events WHERE event_type IN ('click', 'purchase') ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def jobs_list(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("started"))
    return wiki.jobs(runs, ["click", "purchase"], 3, 20).select("job_id", "status")


@query("SELECT event_id AS job_id FROM events WHERE event_type NOT IN ('running', 'queued') AND ts < TIMESTAMP '2024-01-10'")
def jobs_prune(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("started"))
    return wiki.jobs_to_prune(runs, F.lit("2024-01-10").cast("timestamp_ntz"))


@query("SELECT 'conv-' || conv_id AS session_id, count(*) AS turns, max(turn) AS last FROM conversations GROUP BY conv_id")
def session_list(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("session_id"), "turn", F.col("turn").alias("at"))
    return wiki.sessions(c)


@query("""WITH cited AS (SELECT DISTINCT o_custkey AS concept_id, o_orderpriority || '-' || (o_custkey % 500) AS anchor FROM orders), anchors AS (SELECT DISTINCT o_orderpriority || '-' || (o_orderkey % 500) AS anchor, o_orderkey AS doc_id FROM orders),
 allowed AS (SELECT DISTINCT o_custkey AS concept_id, o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'P'), homes AS (SELECT o_orderkey AS doc_id, 'page-' || o_custkey AS page_id FROM orders)
 SELECT DISTINCT concept_id, page_id FROM (SELECT c.concept_id, a.doc_id FROM cited c JOIN anchors a USING (anchor) WHERE c.concept_id NOT IN (SELECT concept_id FROM allowed) UNION SELECT * FROM allowed) JOIN homes USING (doc_id)""")
def anchor_backlinks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    concept, doc = F.col("o_custkey").alias("concept_id"), F.col("o_orderkey").alias("doc_id")
    anchor = lambda key: F.concat("o_orderpriority", F.lit("-"), F.col(key) % 500).alias("anchor")
    return wiki.anchor_backlinks(o.select(concept, anchor("o_custkey")).distinct(), o.select(anchor("o_orderkey"), doc).distinct(), o.select(doc, F.concat(F.lit("page-"), "o_custkey").alias("page_id")), o.where("o_orderstatus = 'P'").select(concept, doc).distinct())


@query("SELECT source_id, stable_location FROM (SELECT p_partkey AS source_id, CASE WHEN p_partkey % 4 = 0 THEN 'https://x.org/' || p_partkey ELSE 'docs/' || p_partkey END AS stable_location FROM part) WHERE NOT starts_with(stable_location, 'https') AND stable_location NOT IN (SELECT 'docs/' || l_partkey FROM lineitem WHERE l_quantity > 40)")
def origins_missing(spark, sf_dir):
    key = F.col("p_partkey")
    sources = table(spark, sf_dir, "part").select(key.alias("source_id"), F.when(key % 4 == 0, F.concat(F.lit("https://x.org/"), key)).otherwise(F.concat(F.lit("docs/"), key)).alias("stable_location"))
    return wiki.missing_origins(sources, table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("docs/"), "l_partkey").alias("path")).distinct())


@query(None)
def wiki_lint(spark, sf_dir):
    """The lint rules over pages made of the driver's: each links to pages of the same names and cites a source."""
    p = cells.stored(_pages(spark, sf_dir), "pages")
    number = F.col("item_id").cast("int")
    front = F.concat(F.lit("---\nname: "), "summary", F.lit("\n---\n"))
    body = F.concat(front, "body", F.lit("\n[[wiki/concepts/"), (number * 7) % 300, F.lit("#part-0]] \"the of\" [src-"), number % 40, F.lit("]\n<!-- kb:begin id=note -->\nx\n<!-- kb:end id=note -->\n"))
    pages = p.select(F.concat(F.lit("wiki/concepts/"), "item_id", F.lit(".md")).alias("page_id"), body.alias("body"))
    b = table(spark, sf_dir, "benchmark")
    sources = b.select(F.concat(F.lit("src-"), "item_id").alias("source_id"), F.concat(F.lit("wiki/sources/src-"), "item_id", F.lit(".md")).alias("page_id"), "text")
    return wiki.lint(pages, chunks.heading_anchors(pages), sources).groupBy("rule", "severity").agg(F.count("*").alias("n"))


from corpusflow import wiki_queries  # noqa: E402, F401  registers its queries
