"""Operators on small rows with results worked out by hand, the odd cases among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.functions import vectors as V
from corpusflow.operators import chunks, evaluate, fusion, graph, lexical, mining, semantic, state, transcript, verify, wiki
from corpusflow.operators.hashing import hash_vector
from corpusflow.plans import retrieve
from corpusflow.sources import files, sinks
from corpusflow.streaming import ingest


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [("HTTPServer fooBar a é x1", ["httpserver", "foo", "bar", "é", "x1"]), ("", []), ("one,two;one", ["one", "two", "one"])],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


def test_tokens_among_terms_are_those_of_all_tokens(spark):
    rng = np.random.default_rng(7)
    parts = ["ab", "AB", "aB", "é", "x1", "1x", " ", "-", "_", "ß", "ab1", "Éa", "日本"]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 14))))) for i in range(800)]
    terms = ["ab", "x1", "éa", "日本", "ab1"]
    df = spark.createDataFrame(rows, "i int, t string")
    wanted = F.array(*map(F.lit, terms))
    assert df.where(T.tokens_among(F.col("t"), terms) != F.filter(T.tokens(F.col("t")), lambda w: F.array_contains(wanted, w))).count() == 0


def test_query_terms_keep_repeats(spark):
    assert T.query_terms("How does the fooBar work, work?") == ["foo", "bar", "work", "work"]
    assert one(spark, T.query_tokens(F.col("t")), t="How does the fooBar work, work?") == ["foo", "bar", "work", "work"]
    assert one(spark, T.only_stopwords(F.col("t")), t="how is the") and not one(spark, T.only_stopwords(F.col("t")), t="?!")


def test_slugs(spark):
    assert one(spark, T.slug(F.col("t")), t=" Écran — Total! ") == "Écran-total"
    assert one(spark, T.file_slug(F.col("t"), 10), t="alpha beta gamma") == "alpha-beta"
    assert one(spark, T.file_slug(F.col("t"), 8), t="alpha beta gamma") == "alpha"
    assert one(spark, T.file_slug(F.col("t"), 4), t="alphabet") == ""
    assert one(spark, T.link_slug(F.col("t")), t=" Foo_bar - (Baz) ") == "foo-bar-baz"


def test_regions_and_front_matter(spark):
    body = "---\nid: concept:x\nsources:\n  - src-a\n  - 'src-b'\n---\n# X\n<!-- kb:begin id=summary -->\nS\n<!-- kb:end id=summary -->\nuser"
    assert one(spark, T.region(F.col("t"), "summary"), t=body).strip() == "S"
    assert one(spark, T.frontmatter_value(F.col("t"), "id"), t=body) == "concept:x"
    assert one(spark, T.frontmatter_list(F.col("t"), "sources"), t=body) == ["src-a", "src-b"]
    put = one(spark, T.put_region(F.col("t"), "summary", F.lit("new")), t=body)
    assert "new" in put and "\nS\n" not in put and put.endswith("user")
    assert one(spark, T.put_region(F.col("t"), "other", F.lit("new")), t="a").startswith("a\n\n<!-- kb:begin id=other -->")
    assert one(spark, T.without_region_marks(F.col("t")), t=body).count("kb:") == 0


def test_links_references_quotes(spark):
    assert one(spark, T.wiki_links(F.col("t")), t="[[./wiki/a.md|A]] [[b#c]] [[/d]]") == ["wiki/a", "b", "d"]
    assert one(spark, T.source_references(F.col("t")), t="x [src-a#s] (src-b) [src-c p.7] src-d") == ["src-a", "src-b", "src-c"]
    assert one(spark, T.match_form(F.col("t")), t="“A *b*  c”\n‘d’") == "\"a b c\" 'd'"
    pages = spark.createDataFrame([("p", '"q one" [src-a#s pp.7-9] and [src-b p.3]  "q two" “q three” (src-c) "q one" [src-a#s pp.7-9] "bad" [src-d pp.9-7]')], "page_id string, body string")
    got = {(r.quote, r.source_id, r.anchor, r.first_page, r.last_page) for r in verify.quote_citations(pages).collect()}
    assert {("q one", "src-a", "s", 7, 9), ("q two", "src-b", None, 3, 3), ("q three", "src-c", None, None, None), ("bad", "src-d", None, None, None)} <= got


def test_estimates_and_urls(spark):
    assert one(spark, T.entry_estimate(F.col("t")), t="é") == 32 and one(spark, T.text_estimate(F.col("t")), t="éé1") == 2 and one(spark, T.chunk_estimate(F.col("t")), t="abcdefg") == 1
    assert one(spark, T.url_identity(F.col("t")), t="HTTPS://Ex.COM/a//?b=2&a=1&utm_source=z#f") == "https://ex.com/a?a=1&b=2&utm_source=z"
    assert one(spark, T.url_identity(F.col("t")), t="http://ex.com") == "http://ex.com/"
    assert one(spark, T.semantically_empty(F.col("t")), t="---\na: b\n---\n \n") and one(spark, T.semantically_empty(F.col("t")), t="---\na: b\nx") and not one(spark, T.semantically_empty(F.col("t")), t="---\na: b\n---\nx")
    assert one(spark, T.clock(F.col("t")), t=3661) == "01:01:01" and one(spark, T.page_span(F.lit(7), F.lit(9)), t=0) == "pp.7-9"
    assert one(spark, T.meta_slug(F.col("t")), t="bias-variance-trade-off") and not one(spark, T.meta_slug(F.col("t")), t="handling")


def test_text_sniff(spark):
    cases = [(b"", True), (b"plain\n", True), (b"a\x00b", False), (b"\xff\xfe", False), ("é".encode() * 5000, True), (b"\x01\x02a", False), (b"a" * 8191 + "é".encode(), True), (b"abc\xc3", False)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = {r.i: r.ok for r in df.select("i", files.looks_like_text(F.col("content")).alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))), t=0) == -1
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), t=0) is None and one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), t=0) is None
    texts = spark.createDataFrame([(1, "Héllo wörld"), (2, ""), (3, "ab")], "i int, t string")
    counts = {i: np.zeros(256) for i in (1, 2, 3)}
    for r in semantic.bucket_counts(texts, "i", "t").collect():
        counts[r.i][r.bucket] = r.n
    for r in semantic.hash_embeddings(texts, "i", "t").collect():
        c = counts[r.i]
        np.testing.assert_allclose(r.embedding, c / (np.linalg.norm(c) or 1), rtol=1e-6)
    assert not hash_vector("").any()


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h % 256


def test_bucket_is_fnv(spark):
    for t in ("a", "héllo", "日本", "The quick"):
        assert one(spark, V.hash_bucket(F.col("t")), t=t) == fnv(t)


def test_lexical_weights_and_ties(spark):
    rows = [("b", "raft log", ["consensus"], ["raft"], "raft raft"), ("a", "raft log", ["consensus"], ["raft"], "raft raft"), ("c", "none", [], [], "raft")]
    index = spark.createDataFrame(rows, "item_id string, title string, aliases array<string>, headings array<string>, summary string")
    assert [(r.item_id, r.score) for r in lexical.search(index, "the raft raft", 5).collect()] == [("a", 16), ("b", 16), ("c", 2)]
    assert lexical.search(index, "the of", 5).count() == 0 and lexical.search(index, "nothing", 5).count() == 0
    said = [r.message for r in lexical.reasons(lexical.score(index, "raft").where("item_id = 'a'")).orderBy("reason").collect()]
    assert said == ["title matched 'raft' 1x (+4)", "heading matched 'raft' 1x (+2)", "summary matched 'raft' 2x (+2)"]


def test_budget_skips_and_goes_on(spark):
    c = spark.createDataFrame([("a", 9, 50), ("b", 8, 60), ("c", 7, 40), ("d", 6, 20)], "item_id string, score long, tokens long")
    got = lexical.within_budget(c, 100, [F.desc("score"), F.col("item_id")]).collect()
    assert [(r.position, r.item_id) for r in got] == [(1, "a"), (2, "c")]
    pages = spark.createDataFrame([("index", 5, 0)], "item_id string, tokens long, order int")
    newest = spark.createDataFrame([(f"s{i}", 5, i) for i in range(9)], "item_id string, tokens long, order int")
    more = lexical.with_fallback(lexical.within_budget(c, 100, [F.desc("score"), F.col("item_id")]), pages, newest, 103)
    assert [r.item_id for r in more.orderBy("position").collect()] == ["a", "c", "index", "s0"]
    more = lexical.with_fallback(lexical.within_budget(c, 100, [F.desc("score"), F.col("item_id")]), pages, newest, 200)
    assert [r.item_id for r in more.orderBy("position").collect()] == ["a", "c", "index", "s0", "s1", "s2", "s3", "s4"]


def test_fusion_gate_and_rerank(spark):
    def tier(name, ids):
        return spark.createDataFrame([(i, n + 1, name) for n, i in enumerate(ids)], "item_id string, rank int, tier string")

    fused = fusion.fuse([tier("lexical", "ab"), tier("semantic", "bc"), tier("structural", "d")], 10)
    got = [(r.item_id, round(r.score, 9)) for r in fused.collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("d", round(1 / 61, 9)), ("c", round(1 / 62, 9))]
    assert fusion.disagree(fused).first()["rerank"]
    texts = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "want it"), ("d", "x")], "item_id string, text string")
    assert fusion.rerank(fused, texts, fusion.overlap_scorer(["want"]), 2).orderBy("position").first()["item_id"] == "c"
    same = fusion.fuse([tier("lexical", "ab"), tier("semantic", "ac")], 10)
    assert [r.item_id for r in fusion.rerank(same, texts, fusion.overlap_scorer(["want"])).orderBy("position").collect()] == ["a", "b", "c"]


@pytest.fixture(params=["one task", "rounds"])
def graph_size(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(graph.small_graphs, "FEW_EDGES", -1)


def test_pagerank(spark, graph_size):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src_id string, dst_id string")
    got = {r.item_id: r.score for r in graph.pagerank(ring, None).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and set(got) == set("abcd")
    assert graph.pagerank(ring, spark.createDataFrame([("zz",)], "item_id string")).count() == 0
    near = {r.item_id: r.score for r in graph.pagerank(ring, spark.createDataFrame([("a",)], "item_id string")).collect()}
    assert near["a"] > near["b"] > near["c"] > near["d"]


def test_cycles_and_closure(spark, graph_size):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "src_id string, dst_id string")
    assert {r.item_id: r.layer for r in graph.layers(edges).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}
    assert {r.item_id: r.depth for r in graph.closure(edges, spark.createDataFrame([("x",)], "item_id string")).collect()} == {"x": 0, "y": 1, "z": 2}
    assert {r.item_id for r in graph.upstream(edges, spark.createDataFrame([("c",)], "item_id string")).collect()} == {"a", "b", "c"}
    nodes = spark.createDataFrame([("wiki/a.md",), ("wiki/b/a.md",), ("wiki/c.md",)], "item_id string")
    found = graph.resolve_node(nodes, spark.createDataFrame([("c.md",), ("a.md",), ("wiki/a.md",), ("q",)], "name string"))
    assert {r.name: r.item_id for r in found.collect()} == {"c.md": "wiki/c.md", "a.md": None, "wiki/a.md": "wiki/a.md", "q": None}


def test_stale_records(spark):
    records = spark.createDataFrame([("r1", ["in1"], ["mid"]), ("r2", ["mid"], ["out"]), ("r3", ["in2"], ["o2"])], "record_id string, inputs array<string>, outputs array<string>")
    got = state.stale_records(records, spark.createDataFrame([("in1",)], "path string"))
    assert {r.record_id for r in got.collect()} == {"r1", "r2"}


def test_chunks():
    assert chunks.chunk("") == [] and chunks.chunk("short") == [(None, "short", None, None)]
    big = "word " * 300
    body = f"intro\n\n## One\n{big}\n```\n## not\n```\n## Two\n{big}\n### Sub\n{big * 3}\n\n{big * 2}"
    got = chunks.chunk(body)
    assert [h for h, *_ in got][0] == "One" and "## not" in got[0][1] and got[0][1].startswith("intro")
    assert {h for h, *_ in got} == {"One", "Two", "Sub"}
    paged = f"<!-- kb:page 1 -->\ntiny\n<!-- kb:page 2 -->\n{big}\n<!-- kb:page 3 -->\nend"
    assert [(a, b) for *_, a, b in chunks.chunk(paged)] == [(1, 3)]
    assert chunks.chunk("<!-- kb:begin id=x -->kept<!-- kb:end id=x -->")[0][1] == "kept"


def test_anchors_and_sections(spark):
    body = "# Top\n## A b\ntext\n```\n## No\n```\n## A b\nmore\n#### deep\n## É {#own}"
    pages = spark.createDataFrame([("p", body)], "page_id string, body string")
    assert [r.anchor for r in chunks.heading_anchors(pages).orderBy("line").collect()] == ["top", "a-b", "a-b-2", "own"]
    got = chunks.sections(pages).orderBy("section").collect()
    assert [r.anchor for r in got][:2] == ["top", "a-b"] and "## No" in got[1].body


def test_key_phrases(spark):
    docs = spark.createDataFrame([(1, "The leader-follower replication and Raft log. Raft Log, 42 the raft log!")], "doc_id int, text string")
    got = {r.phrase: round(r.score, 6) for r in mining.key_phrases(docs).collect()}
    assert got == {"Raft log": 12.0, "leader-follower replication": 4.0}


def test_missing_terms(spark):
    text = "The Raft Log works. Here we See Raft Log The\n\n`my_id` and `plain`"
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id int, text string")
    got = {(r.name, r.sources, r.mentions) for r in mining.missing_terms(docs, spark.createDataFrame([("Known",)], "name string"), 3, 3).collect()}
    assert got == {("Raft Log", 3, 6), ("my_id", 3, 3)}
    assert mining.missing_terms(docs, spark.createDataFrame([("raft log",), ("MY_ID",)], "name string"), 3, 3).count() == 0


def test_near_names(spark):
    rows = [(1, "Borrow checker", None), (2, "Borrow checkers", "x"), (3, "Unrelated", None), (4, "Data store", "one two"), (5, "data Store", "three four"), (6, "q", None), (7, "Q", None)]
    got = {(r.a, r.b): round(r.similarity, 3) for r in mining.near_names(spark.createDataFrame(rows, "id int, name string, definition string")).collect()}
    assert got == {(1, 2): round(2 * 13 / 27, 3), (6, 7): 1.0}


def test_mentions(spark):
    concepts = spark.createDataFrame([("c1", ["Lease"]), ("c2", ["the", "two phase commit"]), ("c3", ["box"])], "concept_id string, names array<string>")
    sources = spark.createDataFrame([("s1", "Many leases; a two-phase commit."), ("s2", "The boxes released"), ("s3", "two phase. commit")], "source_id string, text string")
    got = {(r.concept_id, r.source_id) for r in mining.mentions(concepts, sources).collect()}
    assert got == {("c1", "s1"), ("c2", "s1"), ("c2", "s3")}


def test_quotes(spark):
    source = "It is said that " + "abcdefghij " * 15 + "in the end."
    quotes = [("p1", "said THAT *abcdefghij*", "s"), ("p2", "x" + ("abcdefghij " * 15)[1:].strip(), "s"), ("p3", "nowhere", "s"), ("p4", "any", "t"), ("p5", "zz" * 60, "s")]
    df = spark.createDataFrame(quotes, "page_id string, quote string, source_id string")
    got = {r.page_id: (r.status, r.edits) for r in verify.verify_quotes(df, spark.createDataFrame([("s", source)], "source_id string, text string")).collect()}
    assert got == {"p1": ("exact", None), "p2": ("fuzzy", got["p2"][1]), "p3": ("absent", None), "p4": ("source_missing", None), "p5": ("absent", None)} and 1 <= got["p2"][1] <= 2
    assert verify.within("abc", "xxabdxx", 1) is not None and verify.within("abc", "xyz", 1) is None


def test_globs(spark):
    pages = spark.createDataFrame([("wiki/a/b.md",), ("wiki/a.md",), ("x.md",)], "page_id string")
    assert {r.page_id for r in verify.published(pages, ["wiki/*"]).collect()} == {"wiki/a.md"}
    assert verify.published(pages, ["wiki/**"]).count() == 2 and verify.published(pages, []).count() == 3


def test_metrics(spark):
    rows = [("q1", 1, True), ("q1", 2, False), ("q1", 3, True), ("q2", 1, False), ("q2", 2, False)]
    got = {r.query_id: r for r in evaluate.ranking_metrics(spark.createDataFrame(rows, "query_id string, position int, relevant boolean"), 5).collect()}
    assert got["q1"].precision_at_k == 0.4 and got["q1"].mrr == 1 and got["q2"].mrr == 0 and got["q2"].ndcg_at_k == 0
    assert abs(got["q1"].ndcg_at_k - (1 + 0.5) / (1 + 1 / np.log2(3))) < 1e-9
    answers = [(1, 9, 1, 9, 3, 5, True, True), (2, 0, 0, 0, 0, 0, False, False), (3, 0, 0, 3, 0, 2, True, False), (4, 1, 1, 2, 1, 1, False, False)]
    graded = evaluate.grounding(spark.createDataFrame(answers, "answer_id int, valid int, invalid int, manifest int, cited_expected int, expected int, banner boolean, should_banner boolean"))
    assert {r.answer_id: r.verdict for r in graded.collect()} == {1: "strong", 2: "strong", 3: "weak", 4: "ungrounded"}
    assert not evaluate.grounding_summary(graded).first()["passes"]


def test_turns(spark):
    rows = [(1, 0, "a", 0.0, 4.6, "one"), (1, 1, "a", 14.5, 15.0, "two"), (1, 2, "b", 16.0, 20.0, "x"), (1, 3, "b", 30.1, 31.0, "y"), (1, 4, "b", 32.0, 33.0, " ")]
    turns = transcript.merge_turns(spark.createDataFrame(rows, "rec int, seq int, speaker string, start_s double, end_s double, text string"))
    got = [(r.speaker, r.start_s, r.end_s, r.text) for r in turns.orderBy("turn").collect()]
    assert got == [("a", 0, 4, "one"), ("a", 14, 15, "two"), ("b", 16, 20, "x"), ("b", 30, 31, "y")]
    assert [(r.turn, r.pause_s) for r in transcript.pauses(turns).orderBy("turn").collect()] == [(1, 10), (3, 10)]
    text = transcript.render(turns).first()["body"]
    back = files.transcript_turns(spark.createDataFrame([("d", text)], "doc string, body string")).orderBy("turn").collect()
    assert [(r.speaker, r.start_s, r.end_s, r.text) for r in back] == got and text.count("> [pause: 10s]") == 2


def test_speakers(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 5.0, 6.0), (1, 2, 100.0, 101.0), (2, 0, 0.0, 1.0)], "rec int, seq int, start_s double, end_s double")
    voices = spark.createDataFrame([(1, 0, 0.5, 3.0, "A"), (1, 1, 0.0, 3.0, "B"), (1, 2, 7.0, 8.0, "C")], "rec int, seq int, start_s double, end_s double, speaker string")
    got = {(r.rec, r.seq): r.speaker for r in transcript.speakers(seg, voices).collect()}
    assert got == {(1, 0): "A", (1, 1): "C", (1, 2): "C", (2, 0): "speaker_unknown_0000"}


def test_clusters():
    rng = np.random.default_rng(0)
    centres = np.eye(3)
    v = np.concatenate([centres[[0] * 8], centres[[1] * 7], [[0.3, 0.9, 0]], centres[[2]]]) + 0.01 * rng.standard_normal((17, 3))
    got = transcript.cluster(v)
    assert len(set(got[:8])) == 1 and len(set(got[8:16])) == 1 and got[0] != got[8] and got[16] in set(got[:16])


def test_repeats(spark):
    assert one(spark, transcript.repeats_itself(F.col("t")), t="ab " * 60) and not one(spark, transcript.repeats_itself(F.col("t")), t="short")
    runs = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "a", "a", "a", "b", "b", "a"])], "rec int, seq int, text string")
    assert [r.seq for r in transcript.collapse_runs(runs).orderBy("seq").collect()] == [0, 4, 5, 6]


def test_plans(spark):
    pages = spark.createDataFrame([("a", "x " * 100, "sum a"), ("b", "tiny", "sum b")], "item_id string, body string, summary string")
    sections = spark.createDataFrame([("a", 1, "raft", "raft text"), ("a", 2, "other", "text")], "item_id string, section int, anchor string, body string")
    planned = spark.createDataFrame([(1, "a"), (2, "b")], "position int, item_id string")
    got = retrieve.assemble(planned, pages, sections, "raft", 8).orderBy("seq").collect()
    assert [(r.item_id, r.kind, r.anchor) for r in got] == [("a", "summary", None), ("a", "section", "raft"), ("a", "section", "other"), ("b", "document", None)]
    assert [r.start for r in got] == [0, 5, 14, 18]
    answers = spark.createDataFrame([(1, "x [1] [9] [1]"), (2, "none")], "answer_id int, answer string")
    done = {r.answer_id: (r.valid, r.invalid, r.banner) for r in retrieve.postprocess(answers, F.lit(3)).collect()}
    assert done == {1: ([1], [9], False), 2: ([], [], True)}
    assert one(spark, retrieve.linked_answer(F.col("t"), F.array(F.lit("p"), F.lit("q"))), t="a [1] b [2] [3]") == "a [[p]] b [[q]] [3]"
    source = retrieve.sources_of(spark.createDataFrame([("p0",)], "page_id string"), spark.createDataFrame([("p0", []), ("p1", []), ("p2", ["s"])], "page_id string, source_ids array<string>"), spark.createDataFrame([("p0", "p1"), ("p1", "p2")], "page_id string, referrer string"))
    assert [r.source_id for r in source.collect()] == ["s"]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/edges"
    edges = spark.createDataFrame([("a", "b", "cites"), ("a", "c", "links")], "src_id string, dst_id string, edge_type string")
    assert sinks.persist_edges(edges, path) == {"edges": 2, "inserted": 2, "deleted": 0}
    assert sinks.persist_edges(edges.where("dst_id = 'b'"), path) == {"edges": 1, "inserted": 0, "deleted": 1}
    table = f"file://{tmp_path}/t"
    sinks.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), table, ["k"])
    sinks.upsert_table(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), table, ["k"])
    assert sorted(map(tuple, sinks.read_table(spark, table).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert one(spark, sinks.publish_links(F.col("t"), "https://x.org/w/"), t="[a](b.md#c) [d](https://e) ![f](./g.png)") == "[a](https://x.org/w/b.md#c) [d](https://e) ![f](https://x.org/w/g.png)"


def test_sources(spark, tmp_path):
    for name, text in (("a.md", "# A"), ("sub/b.md", "B"), (".hidden/c.md", "C"), ("skip/d.md", "D"), ("e.txt", "E")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r.path for r in files.walk(spark, str(tmp_path), "*.md", ["skip/"]).collect()} == {"a.md", "sub/b.md"}
    assert {r.page_id for r in files.markdown_pages(spark, str(tmp_path), recursive=False).collect()} == {"a.md"}
    (tmp_path / ".kbignore").write_text("# c\nsub/\n!x\n")
    assert {r.path for r in files.walk(spark, str(tmp_path), "*.md", ["skip/"]).collect()} == {"a.md"}
    golden = files.golden_set(spark, '[[query]]\nid = "q"\nquery = "x"\nexpected_sources = ["s"]')
    assert golden.first()["expected"] == ["s"]
    with pytest.raises(ValueError):
        files.golden_set(spark, '[[query]]\nid = "q"\nquery = "x"')
    who = files.roster(spark.createDataFrame([("d", "## Speakers\n- @ann: Ann Lee (host)\n- @bob: Bob")], "doc string, body string"))
    assert sorted(map(tuple, who.collect()), key=str) == [("d", "ann", "Ann Lee", "host"), ("d", "bob", "Bob", None)]


def test_stream(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("src", "store", "ck"))
    seen = []
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(src)
    stream = lambda: ingest.ingest(ingest.document_stream(spark, src, "doc_id long, text string"), store, ck, lambda df, number: seen.append(sorted(r.doc_id for r in df.collect()))).awaitTermination()
    stream()
    spark.createDataFrame([(2, "b"), (2, "c"), (3, "d")], "doc_id long, text string").write.mode("append").parquet(src)
    stream()
    assert seen == [[1, 2], [2, 3]] and spark.read.parquet(f"{store}/revisions").count() == 4
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert ingest.sessions(events).agg(F.sum("n")).first()[0] == events.count() == ingest.windowed_counts(events).agg(F.sum("n")).first()[0]


def test_wiki_pages(spark):
    from corpusflow.operators import wiki

    source = "---\ntitle: \"T one\"\nsource_document_id: d1\n---\n# T one\n<!-- kb:begin id=summary -->\nabout rafts\n<!-- kb:end id=summary -->\n<!-- kb:begin id=caption-1 -->\na boat\n<!-- kb:end id=caption-1 -->\n"
    concept = "---\nname: Raft\naliases:\n  - log raft\n---\n# Raft\n[[wiki/sources/s1.md]] and [[wiki/none#x]] [src-z]\n"
    pages = spark.createDataFrame([("wiki/sources/s1.md", source), ("wiki/concepts/raft.md", concept), ("wiki/index.md", "# I")], "page_id string, body string")
    got = {r.item_id: r for r in wiki.index_entries(pages).collect()}
    assert got["wiki/sources/s1.md"].summary == "about rafts\n\na boat" and got["wiki/sources/s1.md"].title == "T one"
    assert got["wiki/concepts/raft.md"].aliases == ["log raft"] and got["wiki/concepts/raft.md"].summary == "" and got["wiki/concepts/raft.md"].headings == ["Raft"]
    assert {(r.page_id, r.region, r.missing) for r in wiki.missing_citations(pages).collect()} == {("wiki/sources/s1.md", "summary", "citations"), ("wiki/sources/s1.md", "caption-1", "citations")}
    sources = spark.createDataFrame([("src-a", "wiki/sources/s1.md", "words")], "source_id string, page_id string, text string")
    rules = {(r.rule, r.target) for r in wiki.lint(pages, chunks.heading_anchors(pages), sources).collect()}
    assert ("broken_links", "wiki/none.md") in rules and ("stale_citations", "src-z") in rules and not any(rule == "orphan_sources" for rule, _ in rules)
    none = spark.createDataFrame([], "concept_id string, page_id string")
    links = spark.createDataFrame([("wiki/concepts/raft.md", "wiki/sources/s1.md"), ("wiki/index.md", "wiki/sources/s1.md")], "page_id string, target string")
    back = wiki.backlinks(links, none, none.withColumnRenamed("page_id", "source_id"), pages).collect()
    assert [(r.page_id, r.referrers) for r in back] == [("wiki/sources/s1.md", ["wiki/concepts/raft.md"])]
    body = sinks.with_backlinks(pages, spark.createDataFrame([("wiki/sources/s1.md", "wiki/concepts/raft.md")], "page_id string, referrer string")).where("page_id = 'wiki/sources/s1.md'").first()["body"]
    assert "- [[wiki/concepts/raft.md]]" in body and "about rafts" in body


def test_staged_images_and_captions(spark):
    from corpusflow.operators import wiki

    pages = spark.createDataFrame([("p", "![](a/x.png) ![pic](b/x.png) ![good words](big.png) ![x](https://e/y.png)")], "page_id string, body string")
    sizes = spark.createDataFrame([("a/x.png", 10), ("b/x.png", 10), ("big.png", 1 << 30)], "path string, length long")
    assert {(r.target, r.asset) for r in wiki.staged_images(pages, sizes).collect()} == {("a/x.png", "x.png"), ("b/x.png", "x-2.png")}
    assert {r.target for r in verify.captions_due(pages).collect()} == {"a/x.png"}


def test_kept_page_and_dag(spark):
    from corpusflow.operators import wiki

    pages = spark.createDataFrame([("s-old", "s", 1), ("s-new", "s", 2)], "page_id string, source_id string, modified int")
    assert {r.page_id: r.stale for r in wiki.keep_one_page(pages).collect()} == {"s-old": True, "s-new": False}
    dag = wiki.build_dag(spark.createDataFrame([("d", "wiki/sources/a.md")], "doc_id string, page_id string"), spark.createDataFrame([("wiki/concepts/c.md", "wiki/sources/a.md")], "page_id string, source_page string"), spark.createDataFrame([("wiki/concepts/c.md",)], "page_id string"))
    assert {(r.src_id, r.dst_id) for r in dag.collect()} == {("d", "wiki/sources/a.md"), ("wiki/sources/a.md", "wiki/concepts/c.md"), ("wiki/concepts/c.md", "wiki/concepts/index.md")}


def test_pagerank_equals_power_iteration(spark, graph_size):
    """To convergence, with repeated seeds and nodes that lead nowhere, against a plain loop."""
    rng = np.random.default_rng(3)
    edges = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 40, (90, 2)).tolist()})
    seeds = ["n1", "n1", "n7", "n9", "none"]
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    jump = np.zeros(len(nodes))
    for x in seeds:
        if x in at:
            jump[at[x]] += 1
    jump /= jump.sum()
    score = jump.copy()
    for _ in range(30):
        new = np.zeros(len(nodes))
        for a, b in edges:
            new[at[b]] += 0.85 * score[at[a]] / sum(e[0] == a for e in edges)
        dead = sum(score[at[x]] for x in nodes if not any(e[0] == x for e in edges))
        new += jump * (0.15 + 0.85 * dead)
        done = np.abs(new - score).max() < 1e-6
        score = new
        if done:
            break
    got = {r.item_id: r.score for r in graph.pagerank(spark.createDataFrame(edges, "src_id string, dst_id string"), spark.createDataFrame([(x,) for x in seeds], "item_id string")).collect()}
    want = {x: score[i] for x, i in at.items() if score[i] > 1e-6 / len(nodes)}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_quotations_within_edits():
    """Candidate places by unchanged parts, against every place and length."""
    rng = np.random.default_rng(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    def plain(quote, source, budget):
        for start in range(len(source)):
            for length in range(max(0, len(quote) - budget), len(quote) + budget + 1):
                if start + length <= len(source) and distance(quote, source[start : start + length]) <= budget:
                    return distance(quote, source[start : start + length])
        return None

    for _ in range(400):
        quote = "".join(rng.choice(list("ab c"), int(rng.integers(3, 14))))
        changed = list(quote)
        for _ in range(int(rng.integers(0, 4))):
            changed[int(rng.integers(0, len(changed)))] = str(rng.choice(list("abx")))
        source = "".join(rng.choice(list("ab c"), int(rng.integers(0, 15)))) + "".join(changed) + "".join(rng.choice(list("ab c"), int(rng.integers(0, 10))))
        budget = int(rng.integers(0, 4))
        assert verify.within(quote, source, budget) == plain(quote, source, budget), (quote, source, budget)


def test_patterns_in_texts(spark, monkeypatch):
    from corpusflow.operators import matching

    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abé "), n))
    patterns = [(i, word(int(rng.integers(0, 40)))) for i in range(60)] + [(99, None)]
    texts = [(f"t{i}", "".join(patterns[int(k)][1] + word(2) for k in rng.integers(0, 60, 5))) for i in range(30)] + [("none", None), ("empty", "")]
    want = {(p, t) for p, x in patterns for t, y in texts if x and y and x in y}
    for reach in (256, 6):
        monkeypatch.setattr(matching, "REACH", reach)
        found = matching.contained(spark.createDataFrame(patterns, "pattern_id int, pattern string"), spark.createDataFrame(texts, "text_id string, text string"))
        assert {(r.pattern_id, r.text_id) for r in found.collect()} == want
    assert matching.contained(spark.createDataFrame([], "pattern_id int, pattern string"), spark.createDataFrame(texts, "text_id string, text string")).count() == 0


def test_a_million_names_take_one_scan(spark, tmp_path):
    from corpusflow.operators import matching

    spark.createDataFrame([(1, " of name 77 and name 123456 there "), (2, " nothing here "), (3, " name 999999 ")], "text_id int, text string").write.parquet(str(tmp_path / "t"))
    patterns = spark.range(1_000_000).selectExpr("id AS pattern_id", "' name ' || id || ' ' AS pattern")
    found = matching.contained(patterns, spark.read.parquet(str(tmp_path / "t")))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert sorted(map(tuple, found.collect())) == [(77, 1), (123456, 1), (999999, 3)]


def test_near_names_of_several_names(spark):
    rows = [(1, "Borrow checker", None), (1, "Ownership", None), (2, "Borrow checkers", None), (3, "ownership", None), (4, "Raft", None)]
    got = {(r.a, r.b): round(r.similarity, 3) for r in mining.near_names(spark.createDataFrame(rows, "id int, name string, definition string")).collect()}
    assert got == {(1, 2): round(2 * 13 / 27, 3), (1, 3): 1.0}


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        sinks.replace_table(spark.range(n + 1), path)
        (tmp_path / "t" / "_new-crashed").mkdir()
        assert sinks.read_table(spark, path).count() == n + 1
    sinks.replace_table(sinks.read_table(spark, path).limit(2), path)  # reads what it replaces
    assert sinks.read_table(spark, path).count() == 2
    assert sorted(x.name for x in (tmp_path / "t").iterdir()) == ["v000000000003", "v000000000004"]


@pytest.mark.parametrize(
    "raw,want",
    [("foo", ("wiki/concepts/foo.md", None)), ("../sources/a.md#b", ("wiki/sources/a.md", "b")), ("#here", ("wiki/concepts/x.md", "here")), ("wiki/q/./y|alias", ("wiki/q/y.md", None)), ("<a b.md>", ("wiki/concepts/a b.md", None)), ("https://x.org", None), ("mailto:a@b", None), ("../../.kb/n", None), ("", None)],
)
def test_link_targets(spark, raw, want):
    got = one(spark, T.link_target(F.col("r"), F.lit("wiki/concepts/x.md")), r=raw)
    assert (tuple(got) if got else None) == want


def test_answers_are_written(spark, tmp_path):
    rows = spark.range(2)
    retrieve.write_answer(rows, rows, rows.limit(1), str(tmp_path / "a"))
    assert [spark.read.json(f"{tmp_path}/a/{x}").count() for x in ("answer", "context", "plan")] == [2, 2, 1]


def test_eval_run(spark):
    index = spark.createDataFrame([("wiki/a.md", "raft log", "raft"), ("wiki/b.md", "raft", "other"), ("wiki/c.md", "paxos", "")], "item_id string, title string, summary string").selectExpr("*", "CAST(array() AS ARRAY<STRING>) AS aliases", "CAST(array() AS ARRAY<STRING>) AS headings")
    got = {r.query_id: r for r in retrieve.eval_run(index, [("q1", "raft", ["B.md"]), ("q2", "paxos", ["c", "d"])], k=2).collect()}
    assert (got["q1"].precision_at_k, got["q1"].mrr, got["q2"].precision_at_k, got["q2"].mrr) == (0.5, 0.5, 0.5, 1.0)


def test_reports_and_conclusions(spark):
    pages = spark.createDataFrame([("p", None)], "page_id string, body string")
    with pytest.raises(ValueError):
        wiki.lint(pages, pages, pages, ["no-such"])
    assert one(spark, wiki.promoted_body(F.lit(None).cast("string"), F.col("a"), F.array().cast("array<string>")), a=" x ") == "## Answer\n<!-- kb:begin id=answer -->\nx\n<!-- kb:end id=answer -->\n\n## Citations\n<!-- kb:begin id=citations -->\n_No citations._\n<!-- kb:end id=citations -->\n"


def hybrid_parts(spark):
    rng = np.random.default_rng(9)
    words = ["raft", "log", "paxos", "vote", "disk", "page", "leader"]
    index = spark.createDataFrame([(f"d{i}", " ".join(rng.choice(words, 2)), " ".join(rng.choice(words, 6))) for i in range(40)], "item_id string, title string, summary string").selectExpr("*", "CAST(array() AS ARRAY<STRING>) AS aliases", "CAST(array() AS ARRAY<STRING>) AS headings")
    chunks_ = spark.createDataFrame([(f"d{i % 40}#{i // 40}", f"d{i % 40}", rng.standard_normal(4).tolist()) for i in range(80)], "chunk_id string, item_id string, embedding array<double>")
    vector = spark.createDataFrame([([1.0, 0.5, 0.0, 0.2],)], "v array<double>")
    edges = spark.createDataFrame(sorted({(f"d{a}", f"d{b}") for a, b in rng.integers(0, 60, (150, 2)).tolist() if a != b}), "src_id string, dst_id string")
    return index, chunks_, vector, edges


def test_hybrid_search_is_the_fusion_of_whole_tiers(spark):
    """Places in the structural tier are counted for a few nodes; here all are sorted, and fused by hand."""
    index, chunks_, vector, edges = hybrid_parts(spark)
    lex = [(r.item_id, r.score) for r in lexical.search(index, "raft leader", 10).collect()]
    near = [(r.item_id, r.score) for r in semantic.semantic_items(chunks_, vector, 10).collect()]
    sem = [x for x in near if x[1] >= 0.35]
    seeds = spark.createDataFrame([(x,) for x in sorted({x for x, _ in lex} | {x for x, _ in sem})], "item_id string")
    whole = sorted(((r.item_id, r.score) for r in graph.pagerank(edges, seeds).collect()), key=lambda x: (-x[1], x[0]))
    total = {}
    for tier in (lex, sem, whole):
        for place, (item, _) in enumerate(tier, 1):
            total[item] = total.get(item, 0) + 1 / (60 + place)
    want = sorted(((x, round(s, 12)) for x, s in total.items()), key=lambda x: (-x[1], x[0]))[:10]
    got = [(r.item_id, round(r.score, 12)) for r in retrieve.hybrid_search(index, chunks_, "raft leader", vector, edges).orderBy("position").collect()]
    assert sorted(got) == sorted(want) and [s for _, s in got] == [s for _, s in want]


def test_hybrid_plan_with_edges(spark):
    """PageRank reorders a plan and adds nothing to it."""
    index, chunks_, vector, edges = hybrid_parts(spark)
    plain = {r.item_id: r for r in retrieve.hybrid_plan(index, chunks_, "raft leader", vector, None, 500).collect()}
    got = {r.item_id: r for r in retrieve.hybrid_plan(index, chunks_, "raft leader", vector, edges, 500).collect()}
    assert set(got) == set(plain) and sum(r.tokens for r in got.values()) <= 500
    seeds = spark.createDataFrame([(x,) for x in sorted(got)], "item_id string")
    whole = [x for x, _ in sorted(((r.item_id, r.score) for r in graph.pagerank(edges, seeds).collect()), key=lambda x: (-x[1], x[0]))]
    for item, r in got.items():
        assert r.structural_rank == (whole.index(item) + 1 if item in whole else None)
        assert abs(r.score - plain[item].score - (1 / (60 + r.structural_rank) if r.structural_rank else 0)) < 1e-12
