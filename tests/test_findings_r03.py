"""What the findings of round 3 were about, on small rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import readable
from corpusflow.functions import text as T
from corpusflow.functions import vectors as V
from corpusflow.operators import chunks, lexical, lexical_index, many, matching, mining, semantic, transcript, verify, wiki
from corpusflow.plans import retrieve
from corpusflow.queries import QUERIES
from corpusflow.sources import cells


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_many_wanted_items(spark):
    """places meet wanted items by equality; no pair of a hit and a wanted item is compared."""
    hits = spark.range(400).select(F.col("id").alias("item_id"), (F.col("id") * 7 % 40).cast("double").alias("score"))
    wanted = spark.range(0, 800, 2).select((F.col("id") % 500).alias("item_id"))
    got = semantic.ranks_among(hits, wanted, 5, "x")
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    order = sorted(range(400), key=lambda i: (-(i * 7 % 40), i))
    assert sorted((r.item_id, r["rank"]) for r in got.collect()) == sorted((i, n) for n, i in enumerate(order, 1) if n <= 5 or i % 2 == 0)


def test_backlinks_shuffle_no_pairs(spark):
    """a pair that meets by several headings is made once, without a shuffle of all pairs."""
    cited = spark.createDataFrame([(c, a) for c in range(6) for a in ("x", "y", "z")] + [(9, "w")], "concept_id int, anchor string")
    anchors = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), ("z", 2), ("z", 2), ("w", 3)], "anchor string, doc_id int")
    homes = spark.createDataFrame([(1, "p"), (2, "p"), (2, "q"), (3, "r")], "doc_id int, page_id string")
    allowed = spark.createDataFrame([(5, 3), (5, 3), (7, 1)], "concept_id int, doc_id int")
    got = wiki.anchor_backlinks(cited, anchors, homes, allowed)
    want = [(c, p) for c in range(5) for p in "pq"] + [(5, "r"), (7, "p"), (9, "r")]
    assert sorted(tuple(r) for r in got.collect()) == want
    free = plan(got).split("Union", 1)[1].split("arrays_overlap", 1)[0]
    assert "Aggregate" not in free and "Exchange" not in free


def test_terms_end_at_accented_letters(spark):
    """boundaries of terms are those of ASCII words, as in the SQL."""
    d = spark.createDataFrame([(1, "so Heedtion Eauéé and éFine Thing_ Old\x0bTown")], "doc_id int, text string")
    assert [r.term for r in mining.term_mentions(d).collect()] == ["Heedtion Eau"]


def test_ampersands_that_open_no_reference(spark):
    """an ampersand without a closing semicolon is text; in links, too."""
    page = '<article><h1>A &amp;&amp</h1><p>Enough text to be the main block, R&D, 1 &lt; 2 &#39;x&#39; <a href="/?a=1&amp;b=2&copy=3">on</a></p></article>'
    assert readable.markdown(page).split("\n\n") == ["# A &&amp", "Enough text to be the main block, R&D, 1 < 2 'x' [on](/?a=1&b=2&copy=3)"]


def test_clock_column_of_many_hours(spark, tmp_path):
    """F8: the column keeps two digits of the hours, the clock itself all of them."""
    row = [(3599 + 3600 * 1234, 1, "O", 1.0, "1-URGENT"), (61, 1, "O", 1.0, "1-URGENT")]
    spark.createDataFrame(row, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.clock for r in QUERIES["scalar_forms"](spark, str(tmp_path)).collect()) == ["00:01:01", "12:59:59"]
    assert spark.range(1).select(T.clock(F.lit(3600 * 1234))).first()[0] == "1234:00:00"


def test_searches_pass_over_short_entries(spark, monkeypatch):
    """entries are taken apart once for all blocks of questions, and what can't be reached by length is left out without loss."""
    monkeypatch.setattr(many, "QUESTIONS", 6)
    monkeypatch.setattr(many, "COMMON", 3)
    monkeypatch.setattr(many, "PILOT", 8)
    words = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([(i, " ".join(words[(i * j) % (7 + i % 33)] for j in range(3 + i * i % 90))) for i in range(150)], "doc_id int, text string")
    q = spark.createDataFrame([(f"q{i}", " ".join(words[(i * j + j) % 40] for j in range(1 + i % 9))) for i in range(20)], "query_id string, query string")
    index = lexical.entries(d)
    found = many.lexical_search(index, q, 4)
    assert "split(" not in plan(found)
    got = sorted((r.query_id, r.position, r.item_id, r.score) for r in found.collect())
    want = [(r.query_id, i, x.item_id, x.score) for r in q.collect() for i, x in enumerate(lexical.search(index, r.query, 4).collect(), 1)]
    assert got == sorted(want)


def test_golden_sets_as_tables(spark):
    """a golden set may be a table; it isn't brought to the driver."""
    index = lexical.entries(spark.createDataFrame([(i, f"alpha{i % 3} beta{i}") for i in range(9)], "doc_id int, text string"))
    golden = [("q1", "alpha1", ["1"]), ("q2", "beta7", ["7"])]
    table = spark.createDataFrame(golden, "query_id string, query string, expected array<string>")
    assert sorted(retrieve.eval_run(index, table, 2).collect()) == sorted(retrieve.eval_run(index, golden, 2).collect())


def test_buckets_are_counted_by_id(spark):
    """no table of all ids' buckets is aggregated; ids that repeat are one."""
    texts = spark.createDataFrame([(1, "Ab cab"), (1, "cab"), (2, None), (3, "")], "i int, t string")
    got = semantic.bucket_counts(texts, "i", "t")
    assert "count(1)" not in plan(got)
    every = texts.select("i", F.explode(V.grams(F.col("t"))).alias("g")).groupBy("i", V.hash_bucket(F.col("g")).alias("b")).count()
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in every.collect())


def _plain_clusters(vectors, likeness, small):
    """Every pair of centres is compared before every merge."""
    cos = lambda a, b: a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12)
    centres, counts, of = [], [], []
    for v in vectors.astype(float):
        sims = [cos(c, v) for c in centres]
        i = int(np.argmax(sims)) if sims and max(sims) > likeness else len(centres)
        if i == len(centres):
            centres.append(v)
            counts.append(1)
        else:
            centres[i], counts[i] = (centres[i] * counts[i] + v) / (counts[i] + 1), counts[i] + 1
        of.append(i)
    alive, target = list(range(len(centres))), list(range(len(centres)))
    while len(alive) > 1:
        sim, i, j = max(((cos(centres[i], centres[j]), i, j) for i in alive for j in alive if i < j), key=lambda x: (x[0], -x[1], -x[2]))
        if sim <= likeness:
            break
        centres[i], counts[i] = (centres[i] * counts[i] + centres[j] * counts[j]) / (counts[i] + counts[j]), counts[i] + counts[j]
        alive.remove(j)
        target = [i if t == j else t for t in target]
    large = [i for i in alive if counts[i] >= small]
    move = {i: max(large, key=lambda k: (cos(centres[k], centres[i]), -k)) for i in alive if counts[i] < small} if large else {}
    return [move.get(target[i], target[i]) for i in of]


def test_voices_are_folded_in_batches(spark):
    """a recording passes in batches, none is collected as a group; centres merge as they would if all pairs were compared each time."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3, 60, 5)).round(3)
    rows = [(f"r{r}", 59 - i, x[r, 59 - i].tolist()) for r in range(3) for i in range(60)]
    got = transcript.cluster_voices(spark.createDataFrame(rows, "rec string, seq int, embedding array<double>"), 0.6, 3)
    assert "FlatMapGroups" not in plan(got)
    found = {(r.rec, r.seq): r.cluster for r in got.collect()}
    want = {(f"r{r}", i): c for r in range(3) for i, c in enumerate(_plain_clusters(x[r], 0.6, 3))}
    assert found == want and len(set(want.values())) > 3


def _stored(spark, path):
    """term, segment and postings as the cells' files have them, file by file."""
    rows = cells.read(spark, f"{path}/blocks").withColumn("file", F.input_file_name()).collect()
    files: dict = {}
    for r in rows:
        files.setdefault(r.file, []).append((r.term, r.segment))
        assert r.best == max(p.impact for p in r.postings)
    return rows, files


def test_index_is_built_a_segment_at_a_time(spark, tmp_path, monkeypatch):
    """entries are shuffled whole and become blocks without an aggregation of all postings; slices may cut a segment."""
    monkeypatch.setattr(lexical_index, "SLICE", 3)
    d = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 3} w{i % 3} tail{i}") for i in range(90)], "doc_id int, text string")
    blocks = lexical_index._blocks(lexical.entries(d), 2, 4, lexical.WEIGHTS)
    assert "Aggregate" not in plan(blocks) and "Generate" not in plan(blocks)
    path = f"file://{tmp_path}/built"
    lexical_index.build(lexical.entries(d), path, buckets=3, parts=2, segment=12)
    rows, files = _stored(spark, path)
    assert len({(r.term, r.segment) for r in rows}) == len(rows)
    assert all(f == sorted(f) for f in files.values())
    assert {p.item_id: p.impact for r in rows if r.term == "w1" for p in r.postings} == {i: 5 * ((i % 7 == 1) + 2 * (i % 3 == 1)) for i in range(90) if i % 7 == 1 or i % 3 == 1}


def test_updates_mend_blocks(spark, tmp_path):
    """blocks are mended as lists, one a term and segment stays, and the cells written are in order again."""
    d = spark.createDataFrame([(i, f"alpha w{i % 7} tail{i}") for i in range(90)], "doc_id int, text string")
    path = f"file://{tmp_path}/mended"
    lexical_index.build(lexical.entries(d), path, buckets=3, parts=2, segment=12)
    changed = spark.createDataFrame([(i, f"beta w{i % 7}") for i in range(0, 95, 5)], "doc_id int, text string")
    lexical_index.update(path, lexical.entries(changed), spark.createDataFrame([(1,), (2,)], "item_id int"))
    rows, files = _stored(spark, path)
    assert len({(r.term, r.segment) for r in rows}) == len(rows)
    assert all(f == sorted(f) for f in files.values())
    held = lambda term: sorted(p.item_id for r in rows if r.term == term for p in r.postings)
    assert held("alpha") == [i for i in range(90) if i % 5 and i not in (1, 2)] and held("beta") == list(range(0, 95, 5))



def test_updates_are_put_beside(spark, tmp_path, monkeypatch):
    """an update of few items writes their blocks beside the stored ones; items may change several times, a torn update does nothing, and a part with many notes is rebuilt."""
    docs = {i: f"alpha w{i % 7} tail{i}" for i in range(90)}
    frame = lambda d: lexical.entries(spark.createDataFrame(list(d.items()), "doc_id int, text string"))
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "item_id int")
    path = f"file://{tmp_path}/beside"
    lexical_index.build(frame(docs), path, buckets=3, parts=2, segment=12)

    def same():
        for q, k in (("alpha w3", 3), ("beta w3 tail5", 200)):
            assert [tuple(r) for r in lexical_index.search(spark, path, q, k).collect()] == [tuple(r) for r in lexical.search(frame(docs), q, k).collect()], (q, k)

    built = set(_stored(spark, path)[1])
    docs |= {5: "beta alpha alpha", 200: "beta w3"}
    done = lexical_index.update(path, frame({i: docs[i] for i in (5, 200)}), ids(3))
    del docs[3]
    _, files = _stored(spark, path)
    assert built < set(files) and done["cells"] == len(set(files) - built)  # nothing stored was written again
    assert all(f == sorted(f) for f in files.values())
    same()
    docs |= {5: "alpha w3 w3 w3", 3: "w3 beta"}
    lexical_index.update(path, frame({i: docs[i] for i in (5, 3)}))
    same()
    write = lexical_index._write
    monkeypatch.setattr(lexical_index, "_write", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lexical_index.update(path, frame({7: "beta"}), ids(8))
    monkeypatch.setattr(lexical_index, "_write", write)
    of = cells.manifest(spark, f"{path}/blocks")
    assert lexical_index._notes(spark, path, of).where("item_id IN (7, 8)").count() == 0
    same()
    docs |= {40: "beta beta"}
    lexical_index.update(path, frame({40: docs[40]}))
    same()
    docs |= {i: f"w3 beta tail{i}" for i in range(20, 60)}
    lexical_index.update(path, frame({i: docs[i] for i in range(20, 60)}))
    rows, files = _stored(spark, path)
    assert not built & set(files) and len({(r.term, r.segment) for r in rows}) == len(rows)
    same()
    for i in (1, 1):
        docs[i] = docs[i] + " beta"
        lexical_index.update(path, frame({i: docs[i]}))
    same()
    lexical_index.build(frame(docs), path, buckets=3, parts=2, segment=12)
    same()



def _counting(monkeypatch, module, name, at=0):
    """The plans of the frames that a function is given."""
    seen, f = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: (seen.append(plan(a[at])), f(*a, **b))[1])
    return seen


def test_only_planned_pages_are_cut(spark, sf_dir, monkeypatch):
    """pages are made once, and sections of those alone that a plan holds."""
    seen = _counting(monkeypatch, chunks, "sections")
    assert QUERIES["context_assembly"](spark, sf_dir).count()
    assert len(seen) == 1 and "LeftSemi" in seen[0] and "regexp" not in seen[0]


def test_lint_reads_pages_that_are_made(spark, sf_dir, monkeypatch):
    """F16: pages are made once for all rules, and what two rules read is found once."""
    seen, sought = _counting(monkeypatch, wiki, "lint"), _counting(monkeypatch, verify, "quote_citations")
    got = {r.rule: r.n for r in QUERIES["wiki_lint"](spark, sf_dir).collect()}
    assert len(seen) == len(sought) == 1 and "regexp_extract_all" not in seen[0]
    assert got["unverified_quotes"] == got["drift"] > 0 and got["missing_citations"] > 0



def test_prose_checks_look_before_patterns(spark):
    """sentences and names are cut once a row, fixed words are one pattern, and a pattern for a name is made only where the name stands; odd names come out as before."""
    b, n, a = F.col("body"), F.col("name"), F.col("aliases")
    checks = [mining.names_alias(b, n, a), mining.lacks_scope(b, a), mining.lacks_name(b, n)]
    names = ["alias", "no_scope", "no_name"]
    rows = [
        ("Raft is it", "Raft", ["raft", "Log", "z"]), ("The raft logs grow. x", "Raft", ["raft", "Log", "z"]), ("A  raft, means", "raft", ["rafts"]), ("raft", " Raft ", []), ("raft rule works", "Raft", ["x"]),
        ("raft runsoverfourteenlong", "raft", None), ("rafting it", "raft", ["a.b", "a+b"]), ("c a.b d", "raft", ["axb", "a.b"]), ("c x\\Ey d", "q", ["x\\Ey", "\\E", "y"]), ("", "", ["", "", ""]), (None, "raft", ["a", "b", "c"]),
        ("Raft is", None, ["a", None, "is"]), ("the families, family", "x", ["p", "q", "r"]), ("p and q\nr", "x", ["P", "q", "r"]), ("preincludes Included", "x", ["p", "q", "r"]), ("an raft safety property", "Raft", ["an"]), ("raft stands", "raft", ["z"]),
    ]
    d = spark.createDataFrame(rows, "body string, name string, aliases array<string>")
    sentence, low = F.lower(mining.first_sentence(b)), F.lower(b)
    word = lambda text, w: F.regexp_like(text, F.concat(F.lit(r"(?:^|[^A-Za-z0-9_])\Q"), w, F.lit(r"\E(?:$|[^A-Za-z0-9_])")))
    hit = lambda x: (F.lower(x) != F.lower(n)) & (word(sentence, F.lower(x)) | word(sentence, F.concat(F.lower(x), F.lit("s"))))
    said = F.exists(F.array(*map(F.lit, mining.SCOPE_WORDS)), lambda w: word(low, w))
    wanted, bare = F.lower(F.trim(n)), F.regexp_replace(sentence, r"^(?:the|a|an) \s*", "")
    rest = F.when(bare.startswith(wanted), F.regexp_replace(F.substr(bare, F.length(wanted) + 1), r"^\s+", ""))
    begins = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: rest.startswith(p))
    first = F.regexp_extract(rest, r"^(\S*?),*(?:\s|$)", 1)
    verb = begins(mining.LINKING_VERBS) | (first.rlike("(?:s|ed|ing)$") & (F.octet_length(first) <= 14) & ~begins(mining.COMPOUND_MARKERS))
    plain = [F.get(F.filter(a, hit), 0), (F.size(a) >= 3) & ~said & (F.size(F.filter(a, lambda x: word(low, F.lower(x)))) < 2), (wanted != "") & ~F.coalesce((rest == "") | verb, F.lit(False))]
    got, want = ([tuple(r) for r in d.select(*[c.alias(x) for c, x in zip(made, names, strict=True)]).collect()] for made in (checks, plain))
    assert got == want and len(set(got)) > 5
    made = plan(d.select(*[c.alias(x) for c, x in zip(checks, names, strict=True)]))
    assert "exists(" not in made and made.lower().count("contains(") >= 4


def test_neighbours_are_ranked_few_at_a_time(spark, monkeypatch):
    """what can't be among the k nearest isn't ranked; opposite, equal, zero and odd vectors come out as before."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[40:60], x[60:80], x[80], x[81, 0], x[82] = x[:20], -x[:20], 0, np.nan, 1e-9
    monkeypatch.setattr(many, "SCORES", 4096)
    monkeypatch.setattr(many, "HELD", 64)
    ranked = []
    add = many.Best.add
    monkeypatch.setattr(many.Best, "add", lambda self, q, *rest: (ranked.append(len(q)), add(self, q, *rest))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(x.tolist())], ["item_id", "v"])
    (out,) = many._nearest_task({6: (np.arange(300), x)}, 300, 4)([batch])
    assert sum(ranked) < 300 * 300 // 4
    got = sorted(zip(*(out.column(i).to_pylist() for i in (0, 1)), strict=True))
    norms = np.linalg.norm(x, axis=1)
    want = []
    for q in range(300):
        score = [(-max(0.0, round(float(x[q] @ x[c] / (norms[q] * norms[c])), 12)), c) for c in range(300) if norms[q] * norms[c] > V.LEAST_NORMS]
        want += [(q, c) for _, c in sorted(score)[:4]]
    assert got == sorted(want)


def test_entries_without_a_term_are_not_taken_apart(spark):
    """a plain look comes before patterns, and loses nothing: terms within words, at cuts, upper case, sigmas."""
    texts = ["alphaBeta", "ALPHA x", "xalpha", "ΟΔΟΣ", "xβοΣ", None, "", "alpha-beta alpha"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = lexical.score(lexical.entries(d), "alpha alpha beta")
    assert "Contains(lower(" in plan(found) or "contains(lower(" in plan(found).lower()
    assert {r.item_id: r.score for r in found.collect()} == {0: 15, 1: 10, 7: 25}
    assert {r.item_id for r in lexical.score(lexical.entries(d), "οδος").collect()} == {3}


def test_pages_are_taken_in_few_rows(spark, monkeypatch):
    """of a batch only few pages are objects at once; nothing is lost at the cuts."""
    sizes = []
    monkeypatch.setattr(chunks, "ROWS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([f"## H{i}" for i in range(8)])], ["i", "body"])
    for part in chunks.slices([batch, batch.slice(0, 0), batch.slice(7)]):
        sizes.append(part.column(0).to_pylist())
    assert sizes == [[0, 1, 2], [3, 4, 5], [6, 7], [7]]
    monkeypatch.undo()
    pages = spark.createDataFrame([(i, f"## H{i}\n" + "x" * 3300) for i in range(400)], "item_id int, body string").coalesce(1)
    assert sorted((r.item_id, r.heading) for r in chunks.chunks(pages).collect()) == [(i, f"H{i}") for i in range(400)]


def test_sources_are_taken_in_few_characters(spark, monkeypatch):
    """of a batch of sources few characters are code points at once, and few rows objects; nothing is lost at the cuts."""
    assert matching.SLICE <= 1 << 17
    monkeypatch.setattr(chunks, "ROWS", 3)
    (bits,) = matching._head_bits([pa.RecordBatch.from_arrays([pa.array(["needle"])], ["part"])])
    place, held = bits.column(0).to_numpy(), bits.column(1).to_numpy().view(np.uint64)
    words = np.zeros(1 << matching.BITS - 6, np.uint64)
    words[place[place >= 0]] = held[place >= 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([f"some needle {i}" if i % 4 == 1 else "hay" for i in range(10)])], ["text_id", "text"])
    got = [r for out in matching._scan(words, int(held[place < 0][0]), 6, pa.int64())([batch]) for r in out.to_pylist()]
    assert [r["text_id"] for r in got if r["here"] == "needle"] == [1, 5, 9]
