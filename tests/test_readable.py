"""Markdown of pages, JSON in answers, and turns from a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import readable
from corpusflow.operators import transcript, wiki
from corpusflow.streaming import ingest, turns

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home and a lot of other words that navigation has</a></li></ul></nav>
<div class="ad">Buy now, it is cheap and good and there are many words here</div>
<article><h1>Main &amp; title</h1><p>First <b>bold</b> paragraph with a <a href="/x">link</a>,
over two lines.<p>Second one<br>broken.<ul><li>one</li><li>two <em>it</em><ol><li>inner</li></ol></li></ul>
<pre>code
  stays</pre><blockquote><p>said</p></blockquote><img src="i.png" alt="pic"><table><tr><th>a</th><td>b</td></tr></table></article>
<footer>imprint</footer><script>var x = "<p>no</p>"</script></body></html>"""


def test_markdown():
    assert readable.markdown(PAGE).split("\n\n") == [
        "# Main & title", "First **bold** paragraph with a [link](/x), over two lines.", "Second one\nbroken.",
        "- one\n- two *it*\n  1. inner", "```\ncode\n  stays\n```", "> said", "![pic](i.png)", "| a | b |",
    ]


def test_density_finds_the_text_without_marks():
    page = "<body><div id='menu'><a href='/1'>" + "many words in links " * 40 + "</a></div><div><div><p>" + "real text, " * 30 + "</p><p>" + "more of it. " * 30 + "</p></div><div class='related'>" + "see also " * 50 + "</div></div><div><a href='q'>" + "again links " * 60 + "</a></div></body>"
    text = readable.markdown(page)
    assert text.count("real text") == 30 and text.count("more of it") == 30 and "links" not in text and "see also" not in text


@pytest.mark.parametrize("html,text", [("", ""), (None, None), ("<p>", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("<div><span><p>in</p></span>out</div>", "in\n\nout"), ("</p></div>x<b>", "x"), ("<h2></h2><h3>h</h3>", "### h"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<div>" * 3000 + "deep text", "deep text")])
def test_odd_pages(html, text):
    assert readable.markdown(html) == text


@pytest.mark.parametrize("text,want", [('{"a": 1}', {"a": 1}), ('Sure! Here it is:\n```json\n{"a": [1, {"b": "}"}]}\n```\nDone.', {"a": [1, {"b": "}"}]}), ('see [1] and {not json} then [{"name": "x"}] or {"y": 2}', [{"name": "x"}]), ("no json { here", None), ("", None), (None, None), ("[" * 5000, None), ('{"a": {"open": ', None), ("[1, 2]", None)])
def test_first_json(text, want):
    got = readable.first_json(text)
    assert (json.loads(got) if got else None) == want


def test_concepts_of_wrapped_answers(spark):
    envelope, bare = '{"concepts": [{"name": " Raft "}, {"name": ""}]}', '[{"name": "Raft"}]'
    answers = [envelope, f"I found these.\n```json\n{envelope}\n```", f"```\n{bare}\n```", f"They are {bare}.", bare, "nothing", None, '{"other": 1}', '{"concepts": "none"}']
    got = wiki.extracted_concepts(spark.createDataFrame(list(enumerate(answers)), "source_id int, answer string"))
    assert sorted((r.source_id, r.name) for r in got.collect()) == [(i, "Raft") for i in range(5)]


def test_markdown_of_a_column(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "k int, html string")
    got = {r.k: r.m for r in df.select("k", readable.html_markdown(F.col("html")).alias("m")).collect()}
    assert got[1].startswith("# Main") and got[2] is None and got[3] == ""


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 5)])
def test_streamed_turns(spark, tmp_path, seed, batches):
    rng = random.Random(seed)
    rows = []
    for rec in range(3):
        at = 0.0
        for seq in range(40):
            at += rng.choice([0.5, 2, 9, 30])
            rows.append((f"r{rec}", seq, rng.choice("ab"), at, at + rng.choice([0.5, 4, 40]), rng.choice(["x", " y ", "", None, "z"])))
            at = max(at, rows[-1][4]) if rng.random() < 0.8 else at
    rows.sort(key=lambda r: (r[1], r[0]))
    schema = "rec string, seq int, speaker string, start_s double, end_s double, text string"
    want = sorted(map(tuple, transcript.merge_turns(spark.createDataFrame([r for r in rows], schema)).collect()))
    ends = [(f"r{k}", 10**6, None, 0.0, 0.0, None) for k in range(3)]
    cuts = sorted(rng.sample(range(1, len(rows)), batches - 1))
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        part = rows[a:b] + (ends if b == len(rows) else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={n}"))
        stream = turns.merge_turns(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_a_timer_closes_an_idle_turn(spark, tmp_path):
    import time

    schema = "rec string, seq int, speaker string, start_s double, end_s double, text string"
    spark.createDataFrame([("r", 1, "a", 0.0, 1.0, "x")], schema).write.parquet(str(tmp_path / "in"))
    stream = turns.merge_turns(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle="1 second")
    query = stream.writeStream.format("memory").queryName("idle_turns").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while not (got := spark.table("idle_turns").collect()) and time.time() < until:
            time.sleep(0.3)
        assert [tuple(r) for r in got] == [("r", 0, "a", 0, 1, "x")]
    finally:
        query.stop()


def test_a_batch_that_crashed_hands_on_its_rows_again(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("src", "store", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(src)
    seen, broken = [], [True]

    def take(rows, number):
        seen.append((number, sorted(r.doc_id for r in rows.collect())))
        if broken.pop() if broken else False:
            raise RuntimeError("lost")

    run = lambda: ingest.ingest(ingest.document_stream(spark, src, "doc_id long, text string"), store, ck, take).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    run()
    assert seen == [(0, [1, 2]), (0, [1, 2])] and spark.read.parquet(f"{store}/revisions").count() == 2
