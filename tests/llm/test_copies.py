"""Operators 3 and 10, and the pipeline."""

import base64
import hashlib
import io
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from corpusflow.llm import common, shingle_join, warc_zstd
from corpusflow.llm.components import components


def test_archives(spark, tmp_path, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    same = "<html>" + "ü" * 1000
    pages += [(1000, "http://a/\nb", same), (1001, None, same), (1002, "u", None), (1003, "u", ""), (1004, "u", same), (-5, "u", "neg\r\n\r\native"), (None, "u", "lost")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string")
    manifest = warc_zstd.write(df, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc_zstd.read(spark, str(tmp_path / "w"), manifest).collect()}
    by = defaultdict(list)
    for page, _, html in pages:
        if page is not None:
            by[html or ""].append(page)
    assert len(got) == len(pages) - 1
    for page, _, html in pages[:-1]:
        raw = (html or "").encode()
        keeper = max(by[html or ""])
        r = got[page]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if page == keeper else ("revisit", keeper))


def test_archive_opens_with_its_dictionary():
    payloads = [("<html><title>page %d</title>" % i + "some text that all pages have " * (20 + i % 7)).encode() for i in range(2000)]
    words = warc_zstd.train(payloads)
    assert words
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    frames = [press.compress(warc_zstd.build_record(i, "u", p, None, "d")) for i, p in enumerate(payloads[:50])]
    raw = struct.pack("<II", warc_zstd.DICTIONARY_MAGIC, len(words)) + words + b"".join(frames)
    assert [b for _, b in warc_zstd.read_archive(io.BytesIO(raw))] == payloads[:50]
    with pytest.raises(ValueError):
        list(warc_zstd.read_archive(io.BytesIO(raw[:-5])))
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(frames[3])
    assert warc_zstd.train([b""] * 5) == b"" and list(warc_zstd.read_archive(io.BytesIO(b""))) == []
    assert warc_zstd.train([b"few"]) == b"few"


@pytest.mark.parametrize("n,same", [(3, False), (900, False), (40, True)])
def test_every_archive_carries_a_dictionary(spark, tmp_path, n, same):
    """Many pages, few pages, and pages too much alike to train on."""
    rng = random.Random(n)
    html = lambda i: "<html><title>same</title></html>" if same else f"<html><title>{rng.random()}</title>" + " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(rng.randint(50, 400)))
    rows = [(i, f"http://a/{i}", html(i)) for i in range(n)]
    manifest = warc_zstd.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    for name, _ in manifest:
        raw = (tmp_path / "w" / name).read_bytes()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == warc_zstd.DICTIONARY_MAGIC and 0 < size <= warc_zstd.DICTIONARY_BYTES
    got = {r.page_id: r.payload_bytes for r in warc_zstd.read(spark, str(tmp_path / "w"), manifest).collect()}
    assert got == {i: len(t.encode()) for i, _, t in rows}


def test_archive_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zstd.write(df, str(tmp_path / "w")) == []
    assert warc_zstd.read(spark, str(tmp_path / "w"), []).count() == 0


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(1, 20)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[: rng.randint(max(1, len(w) - 8), len(w))]
            texts.append(" ".join(w))
    passage = [rng.choice(words) for _ in range(50)]
    texts += [" ".join([rng.choice(words) for _ in range(rng.randint(0, 25))] + passage) for _ in range(30)]
    texts += ["", "a", "a b", "A b", "a b c d e", "a B c d e", "  \n"] * 2
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True), (7, None)]


@pytest.mark.parametrize("seed,docs,grams", [(1, 400, 600_000), (2, 5, 600)])
def test_join_equals_brute_force(spark, monkeypatch, seed, docs, grams):
    monkeypatch.setattr(shingle_join, "BLOCK_DOCS", docs)
    monkeypatch.setattr(shingle_join, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(shingle_join, "ASKING", 3)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in [*rows, (None, "lost")]], "doc_id long, text string, label string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.linked_components(df).collect()}
    assert got == brute(rows)


def test_join_of_few_long_texts(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_GRAMS", 60)
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(10 * group + k, " ".join([*base, *[f"x{k}"] * k])) for k in range(2 + group % 2)]
        rows.append((10 * group + 9, " ".join([*base[:45], *[f"y{rng.randrange(10**6)}" for _ in range(55)]])))  # meets them, isn't linked
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.linked_components(df).collect()}
    assert got == brute(rows) and got[1][1] == 0 and got[12][1] == 10


@pytest.mark.parametrize("seed,docs,grams", [(3, 400, 600_000), (4, 400, 600_000), (5, 5, 600)])
def test_rows_of_one_id_are_one_document(spark, monkeypatch, seed, docs, grams):
    monkeypatch.setattr(shingle_join, "BLOCK_DOCS", docs)
    monkeypatch.setattr(shingle_join, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(shingle_join, "ASKING", 3)
    rng = random.Random(seed)
    rows = [(rng.randrange(100, 175) if rng.random() < 0.6 else d, t) for d, t in corpus(seed)]
    alone = brute([*enumerate(t for _, t in rows)])  # each row as a document of its own
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, _) in enumerate(rows):
        x, y = find(d), find(rows[alone[i][1]][0])
        parent[max(x, y)] = min(x, y)
    want = sorted((d, alone[i][0], find(d)) for i, (d, _) in enumerate(rows))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.linked_components(df).collect()) == want
    kept = shingle_join.keep(df.withColumnRenamed("key", "row")).collect()
    assert sorted(r.doc_id for r in kept) == sorted({d for d, _, c in want if d == c}) and {r.row for r in kept} == {"x"}


def test_count_in_slices_and_from_a_file(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    blobs, want = [], Counter()
    sets = [np.unique(rng.integers(0, 3000, 400).astype(np.uint32) << np.uint32(20)) for _ in range(30)]
    for at in range(0, 30, 5):
        some = sets[at : at + 5] + [sets[0]] * (at > 0)  # the first set comes again and again, and counts once
        keys = [*range(at, at + 5)] + [0] * (at > 0)
        grams, places = np.concatenate(some), np.repeat(np.arange(len(some), dtype=np.uint16), [len(x) for x in some])
        order = np.argsort(grams, kind="stable")
        blobs.append((np.array(keys, np.int64), grams[order], places[order]))
    for x in sets:
        want.update(x.tolist())
    for at_once in (10**6, 500):
        monkeypatch.setattr(shingle_join, "COUNT_AT_ONCE", at_once)
        for number, ((keys, grams, places), held) in enumerate(zip(blobs, shingle_join._holders([shingle_join._Blob(*b) for b in blobs]), strict=True)):
            for gram, place, n in zip(grams.tolist(), places.tolist(), held.tolist(), strict=True):
                assert n == (0 if number > 0 and keys[place] == 0 else want[gram])
    monkeypatch.setattr(shingle_join, "GATHER_BYTES", 5000)
    gathered = shingle_join._Blobs(str(tmp_path / "waiting"))
    for keys, grams, places in blobs:
        gathered.add(pa.py_buffer(keys.tobytes() + shingle_join._packed(grams, places)), len(keys))
    assert any(b.file is not None for b in gathered.held) and any((tmp_path / "waiting").iterdir())
    for (keys, grams, places), two in zip(blobs, gathered.held, strict=True):
        assert keys.tolist() == two.keys.tolist() and grams.tolist() == two.below(0, None).tolist() and places.tolist() == two.places_of(0, two.many).tolist()
    for every in (2, 1024):
        monkeypatch.setattr(shingle_join, "EVERY", every)
        gathered = shingle_join._Blobs(str(tmp_path / "waiting"))
        for keys, grams, places in blobs:
            gathered.add(pa.py_buffer(keys.tobytes() + shingle_join._packed(grams, places)), len(keys))
        for a, b in zip(shingle_join._holders([shingle_join._Blob(*b) for b in blobs]), shingle_join._holders(gathered.held), strict=True):
            assert a.tolist() == b.tolist()
    monkeypatch.setattr(shingle_join, "LEAST_PARTS", 1)
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.linked_components(df, part_bytes=500).collect()} == brute(rows)


@pytest.mark.parametrize("flush", [4_000_000, 700])
def test_groups_of_parts(spark, monkeypatch, flush):
    """More parts than a task sends to: two shuffles, and parts taken one after the other."""
    for name, value in (("MOST_PARTS", 3), ("GROUP_FLUSH", flush), ("MOST_TASKS", 4)):
        monkeypatch.setattr(shingle_join, name, value)
    rows = corpus(12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = common.texts_only(df, named=True)
    sent = shingle_join._spread(texts, 5, 40).where("kind = 1")
    assert sent.select("part").distinct().count() == 40 and shingle_join._width(40) == 14
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.linked_components(df, part_bytes=300).collect()} == brute(rows)


def test_large_blocks_in_bands(spark, monkeypatch):
    """Documents that share passages but aren't alike, in one block that is too large, among groups that are."""
    for name, value in (("BLOCK_DOCS", 6), ("BLOCK_GRAMS", 10**6), ("ASKING", 2)):
        monkeypatch.setattr(shingle_join, name, value)
    rng = random.Random(9)
    passages = [[f"p{k}w{rng.randrange(10**6)}" for _ in range(40)] for k in range(8)]
    texts = []
    for group in range(14):
        picked = rng.sample(passages, 3)
        base = [w for p in picked for w in p] + [f"g{group}w{i}" for i in range(rng.randrange(5, 60))]
        for k in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w[: len(w) - rng.randrange(0, 20)]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.linked_components(df).collect()} == brute(rows)


def test_search_of_nothing():
    assert shingle_join.search([np.arange(5, dtype=np.uint64)], [3], range(1), range(1, 1), 75) == []


def test_join_of_nothing_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shingle_join.linked_components(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f", 1), (5, "a b c d e f", 1), (3, "a b c d e f", 1), (9, None, 1)], "doc_id long, text string, n int")
    assert sorted(map(tuple, shingle_join.linked_components(rows).collect())) == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 0, 9)]
    assert sorted(r.doc_id for r in shingle_join.keep(rows).collect()) == [3, 9]


def test_divide_skip_counts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 40, int(rng.integers(0, 25)))) for _ in range(int(rng.integers(1, 15)))]
        t = int(rng.integers(1, len(lists) + 1))
        count = Counter(x for lst in lists for x in lst.tolist())
        member, n = shingle_join.divide_skip(lists, t)
        assert dict(zip(member.tolist(), n.tolist(), strict=True)) == {x: c for x, c in count.items() if c >= t}


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in parent if find(x) != x}
    assert {r.a: r.b for r in components(spark.createDataFrame(links, "a long, b long"), one_task).collect()} == want
    name = lambda x: x.to_bytes(16, "big")
    named = spark.createDataFrame([(name(a), name(b)) for a, b in links], "a binary, b binary")
    assert {bytes(r.a): bytes(r.b) for r in components(named, one_task).collect()} == {name(x): name(y) for x, y in want.items()}
    assert components(named.limit(0), one_task).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        assert kept.count() <= before.count()
    assert kept.select("doc_id").distinct().count() == kept.count() > 100
    text = " ".join(r.text for r in kept.collect())
    assert "[EMAIL]" in text and not re.search(r"[a-z]@mail\d\.example", text)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_stages_take_odd_tables(spark, sf_dir):
    """Empty tables, null and repeated ids, null texts, and columns whose names clash with the operators' own."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = docs.where("lang = 'en'").orderBy("doc_id").limit(5)
    extra = good.selectExpr("*", "'x' AS row", "1 AS sig", "2 AS n", "3 AS label")
    blank = extra.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars", "row", "sig", "n", "label").limit(1)
    null = extra.selectExpr("doc_id + 900000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars", "row", "sig", "n", "label").limit(1)
    odd = extra.unionByName(extra).unionByName(blank).unionByName(null)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
        out = stage(spark, odd, sf_dir)
        if name != "packing":
            assert out.columns == odd.columns, name
        rows = out.collect()
        want = {"near_duplicates": 7, "pii": 12}.get(name)
        assert want is None or len(rows) == want, name
        if name != "packing":
            assert {r.row for r in rows} <= {"x"}
    small = spark.createDataFrame([(i, "a b c d e f g") for i in (1, 2)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1 AS n_chars")
    assert corpus_pipeline.near_duplicates(spark, small, sf_dir).count() == 1


def test_queries_run(spark, sf_dir):
    """Each registered query over a small scale, by its contract's columns; every document comes back."""
    import __spark_entry__

    columns = {1: "query_id rank vec_id score", 2: "doc_id held_out lang_pred score", 3: "page_id payload_bytes payload_digest record_type refers_to", 4: "doc_id piece start length ids_crc32 sequence_id offset", 5: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 6: "doc_id start n_tokens ids_crc32", 7: "doc_id n_tokens ids_sha256 decoded_sha256", 8: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 9: "doc_id held_out score predicted", 10: "doc_id n_shingles component_id", 11: "doc_id fingerprint component_id", 12: "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", 13: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"}
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in __spark_entry__.queries().items():
        if m := re.match(r"op(\d+)_", name):
            df = query(spark, sf_dir)
            want = columns[int(m[1])].split()
            assert df.columns[: len(want)] == want, name
            rows = df.collect()
            if want[0] in ("doc_id", "page_id"):
                assert len({r[0] for r in rows}) == n["documents" if want[0] == "doc_id" else "pages"], name
            if int(m[1]) == 4:
                assert len({r.sequence_id for r in rows}) == rows[0].sequences >= rows[0].sequences_at_least


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))


def test_workspaces_are_shared_and_cleared(spark):
    from corpusflow.llm import common

    df = common.materialize(spark.range(5), "t")
    path = common._MADE[-1]
    assert path.startswith(("file:", "hdfs:")) and df.count() == 5
    fs, at = common.filesystem(path)
    assert fs.get_file_info(at).type.name == "Directory"
    common.clear_workspaces(spark)
    assert fs.get_file_info(at).type.name == "NotFound"
