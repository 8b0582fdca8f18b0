"""Operators 12 and 13 against plain loops over regular expressions and the libraries' own tokens."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusflow.llm import fill_middle, token_alignment
from corpusflow.llm.unit_encoder import byte_symbols

PARTS = [*" \n\tabzAZ'.,09-é字ß😀▁\x00\x1f\xa0", "<P>", "<S", "M>", "<0x41>", "<s>", "</s>", "<unk>", "<|endoftext|>", "the ", "  ", "ing"]


def strings(n, seed, longest=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 63, 64, 65, 1000):
        for share in (0, 0.02, 0.5, 1):
            bits = rng.random(size) < share
            packed = fill_middle.Bits(bits)
            at = np.arange(size + 1)
            assert packed.rank(at).tolist() == [int(bits[:i].sum()) for i in at]
            places = np.flatnonzero(bits).tolist()
            assert packed.select(np.arange(len(places) + 2)).tolist() == [*places, size, size]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_middle(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:x]), "".join(tokens[x:y]), "".join(tokens[y:])
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", len(prefix), len(middle), sha(out), sha(text)


def test_middles(spark):
    texts = [*strings(700, 6), "x" * 100_000, "word " * 60_000, "字" * 50_000, "<", "S>", "<S", ">" * 30]
    rows = [(i - 40, t, "a", 1) for i, t in enumerate(texts)] + [(9001, None, "a", 1), (9002, "twice", "a", 1), (9002, "twice", "a", 1), (9002, "other", "a", 1), (None, "no id", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    got = sorted((tuple(r) for r in fill_middle.digests(docs).collect()), key=repr)
    assert got == sorted((plain_middle(i, t) for i, t, *_ in rows if i is not None), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(docs.where("false")).collect() == []


def test_middle_texts(spark):
    rows = [(i, "One two, drei vier!") for i in range(60)]
    for r in fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.form == "psm":
            prefix, suffix, middle = re.fullmatch("<P>(.*)<S>(.*)<M>(.*)", r.output).groups()
        elif r.form == "spm":
            suffix, prefix, middle = re.fullmatch("<S>(.*)<P>(.*)<M>(.*)", r.output).groups()
        else:
            continue
        assert prefix + middle + suffix == rows[0][1] and (len(prefix), len(middle)) == (r.prefix_chars, r.middle_chars)


A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.no_truncation()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    byte = {c: i for i, c in enumerate(byte_symbols())}

    def tokens(text):
        ia = a.encode(" " + text, add_special_tokens=False).ids
        ib = b.encode(text, num_threads=1)
        sa = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        sb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        want = (" " + text).encode()
        return (ia, ib, sa, sb) if text and b"".join(sa) == want == b"".join(sb) else ([], [], [], [])

    return tokens


def plain_alignment(rows, tokens):
    """Of each document: all pairs of tokens are looked at."""
    found, count = [], Counter()
    for doc, text in rows:
        ia, ib, sa, sb = tokens(text or "")
        ends_a, ends_b = np.cumsum([len(x) for x in sa]).tolist(), np.cumsum([len(x) for x in sb]).tolist()
        links = [(x, y) for x, ea, na in zip(ia, ends_a, map(len, sa), strict=True) for y, eb, nb in zip(ib, ends_b, map(len, sb), strict=True) if max(ea - na, eb - nb) < min(ea, eb)]
        count.update(links)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, e in zip(ia, ends_a, strict=True) if low < e <= cut) + "|" + ",".join(str(y) for y, e in zip(ib, ends_b, strict=True) if low < e <= cut))
            low = cut
        found.append((doc, len(ia), len(ib), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else ""))
    high = Counter()
    for (_, y), n in count.items():
        high[y] = max(high[y], n)
    return sorted((d, na, nb, g, len(links), sum(count[x] == high[x[1]] for x in links), sum(count[x] for x in links), h) for d, na, nb, g, links, h in found)


@pytest.mark.parametrize("slice_bytes", [40, 2_000_000])
def test_alignments(spark, libraries, slice_bytes):
    texts = [*strings(150, 8), "", "plain words that both know", "a▁b", "Ünïcödé ½ ﬁ ①", "tokenization of internationalization", "ab" * 400]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(900, None, "x", 3), (901, "same words", "x", 3), (901, "same words", "x", 3), (None, "no id", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int").repartition(3)
    got = sorted(tuple(r) for r in token_alignment.alignments(docs, A_PATH, B_PATH, slice_bytes=slice_bytes).collect())
    want = plain_alignment([(i, t) for i, t, *_ in rows if i is not None], libraries)
    assert got == want
    assert any(r[1] == 0 and texts[r[0]] for r in want if r[0] < 900)  # some texts' bytes aren't what B spells
    assert token_alignment.alignments(docs.where("false"), A_PATH, B_PATH).collect() == []


def test_a_very_long_text(spark, libraries):
    text = ("internationalization of tokens, " * 200 + "字ü" * 100) * 20
    got = token_alignment.alignments(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), A_PATH, B_PATH).collect()
    ia, ib, *_ = libraries(text)
    (row,) = (r for r in got if r.doc_id == 1)
    assert (row.n_a, row.n_b) == (len(ia), len(ib)) and row.n_groups <= row.n_links


def test_query_against_plain_loops(spark, sf_dir, libraries):
    from corpusflow.llm.queries import op13_token_alignment

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 1500").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in token_alignment.alignments(docs, A_PATH, B_PATH).collect()) == plain_alignment(rows, libraries)
    assert op13_token_alignment(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
