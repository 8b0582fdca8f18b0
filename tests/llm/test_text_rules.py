"""Operators 5 and 8: personal data and quality rules, against plain versions."""

import random
import re

import numpy as np
import pytest

from corpusflow.llm import pii_offsets as pii
from corpusflow.llm import rule_cascade as rules

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if [True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_finds():
    rng = random.Random(3)
    parts = [*"0123456789" * 3, *" .-+()@ab%_\né", "255.1.2", "4111111111111111", "a@b.c", "+1 (2", ".."]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.detect(text) == plain(text), text


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("write john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
        ("mail bob at mail dot example dot org.", "email", "bob at mail dot example dot org"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jоe@exаmple.com", "email", "jоe@exаmple.com"),
        ("call plus one five five five two three four five six now", "phone", "plus one five five five two three four five six"),
        ("card four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١"),
        ("ab​@c.de", "email", "ab​@c.de"),
    ],
)
def test_disguises(text, kind, found):
    base, added = pii.find(text)
    assert (pii.KINDS.index(kind), found) in [(k, text[a:b]) for a, b, k in added]
    assert base == plain(text) and f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("host 192 dot 168 dot 1 dot 10 is up", "ip", "192 dot 168 dot 1 dot 10"),
        ("host 192 (dot) 168 (dot) 1 (dot) 10", "ip", "192 (dot) 168 (dot) 1 (dot) 10"),
        ("host 192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10"),
        ("host one nine two [.] one six eight [.] 1 [.] 10", "ip", "one nine two [.] one six eight [.] 1 [.] 10"),
        ("host 1 nine 2 dot 168 dot 1 dot one", "ip", "1 nine 2 dot 168 dot 1 dot one"),
        ("room 5 one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("mail joe[@]example[.]com", "email", "joe[@]example[.]com"),
        ("mail joe@example[.]com", "email", "joe@example[.]com"),
        ("card 4111 1111 1111 11 one one", "card", "4111 1111 1111 11 one one"),
        ("card 4111, 1111, 1111, 111 one", "card", None),
        ("call +1 555 dot 123 dot 4567", "phone", "+1 555 dot 123 dot 4567"),
        ("to first dot " + "x" * 80 + " [at] example (dot) com", "email", "first dot " + "x" * 80 + " [at] example (dot) com"),
        ("to " + "long.name" * 30 + " [at] example (dot) com", "email", "long.name" * 30 + " [at] example (dot) com"),
    ],
)
def test_disguised_signs_and_mixed_digits(text, kind, found):
    base, added = pii.find(text)
    got = [text[a:b] for a, b, k in added if pii.KINDS[k] == kind]
    assert got == ([found] if found else []) and base == plain(text)
    assert found is None or found not in pii.redact(text)


def addresses(text):
    """The edits of disguised addresses: each at sign from left to right, and each place where its local part may begin, far ones first."""
    out, at = [], 0
    while True:
        found = None
        for sign in pii._AT_SIGN.finditer(text, at):
            chain = re.compile(rf"(?:[A-Za-z0-9._%+-]+(?:{pii._DOT_BOX}|{pii._DOT_BARE}))*[A-Za-z0-9._%+-]+", re.IGNORECASE)
            for begin in range(at, sign.start()):
                if (begin == at or text[begin - 1] not in pii._LOCAL) and chain.fullmatch(text, begin, sign.start()):
                    m = pii._ADDRESS.match(text, begin)
                    if m and m.end("local") == sign.start():
                        found = m
                        break
            if found:
                break
        if not found:
            return out
        at = found.end()
        out.append((found.start(), found.end()))


def test_addresses_begin_as_far_back_as_they_can():
    rng = random.Random(11)
    parts = ["a", "b.c", "-", " ", "  ", "\t", " dot ", "dot", "[dot]", " (dot) ", "[.]", " at ", "[at]", "(AT) ", "@", " @ ", ",", "\n", "point", "{punkt}", "]", "[", "é"]
    for _ in range(30000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got, at = [], 0
        while m := pii._next_address(text, at):
            at = m.end()
            got.append((m.start(), m.end()))
        assert got == addresses(text), text


@pytest.mark.parametrize("text,found", [("hello, [dot] smith [at] ex.org", "smith [at] ex.org"), ("list: dot smith [at] ex.org", "smith [at] ex.org"), ("x" + " " * 40 + "dot" + " " * 40 + "y [at] z.org", None)])
def test_dot_signs_before_a_local_part(text, found):
    assert [text[a:b] for a, b, _ in pii.find(text)[1]] == [found or text]


def test_rewrites_keep_their_places():
    """Every character of a rewritten text stands for its source span, in order; what isn't marked as new is unchanged."""
    rng = random.Random(12)
    parts = [*"0123 aé.,@-", "one ", "zwei ", "plus ", " dot ", "[at]", " at ", "٤", "\u200b", "о", "＠", "4111", "cinq "]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        for steps in (pii.TRANSDUCERS, *pii.READINGS):
            r = pii._rewritten(text, steps)
            if r is None:
                continue
            assert len(r.text) == len(r.start) == len(r.end) == len(r.new)
            assert all(a < b for a, b in zip(r.start, r.end, strict=True)) and r.start == sorted(r.start) and r.end == sorted(r.end)
            for i, c in enumerate(r.text):
                if text[r.start[i] : r.end[i]] != c:
                    assert r.new[i]


def test_glyphs_one_by_one():
    for glyph, plain_one in list(pii.GLYPHS.items()):
        r = pii._rewritten(f"a{glyph}b", pii.TRANSDUCERS[:1])
        assert r.text == f"a{plain_one}b"


def test_other_readings_are_quick():
    for text in ("one 1 " * 30_000, "1 dot " * 30_000, "1[.]" * 40_000, "a dot " * 30_000 + "[at] b.c", "at dot " * 30_000, "a" * 200_000 + "[@]" * 1000, "1, one. " * 20_000):
        pii.find(text)


@pytest.mark.parametrize("text", ["", "at the one. At er on two", "one two three", "look at this. dot", "meet me at noon dot", "a | b at c"])
def test_clean_texts(text):
    assert pii.find(text) == ([], []) and pii.redact(text) == text


def test_long_texts_are_quick():
    for text in ("a" * 200_000, "1" * 200_000, "a at " * 40_000, "one " * 40_000, "@" * 100_000, "a[at]" * 40_000, "1." * 100_000, "+" * 100_000):
        pii.find(text)


def test_span_rows(spark):
    df = spark.createDataFrame([(1, "x a@b.cd", 1), (2, None, 1), (3, "", 1), (1, "x a@b.cd", 1)], "doc_id long, text string, spans int")
    got = sorted(pii.spans(df).collect())
    assert [r.spans for r in got] == ["email:2:8", "email:2:8", "", ""] and got[0].n_email == 1 and got[2].n_email == 0
    assert pii.spans(df.limit(0)).count() == 0 and pii.spans(spark.createDataFrame([(None, "a@b.cd", 1)], df.schema)).first().n_email == 1


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_measures():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice([*"ab #|\n\t\x0b\xa0é\x1c", *"   \n\n"]) for _ in range(rng.randint(0, 60))) for _ in range(7)]
        t = rules.Texts([x.encode() for x in texts])
        assert [tuple(map(int, r)) for r in zip(*[t.get(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], strict=True)] == list(map(counts, texts))
        some = rules.Texts([x.encode() for x in texts])
        at = np.array([i for i in range(len(texts)) if rng.random() < 0.5], np.int64)
        assert some.get("n_repeat_words", at).tolist() == [counts(texts[i])[4] for i in at] and some.known["repeats"].sum() == len(at)
        assert some.get("n_symbols").tolist() == [counts(x)[2] for x in texts]


def test_order_doesnt_matter_and_short_circuits():
    good = " ".join(f"word{i}" for i in range(80)).encode()
    raw = [good, b"", b"a b", b"x " * 100, (" | ".join(f"w{i}" for i in range(60))).encode(), (good + b"\n") * 3]
    want = rules.verdicts(rules.Texts(raw), rules.RULES).tolist()
    assert want == [True, False, False, False, False, False]
    assert rules.verdicts(rules.Texts(raw), tuple(reversed(rules.RULES))).tolist() == want
    asked = []
    spy = tuple(rules.Rule(r.name, lambda t, at, r=r: (asked.append(len(at)), r.rejects(t, at))[1]) for r in rules.RULES)
    rules.verdicts(rules.Texts(raw), spy)
    assert asked[0] == len(raw) and asked[-1] < len(raw) and asked == sorted(asked, reverse=True)
    assert {r.name for r in rules.order_rules(raw * 20)} == {r.name for r in rules.RULES} == {r.name for r in rules.order_rules([])}
    t = rules.Texts(raw)
    rules.verdicts(t, rules.RULES)
    assert t.known["words"].all() and not t.known["repeats"][1:3].any() and not t.known["characters"][[1, 2, 3]].any() and not t.known["lines"][4]


def test_rules_are_ordered_by_what_is_left(monkeypatch):
    """b rejects as much as a, but nothing that a leaves over; c rejects little, all of it new."""
    cost = {"a": 1.0, "b": 1.1, "c": 1.0}
    clock = [0.0]
    monkeypatch.setattr(rules.time, "thread_time", lambda: clock[0])

    def rule(name, out):
        def rejects(t, at):
            clock[0] += cost[name]
            return np.isin(at, out)

        return rules.Rule(name, rejects)

    made = (rule("b", range(8)), rule("c", [8]), rule("a", range(8)))
    assert [r.name for r in rules.order_rules([b"x"] * 10, made)] == ["a", "c", "b"]


def test_cascade_rows(spark):
    df = spark.createDataFrame([(1, None, True), (2, " ".join(f"w{i}x" for i in range(60)), True)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in rules.cascade(df).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False) and got[2].kept
    assert rules.cascade(df.limit(0)).count() == 0
    odd = df.union(df).union(spark.createDataFrame([(None, "x y", True)], df.schema))
    assert rules.cascade(odd).count() == 5
    kept = rules.keep(odd)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [2, 2]


def test_verdicts_against_labels(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    wrong = rules.cascade(docs).join(labels, "doc_id").where((F.col("quality") == 1) & ~F.col("base_failed") & ~F.col("kept"))
    assert wrong.count() == 0
    assert np.isfinite(rules.MIN_WORDS)
