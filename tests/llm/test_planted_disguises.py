"""Operator 5: identifiers planted with any part of them in disguise are covered whole."""

import random
import time

import pytest

from corpusflow.llm import pii_offsets as P


@pytest.mark.parametrize(
    "text,left",
    [
        ("mail jоhn@example.com now", "mail [EMAIL] now"),
        ("john@example.cоm", "[EMAIL]"),
        ("ip １92.168.1.10 x", "ip [IP] x"),
        ("192.168.1.1０", "[IP]"),
        ("call +49 151 234567８", "call [PHONE]"),
        ("john dot smith@example.com", "[EMAIL]"),
        ("joe@mail.example dot com", "[EMAIL]"),
        ("joe (at) 192.168.1.10", "[EMAIL]"),
        ("call +49 151 234567 eight nine now", "call [PHONE] now"),
        ("call +49 151 2345678 one day", "call [PHONE] one day"),  # a single word says nothing
    ],
)
def test_disguises_around_plain_finds(text, left):
    assert P.redact(text) == left


IDENTIFIERS = [("john.smith+x@mail.example.com", 0), ("a@b.co", 0), ("192.168.1.10", 1), ("8.8.8.8", 1), ("4111 1111 1111 1111", 2), ("5500005555555559", 2), ("+49 151 23456789", 3), ("+1 (212) 555-0100", 3)]
BACK = {}
for odd, plain in P.GLYPHS.items():
    if len(plain) == 1:
        BACK.setdefault(plain, []).append(odd)


def covered(spans, kind):
    return {i for a, b, k in spans for i in range(a, b) if k == kind}


@pytest.mark.parametrize("identifier,kind", IDENTIFIERS)
def test_any_subset_of_glyphs(identifier, kind):
    rng = random.Random(identifier)
    for _ in range(400):
        share = rng.random()
        put = "".join(rng.choice(BACK[c]) if c in BACK and rng.random() < share else c for c in identifier)
        before, after = rng.choice(["", "see ", "(", "Ünï: "]), rng.choice(["", " now", ", x", "\nnext"])
        text = before + put + after
        base, added = P.find(text)
        assert base == P.detect(text)
        place = set(range(len(before), len(before) + len(put)))
        assert place <= covered([*base, *added], kind), (text, base, added)
        assert not place & set(_left(text)), text


def _left(text):
    """Places that redaction leaves, by the union of all finds."""
    base, added = P.find(text)
    return set(range(len(text))) - {i for a, b, _ in [*base, *added] for i in range(a, b)}


AT, DOT = ["@", " [at] ", "(at)", "[@]"], [".", " [dot] ", "(dot)", " dot ", "[.]"]


def test_signs_and_glyphs_together():
    rng = random.Random(4)
    for _ in range(1500):
        local, host = rng.choice([["john"], ["mary", "ann"], ["x9"]]), rng.choice([["example", "com"], ["mail", "example", "org"]])
        glyph = lambda w: "".join(rng.choice(BACK[c]) if c in BACK and rng.random() < 0.3 else c for c in w)  # noqa: E731, B023
        put = glyph(local[0]) + "".join(rng.choice(DOT) + glyph(w) for w in local[1:]) + rng.choice(AT) + glyph(host[0]) + "".join(rng.choice(DOT) + glyph(w) for w in host[1:])
        text = "write: " + put + ", please"
        assert not set(range(7, 7 + len(put))) & _left(text), text


def test_cover():
    rng = random.Random(1)
    for _ in range(500):
        spans = sorted((a := rng.randrange(30), a + rng.randint(1, 8), 0) for _ in range(rng.randint(0, 6)))
        cover = P.Cover(spans)
        for a in range(32):
            for b in range(a + 1, 34):
                assert cover.meets(a, b) == any(x < b and y > a for x, y, _ in spans)
                assert cover.holds(a, b) == any(x <= a and y >= b for x, y, _ in spans)


def test_many_finds_are_quick():
    text = " ".join(f"joe{i}@example.com mary{i} (at) host{i} (dot) org" for i in range(8000))
    began = time.process_time()
    base, added = P.find(text)
    assert len(base) == len(added) == 8000 and time.process_time() - began < 3
