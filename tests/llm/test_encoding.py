"""Operators 4, 6 and 7: token ids, files of them, and packing."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from corpusflow.llm import bin_packing, bpe_cuts, common, token_files
from corpusflow.llm.unit_encoder import WHITE_SPACE, ByteLevelEncoder, UnitEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*WHITE_SPACE, *"\x1c\x1f\x00abAB'.,1290é字ÉΣİſ<|>", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", "\n\n", "😀", "ﬁ", "the", "ing"]
TEXTS = ["", "Hello, world", " two  spaces\n\nand lines ", "ab" * 500, "Ünïcödé ÇA 12,345", "x <|endoftext|> y", "the " * 1500]


def strings(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def rows(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "no id", "x")], "doc_id long, text string, ids string")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path,encoder", [(WORD, UnitEncoder(WORD, False)), (BYTE, UnitEncoder(BYTE, True)), (BYTE, ByteLevelEncoder(BYTE))])
def test_units_encode_as_the_library(path, encoder):
    lib = Tokenizer.from_file(path)
    for text in strings(3000) + TEXTS:
        ids, n = encoder.encode([text, "a", text])
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids[: n[0]].tolist() == want == ids[n[0] + n[1] :].tolist(), text


def test_forced_boundaries_encode_and_decode_as_the_library():
    lib, own = Tokenizer.from_file(WORD), bpe_cuts.ForcedBoundaryBPE(WORD)
    for text in strings(3000, 1) + TEXTS + ["z" * 3000 + "the" * 700]:
        want = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_newer_code_points_encode_as_the_library():
    """Every code point that Python's tables don't know and some pattern takes for a letter or a number, in a word of its own kind, of letters and of numbers."""
    import unicodedata

    import regex

    lib, own = Tokenizer.from_file(WORD), bpe_cuts.ForcedBoundaryBPE(WORD)
    newer = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))) if unicodedata.category(c) == "Cn"]
    assert len(newer) > 1000
    for at in range(0, len(newer), 7):
        text = " ".join(f"a{c}a{c}1{c}!{c}{c} É{c}\u0307" for c in newer[at : at + 7])
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids, [hex(ord(c)) for c in newer[at : at + 7]]


def test_cuts_are_where_no_token_reaches():
    own = bpe_cuts.ForcedBoundaryBPE(WORD)
    word = "qzxjvthewq".encode()
    pieces = own.cuts(word)
    assert b"".join(pieces) == word and len(pieces) > 1


def test_digests_and_round_trip(spark):
    lib = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe_cuts.digests(rows(spark), WORD).collect()}
    for i, text in [*enumerate(TEXTS), (99, "")]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe_cuts.encode(rows(spark), WORD)
    back = {r.doc_id: r.text for r in bpe_cuts.decode(encoded, WORD).collect()}
    assert back[1] == lib.decode(lib.encode(TEXTS[1], add_special_tokens=False).ids, skip_special_tokens=False)


def test_token_files(spark, tmp_path, monkeypatch):
    lib = Tokenizer.from_file(WORD)
    shards = token_files.write(rows(spark), str(tmp_path / "ids"), WORD, 2)
    got = {r.doc_id: r for r in token_files.read(spark, str(tmp_path / "ids"), shards).collect()}
    at = 0
    for i, text in [*enumerate(TEXTS), (99, "")]:
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert None not in got
    name = shards[0].name
    doc, offsets, flat = token_files.open_shard(str(tmp_path / "ids"), name)
    assert isinstance(flat, np.memmap) and flat.dtype == np.uint16 and len(flat) == offsets[-1]
    monkeypatch.setattr(common, "filesystem", lambda uri: (pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), uri.lstrip("/")))  # a store that can't be mapped
    _, _, ranged = token_files.open_shard(str(tmp_path / "ids"), name)
    assert isinstance(ranged, token_files.RangeReader) and len(ranged) == len(flat) and ranged[3:9].tolist() == flat[3:9].tolist() and ranged[0:0].tolist() == []


def test_token_files_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    shards = token_files.write(empty, str(tmp_path / "ids"), WORD, 2)
    assert shards == [] and token_files.read(spark, str(tmp_path / "ids"), shards).count() == 0


def held(groups):
    count = Counter()
    for n, content in groups:
        for length, m in content:
            count[length] += n * m
    return count


def fewest(lengths, capacity):
    """The fewest bins, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= lengths[i] and bins[j] not in bins[:j]:
                put(i + 1, [*bins[:j], bins[j] - lengths[i], *bins[j + 1 :]])
        put(i + 1, [*bins, capacity - lengths[i]])

    put(0, [])
    return best[0]


def test_packing_holds_all_and_is_best_for_small_cases():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.integers(6, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 11)))
        counts = np.bincount(lengths, minlength=capacity + 1)
        groups = bin_packing.pack_histogram(counts, capacity)
        assert held(groups) == Counter(lengths.tolist())
        assert all(sum(x * m for x, m in content) <= capacity for _, content in groups)
        n = sum(n for n, _ in groups)
        assert bin_packing.lower_bound(counts, capacity) <= fewest(lengths.tolist(), capacity) == n


def test_completion_beats_best_fit():
    counts = np.bincount([60] * 10 + [50] * 10 + [30] * 10 + [20] * 20 + [10] * 10, minlength=101)
    groups = bin_packing.pack_histogram(counts, 100)
    assert sum(n for n, _ in groups) == bin_packing.lower_bound(counts, 100) == 19 + (60 * 10 + 50 * 10 + 300 + 400 + 100 > 1900)


def test_dominance():
    assert bin_packing._dominates((30,), (20, 10)) and not bin_packing._dominates((20, 10), (30,))
    counts = np.zeros(50, int)
    counts[[5, 10, 15, 30]] = 3
    assert bin_packing.fillings(counts, 30, 3, 30)[0] == ((30, 1),)


def test_completion_tries_all_undominated_fillings():
    rng = np.random.default_rng(1)
    for _ in range(200):
        gap = int(rng.integers(5, 40))
        lengths = sorted(rng.integers(1, gap + 5, int(rng.integers(1, 9))).tolist(), reverse=True)
        counts, most = np.bincount(lengths, minlength=50), int(rng.integers(0, gap + 1))
        every = {tuple(x for i, x in enumerate(lengths) if k >> i & 1) for k in range(1 << len(lengths))}
        every = [f for f in every if sum(f) <= gap]
        want = [b for b in every if gap - sum(b) <= most and not any(a != b and bin_packing._dominates(a, b) for a in every)]
        got = [tuple(x for x, m in f for _ in range(m)) for f in bin_packing.undominated(counts, gap, most)]
        assert got == sorted(want, key=lambda f: (-sum(f), [-x for x in f]))
    ten = [614, 532, 522, 420, 369, 205, 123, 113, 92, 82]
    assert sum(n for n, _ in bin_packing.pack_histogram(np.bincount(ten, minlength=1025), 1024)) == 3


def test_packing_is_best_where_lengths_repeat():
    rng = np.random.default_rng(7)
    for _ in range(150):
        capacity = int(rng.integers(10, 60))
        lengths = rng.choice(rng.integers(1, capacity + 1, int(rng.integers(2, 8))), int(rng.integers(4, 13)))
        groups = bin_packing.pack_histogram(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert held(groups) == Counter(lengths.tolist())
        assert sum(n for n, _ in groups) == fewest(lengths.tolist(), capacity)


def test_pieces_and_places(spark):
    lib = Tokenizer.from_file(BYTE)
    parts = common.materialize(bin_packing.pieces(rows(spark), BYTE, 64), "pieces")
    got = sorted(parts.collect(), key=lambda r: (r.doc_id, r.piece))
    for i, text in [*enumerate(TEXTS), (99, "")]:
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        mine = [r for r in got if r.doc_id == i]
        assert [r.length for r in mine[1:]] == [64] * (len(mine) - 1) and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in mine)
    placed = bin_packing.pack(parts, 64).collect()
    assert len(placed) == len(got)
    by = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= 64
    assert bin_packing.pack(parts.limit(0), 64).count() == 0
    few = [(r.doc_id, r.piece, r.sequence_id, r.offset) for r in bin_packing.pack(parts, 64, None, ranked=2).collect()]  # many parts a length
    assert len(few) == len(set(few)) == len(got) and len({(s, o) for _, _, s, o in few}) == len(few)
