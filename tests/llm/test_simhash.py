"""Operator 11 against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from corpusflow.llm import simhash_tiles

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_fingerprint(text, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    """fps: list of (id, fp); smallest id reachable, of each id."""
    ids = defaultdict(set)
    for i, f in fps:
        ids[i].add(f)
    todo, least = dict(ids), {}
    for i in sorted(ids):
        if i in least:
            continue
        seen, front = {i}, [i]
        while front:
            x = front.pop()
            for y, other in todo.items():
                if y not in seen and any((f ^ g).bit_count() <= radius for f in todo[x] for g in other):
                    seen.add(y)
                    front.append(y)
        least |= dict.fromkeys(seen, i)
    return least


def test_fingerprints():
    rng = random.Random(3)
    texts = ["", None, " \t\n", "One", "one TWO", "a b c", "A\x0bB\x0cC d", "Ünï É x y", "\xa0 non breaking\x85space stays", "x " * 900]
    texts += ["".join(rng.choice(["a", "B", " ", "\n", "é", "word ", "字"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        assert simhash_tiles.fingerprint((t or "").encode()) == plain_fingerprint(t), t


def test_fingerprint_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "bb", "c" * 40]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 200)]
    for piece in (1, 7, 64):
        monkeypatch.setattr(simhash_tiles, "PIECE", piece)
        for t in texts:
            assert simhash_tiles.fingerprint(t.encode()) == plain_fingerprint(t)
    monkeypatch.undo()
    long = " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(400_000))  # over two megabytes
    words = long.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << i for i in range(64) if 2 * int((h >> np.uint64(i) & np.uint64(1)).sum()) > len(h))
    assert simhash_tiles.fingerprint(long.encode()) == want


def clustered(n, seed):
    """Random fingerprints, and walks of few flipped bits from some of them."""
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)] + [0, (1 << 64) - 1]
    for _ in range(n):
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    return sorted(set(fps))


def connected(members, links):
    parent = {x: x for x in members}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = defaultdict(set)
    for x in members:
        groups[root(x)].add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 400)])
def test_compare(seed, n):
    fps = clustered(n, seed)
    x = np.array(fps, np.uint64)
    every = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    found = simhash_tiles.compare(x, x).tolist()
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in found) and len(found) < len(fps)
    assert connected(fps, found) == connected(fps, every)
    assert len(simhash_tiles.compare(x, x[:0])) == len(simhash_tiles.compare(x[:1], x[:1])) == 0


def test_dense_groups_make_few_links():
    base = 0x0123456789ABCDEF
    fps = np.array(sorted({base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(40)}), np.uint64)
    assert len(simhash_tiles.compare(fps, fps)) == len(fps) - 1


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_cells_reach_all_within_the_radius(radius):
    steps = set(simhash_tiles.offsets(radius))
    assert len(steps) == {0: 1, 1: 5, 3: 65}[radius]
    rng = random.Random(radius)
    cell = lambda f: sum((f >> 16 * k & 0xFFFF).bit_count() << 5 * k for k in range(4))
    for _ in range(3000):
        a = b = rng.getrandbits(64) & rng.getrandbits(64) if rng.random() < 0.5 else rng.choice([0, (1 << 64) - 1])
        for _ in range(rng.randint(0, radius)):
            b ^= 1 << rng.randrange(64)
        assert cell(b) - cell(a) in steps or cell(a) - cell(b) in steps


@pytest.mark.parametrize("tile", [3, 4096])
def test_links_of_a_table(spark, tile):
    fps = clustered(150, 9)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash_tiles.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, tile).collect()]
    every = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert connected(fps, found) == connected(fps, every)


def test_components_of_documents(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = {}
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 30, 400]))]
        texts[i] = " ".join(words)
        if len(words) > 100:
            for k in range(3):  # near copies
                again = list(words)
                again[rng.randrange(len(again))] = "changed"
                texts[1000 + 10 * i + k] = " ".join(again).upper()
    rows = [(i, t, "f", 7) for i, t in texts.items()] + [(5000, None, "f", 7), (5001, " \n", "f", 7), (5002, texts[0], "f", 7), (5002, texts[0], "f", 7), (None, "no id", "f", 7)]
    rows += [(5003, texts[4], "f", 7), (5003, "some other text that has another fingerprint", "f", 7)]  # one id, two texts
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int").repartition(5)
    got = simhash_tiles.linked_components(docs).collect()
    fps = [(i, plain_fingerprint(t)) for i, t, *_ in rows if i is not None]
    least = plain_components(fps)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", least[i]) for i, f in fps)
    assert simhash_tiles.linked_components(docs.where("false")).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    from corpusflow.llm.queries import op11_simhash_tiles

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    least = plain_components(fps)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in op11_simhash_tiles(spark, sf_dir).collect()}
    assert got == {(i, f"{f:016x}", least[i]) for i, f in fps}
