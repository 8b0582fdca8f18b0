"""Operators 1, 2 and 9: search by codes, and the two classifiers."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm import ann_codes, language_codes, quality_subword
from corpusflow.llm.queries import fold


def nearest(ids, x, q, k):
    score = x.astype(np.float64) @ x[q].astype(np.float64)
    others = [i for i in range(len(ids)) if ids[i] != ids[q]]
    return sorted(others, key=lambda i: (-score[i], ids[i]))[:k]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def test_codes_find_the_nearest(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((900, 64)) + 2 * rng.standard_normal((9, 64))[rng.integers(0, 9, 900)]).astype(np.float32)
    x[300:340] = x[300]  # ties
    ids = rng.permutation(5000)[:900]
    df = vectors(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)])
    got = ann_codes.neighbours(df, F.col("vec_id") % 20 == 0, 20, index_block=128, query_block=16).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        mine = got[got.query_id == ids[q]].sort_values("rank")
        want = nearest(ids, x, q, 20)
        assert mine["rank"].tolist() == list(range(1, 21))
        hits += len(set(mine.vec_id) & set(ids[want]))
        total += 20
        np.testing.assert_allclose(mine.score, [x[q].astype(float) @ x[list(ids).index(v)].astype(float) for v in mine.vec_id], rtol=1e-12)
    assert hits / total >= 0.97


def test_codes_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 0), (20, [0.0, 0.0], 0), (40, None, 0), (60, [nan, 1.0], 0), (80, [1.0, None], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (None, [1.0, 1.0], 0), (3, [1.0], 0)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann_codes.neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann_codes.neighbours(vectors(spark, []), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_error_bounds_hold():
    """Off-centre vectors of a length that isn't a multiple of 64, against their exact products."""
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((2000, 70)) + 1.5).astype(np.float32)
    frame = ann_codes.Frame(ann_codes.rotation(70), x.mean(0).astype(np.float64))
    bits, numbers = ann_codes.encode(frame, x)
    assert bits.dtype == np.uint64 and bits.shape == (2000, 2)
    queries = (rng.standard_normal((20, 70)) + 1).astype(np.float32)
    off = []
    for q, (estimate, bound) in zip(queries.astype(np.float64), ann_codes.estimates(frame, bits, numbers, queries), strict=True):
        truth = x.astype(np.float64) @ q
        off.append(estimate - truth)
        assert (np.abs(off[-1]) <= bound).mean() > 0.96
        assert np.corrcoef(estimate, truth)[0, 1] > 0.6
    assert abs(np.mean(off)) < 0.1


def test_estimates_count_bits_as_a_product_of_signs():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 64))
    frame = ann_codes.Frame(ann_codes.rotation(64), np.zeros(64))
    bits, numbers = ann_codes.encode(frame, x)
    signs = np.sign(x @ frame.rotation.T)
    length, fit, _ = numbers.T
    for q, (estimate, _) in zip(x[:5], ann_codes.estimates(frame, bits, numbers, x[:5]), strict=True):
        turned = frame.rotation @ q
        step = (turned.max() - turned.min()) / (2**ann_codes.PLANES - 1)
        rounded = np.rint((turned - turned.min()) / step) * step + turned.min()
        np.testing.assert_allclose(estimate, signs @ rounded * length / fit / 8, rtol=1e-4, atol=1e-4)


def test_places_as_lists_and_bits():
    rng = np.random.default_rng(6)
    for n in (1, 9, 200, 70_000):
        for share in (0, 0.01, 0.5, 1):
            at = np.flatnonzero(rng.random(n) < share)
            raw = ann_codes._pack_places(at, n)
            assert ann_codes._places(raw, n).tolist() == at.tolist() and len(raw) <= 2 + -(-n // 8)


def test_codewords_differ():
    for n in (2, 4, 7, 12):
        code = language_codes.codewords(n)
        apart = (code[:, None] != code[None]).sum(-1) + np.eye(n, dtype=int) * 99
        assert apart.min() >= max(1, code.shape[1] // 3)


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_codes.learn(docs, fold(4) != 2)
    found = language_codes.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold(4) == 2)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.95
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !! ?", "x"), (4, "Ж", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language_codes.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[4].lang_pred != "und"
    assert {r.lang_pred for r in language_codes.predict(odd, None).collect()} == {"und"}
    assert language_codes.learn(docs.limit(0), fold(4) != 2) is None


def test_quality_held_out(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_subword.learn(docs, labels, fold(3) != 1)
    scored = quality_subword.score(docs, model).join(labels, "doc_id").where(fold(3) == 1)
    assert scored.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] >= 0.9
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a " * 30000, 0)], "doc_id long, text string, score int")
    got = quality_subword.score(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 3
    none = quality_subword.learn(docs, labels.limit(0), fold(3) != 1)
    assert {r.score for r in quality_subword.score(odd, none).collect()} == {0.5}


def test_decoding_equals_a_plain_loop():
    rng = np.random.default_rng(6)
    languages = ("a", "b", "c", "d")
    code = language_codes.codewords(4)
    model = language_codes.Model(languages, code, rng.standard_normal((language_codes.BUCKETS, code.shape[1])).astype(np.float32), rng.standard_normal(code.shape[1]).astype(np.float32), rng.random(code.shape[1]).astype(np.float32))
    raw = [b"one two three", "für élan".encode(), b"x", b"", b"12 !", "Жизнь".encode()]
    x = language_codes.features(raw)
    lang, score, unsure = language_codes.decide(raw, model)
    for i, text in enumerate(raw):
        plain = {}
        flat = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text + b" "]
        for at in range(len(flat)):  # the hashed n-grams of the features, one by one
            h = (flat[at] + 0x9E37) & 0xFFFFFFFF
            for n in range(3):
                if n:
                    if at + n >= len(flat):
                        break
                    h = ((h * 0x01000193) & 0xFFFFFFFF) ^ flat[at + n]
                bucket = ((h * 0x9E3779B1) & 0xFFFFFFFF) >> 20
                plain[bucket] = plain.get(bucket, 0) + 1
        want = np.zeros(language_codes.BUCKETS)
        for k, v in plain.items():
            want[k] = v**0.5
        np.testing.assert_allclose(x[i], want / np.linalg.norm(want), rtol=1e-4, atol=1e-6)
        if not any(c.isalpha() for c in text.decode()):
            assert (lang[i], score[i], unsure[i]) == ("und", 0, False)
            continue
        loss = [sum(t * np.log1p(np.exp(-c * (float(x[i] @ w) + b))) for c, w, b, t in zip(word, model.weights.T, model.bias, model.trust, strict=True)) for word in code]
        share = np.exp(min(loss) - np.array(loss)) / np.exp(min(loss) - np.array(loss)).sum()
        assert lang[i] == languages[int(np.argmin(loss))] and abs(score[i] - share.max()) < 1e-4
        assert unsure[i] == (np.sort(share)[-1] - np.sort(share)[-2] < language_codes.AMBIGUOUS)


def test_learning_equals_a_plain_loop():
    """The subword model's gradient descent, vector by vector."""
    raw, y = [b"good words here", b"bad bad stuff", "très bon".encode(), b"stuff"], np.array([1, 0, 1, 0])
    model = quality_subword.fit(quality_subword._bags(raw), y, dim=3, epochs=2, rate=0.5)
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / 3, 1 / 3, (quality_subword.BUCKETS, 3))
    top, bias, step = np.zeros((2, 3)), np.zeros(2), 0
    for _ in range(2):
        for i in rng.permutation(4):
            words = raw[i].split()
            hashes = quality_subword.word_hashes(words)
            used = [*quality_subword.word_buckets(words, hashes)[1].tolist(), *quality_subword.pair_buckets(hashes, np.zeros(len(words), int))[1].tolist()]
            rate = 0.5 * (1 - step / 8)
            step += 1
            mean = sum(vectors[b] for b in used) / len(used)
            z = top @ mean + bias
            g = np.exp(z) / np.exp(z).sum() - np.eye(2)[y[i]]
            back = g @ top
            top, bias = top - rate * np.outer(g, mean), bias - 0.1 * rate * g
            for b in used:
                vectors[b] = vectors[b] - rate * back / len(used)
    np.testing.assert_allclose(model.part, vectors @ (top[1] - top[0]), atol=1e-5)
    assert abs(model.bias - (bias[1] - bias[0])) < 1e-5


def test_subwords_are_characters():
    def grams(word):
        marked = f"<{word}>"
        return sorted(marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1))

    def bucket(gram):
        h = ord(gram[0]) + 1
        for c in gram[1:]:
            h = (h * 0x100000001B3 + ord(c)) % 2**64
        return ((h + len(gram) - 1) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality_subword.BITS)

    words = ["élan", "für", "a", "日本語", "plain"]
    at, got = quality_subword.word_buckets([w.encode() for w in words], quality_subword.word_hashes([w.encode() for w in words]))
    for i, w in enumerate(words):
        assert sorted(got[at == i].tolist()[1:]) == sorted(bucket(g) for g in grams(w)), w


def test_models_take_odd_tables(spark, sf_dir):
    """Repeated rows, null ids, ties, and columns that clash."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "x"), (None, "a b c", "x")], "doc_id long, text string, score string")
    model = quality_subword.learn(docs, labels, fold(3) != 1)
    got = quality_subword.score(odd, model).collect()
    assert len(got) == 3 and got[0].score == got[1].score
    assert quality_subword.score(odd.limit(0), model).count() == 0 and quality_subword.keep(odd, model).columns == odd.columns
    tie = quality_subword.score(odd, quality_subword.Model(np.zeros(quality_subword.BUCKETS), 0.0)).collect()
    assert {(r.score, r.predicted) for r in tie} == {(0.5, 1)}
    same = language_codes.Model(("a", "b"), language_codes.codewords(2), np.zeros((language_codes.BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    got = language_codes.predict(odd, same).collect()
    assert len(got) == 3 and {(r.lang_pred, r.score, r.ambiguous) for r in got} == {("a", 0.5, True)}
    long = spark.createDataFrame([(5, "the and " * 60_000)], "doc_id long, text string")
    assert language_codes.predict(long, same).count() == 1 and language_codes.predict(long.limit(0), same).count() == 0


def test_word_sums_equal_bags():
    rng = np.random.default_rng(2)
    model = quality_subword.Model(rng.standard_normal(quality_subword.BUCKETS), 0.3)
    raw = [b"one two two three", "für élan für".encode(), b"", b"x"]
    scorer = quality_subword.Scorer(model)
    for s, (which, share) in zip(scorer.scores(raw), quality_subword._bags(raw), strict=True):
        assert abs(s - 1 / (1 + np.exp(-(share.astype(float) @ model.part[which] + 0.3)))) < 2e-3
