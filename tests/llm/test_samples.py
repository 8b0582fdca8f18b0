"""What reaches the driver, or one task, is bounded whatever the tables hold."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm import common, language_codes, quality_subword, rule_cascade


def test_sample_takes_the_smallest_hashes(spark):
    ids = [*range(3000), *[7] * 4000]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "k long, text string").repartition(4)
    want = {r.k for r in df.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(20).collect()}
    got = common.sample(df, "k", 20).collect()
    assert len(got) <= 20 and {r.k for r in got} <= want
    few = spark.createDataFrame([(7, "a")] * 1000, "k long, text string")
    assert len(common.sample(few, "k", 5).collect()) == 5 and common.sample(few.limit(0), "k", 5).count() == 0


def test_a_language_of_one_repeated_id_is_learnt(spark):
    rows = [(i, "the cat and the dog are here", "en") for i in range(900)] + [(5, f"der hund und die katze {i}", "de") for i in range(700)] + [(None, "le chat", "fr")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_codes.learn(docs, F.lit(True), 40)
    assert model.languages == ("de", "en", "fr")
    got = {r.lang_pred for r in language_codes.predict(docs.where("lang = 'de'"), model).collect()}
    assert got == {"de"}


def test_the_language_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50, f"words {i} and more", "en" if i % 3 else "de") for i in range(6000)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_codes, "fit", lambda x, y, languages: seen.append(np.bincount(y).tolist()))
    language_codes.learn(docs, F.lit(True), 30)
    assert seen == [[30, 30]]


def test_texts_stay_with_the_executors(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 200_000 + f" w{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_subword, "fit", lambda bags, y: seen.append(sum(which.nbytes + share.nbytes for which, share in bags)) or quality_subword.Model(np.zeros(quality_subword.BUCKETS), 0.0))
    quality_subword.learn(docs, labels, F.lit(True))
    assert 0 < seen[0] < 40 * 2000  # a long word's n-grams are few different ones


def test_rules_are_ordered_in_a_task(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(300)], "doc_id long, text string")
    assert sorted(rule_cascade.measured_order(docs, 50)) == sorted(r.name for r in rule_cascade.RULES) == sorted(rule_cascade.measured_order(docs.limit(0)))
