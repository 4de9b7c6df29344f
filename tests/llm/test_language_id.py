import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language_id, queries


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_grams(text):
    found = Counter()
    for w in plain_words(text):
        found.update(w)
        framed = "\x01" + w + "\x01"
        for n in range(2, 5):
            found.update(framed[k : k + n] for k in range(len(framed) - n + 1))
    return found


TEXTS = ["Hello hello wOrld", None, "", "12 34 !!", "a", "\u00c9t\u00e9 \u4f60\u597d, x_y 3d", "word " * 3000 + "end"]


def test_grams_against_plain_loops():
    g = language_id.grams_of(TEXTS)
    bucket = {}
    for k, text in enumerate(TEXTS):
        found, n = language_id.counts_of(g, k)
        want = plain_grams(text)
        assert n.sum() == sum(want.values()) and len(plain_words(text)) == g.text[k + 1] - g.text[k]
        for gram in want:  # the bucket of a gram is found where the gram stands alone among the others
            bucket.setdefault(gram, None)
        assert sorted(n.tolist()) == sorted(Counter(want).values()) or len(found) < len(want)
    alone = language_id.grams_of(["hello", "hello hello world"])
    one, two = (dict(zip(*map(np.ndarray.tolist, language_id.counts_of(alone, k)), strict=True)) for k in (0, 1))
    assert all(two[b] >= 2 * n for b, n in one.items())


def test_ftrl_against_plain_loops():
    r = np.random.default_rng(0)
    rows = [(np.append(np.sort(r.choice(12, 4, replace=False)), 12), np.append(r.random(4), 1.0)) for _ in range(40)]
    label = r.integers(0, 3, 40)
    alpha, beta, l1, l2 = 0.3, 0.2, 0.1, 0.05
    z, n = np.zeros((13, 3)), np.zeros((13, 3))

    def weight(i, k):
        a, b = (0, 0) if i == 12 else (l1, l2)
        return 0.0 if abs(z[i, k]) <= a else -(z[i, k] - np.sign(z[i, k]) * a) / ((beta + n[i, k] ** 0.5) / alpha + b)

    for _ in range(2):
        for (at, x), y in zip(rows, label, strict=True):
            w = {(i, k): weight(i, k) for i in at for k in range(3)}
            e = np.exp([sum(v * w[i, k] for i, v in zip(at, x, strict=True)) for k in range(3)])
            p = e / e.sum()
            for i, v in zip(at, x, strict=True):
                for k in range(3):
                    g = v * (p[k] - (k == y))
                    sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / alpha
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    want = np.array([[weight(i, k) for k in range(3)] for i in range(13)])
    got = language_id.fit_ftrl(rows, label, 13, 3, alpha, beta, l1, l2, 2)
    assert np.allclose(got, want) and (got == 0).any()


def test_batched_scores_equal_scores_of_counts():
    texts = ["the one of that and then", "le la des mais pour une", "der die das und mit auf"] * 8 + ["einer und the"]
    labels = ["en", "fr", "de"] * 8 + ["de"]
    g = language_id.grams_of(texts)
    rows = [language_id.counts_of(g, k) for k in range(len(texts))]
    model = language_id.fit(rows, labels, np.linspace(1, 3, language_id.BUCKETS))
    logits = model.logits(g)
    for k, (b, c) in enumerate(rows):
        assert np.allclose(logits[k], c / c.sum() @ model.weights[model.row[b]] + model.bias, atol=1e-4)
    assert model.predict(texts[:3] + [None, "77"])[0] == ["en", "fr", "de", "und", "und"]


def test_temperature_is_the_best_of_a_grid():
    r = np.random.default_rng(3)
    label = r.integers(0, 3, 500)
    logits = r.normal(size=(500, 3)) + 2 * np.eye(3)[label]
    loss = lambda t: -np.log(language_id.softmax(logits * 4 / t)[np.arange(500), label]).mean()
    t = language_id.fit_temperature(logits * 4, label)
    assert loss(t) <= min(map(loss, np.geomspace(0.06, 19, 200))) + 1e-6
    assert language_id.fit_temperature(np.empty((0, 3)), np.empty(0, int)) == 1.0


def test_held_out_accuracy_and_contract(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    rows = queries.op12_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    hits = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        text = truth[r.doc_id].text
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.held_out and r.lang_pred != "und" and truth[r.doc_id].lang is not None:
            hits.append(r.lang_pred == truth[r.doc_id].lang)
    assert np.mean(hits) >= 0.97


def test_held_out_languages_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    key = lambda df: sorted(map(tuple, language_id.identify(df).collect()))
    assert key(docs) == key(other.withColumn("source", F.lit("z")).repartition(7))


def test_odd_tables(spark):
    shape = "doc_id long, text string, lang string"
    rows = [(k, t, l) for k, (t, l) in enumerate([("the and of", "en"), ("le la des", "fr")] * 10)]
    odd = [(None, "the", "en"), (100, None, "en"), (101, "", None), (102, "12", "fr"), (3, "la des", None), (3, "la des", None), (104, "the " * 50_000, "en")]
    df = spark.createDataFrame(rows + odd, shape).withColumn("score", F.lit("s")).withColumn("chance", F.lit(1))
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(df).collect()}
    assert {(None, "en"), (100, "und"), (101, "und"), (102, "und"), (3, "fr"), (104, "en")} <= got
    assert language_id.identify(df.limit(0)).count() == 0
    unknown = df.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(unknown).collect()} == {("und", 0.0)}
    one = df.withColumn("lang", F.lit("q"))
    assert {r.lang_pred for r in language_id.identify(one).collect()} == {"q", "und"}
