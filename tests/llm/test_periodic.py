import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import periodic, queries


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute(words):
    """Runs from the definition: of every start the longest stretch of every period, then only the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(24, 3 * q):
                found.setdefault((at, end + q - at), q)
            at = end + 1
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_kept(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def got(spark, texts, **how):
    rows = periodic.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **how).orderBy("doc_id").collect()
    return [(r.n_words, [tuple(x) for x in r.runs], r.peak and tuple(r.peak), r.collapsed) for r in rows]


def texts_with_runs(seed, n):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.integers(1, 5)):
            unit = [str(x) for x in r.integers(0, 3, r.integers(1, 12))]
            parts += unit * int(r.integers(1, 12)) + unit[: r.integers(0, len(unit))] + [str(x) for x in r.integers(0, 9, r.integers(0, 20))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("how", [{}, {"long_text": 10, "lags_a_row": 3, "compared_a_row": 1}, {"long_text": 60}])
def test_runs_against_brute_force(spark, how):
    texts = [*texts_with_runs(3, 60), None, "", "   ", "a" * 5000, "y " * 400, "a b " * 13, "a b " * 8, "a B A b " * 9, "x", "é\u00a0 é\u00a0 " * 20]
    texts += texts[:5]
    for text, (n, runs, peak, kept) in zip(texts, got(spark, texts, **how), strict=True):
        words = split(text)
        want = brute(words)
        assert n == len(words) and runs == want and kept == brute_kept(words, want)
        assert peak == max(want, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def test_limits_other_than_the_contracts(spark):
    (_, runs, _, _), = got(spark, ["a b c d e f g h i j " * 3], least_length=30, least_exponent=3)
    assert runs == [(0, 30, 10)]
    (_, runs, _, _), = got(spark, ["a b c d e f g h i j " * 3], least_length=24, least_exponent=4)
    assert runs == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), least_length=5)


def test_a_long_text_is_scanned_by_many_rows(spark):
    r = np.random.default_rng(1)
    head, unit = [str(x) for x in r.integers(0, 10**6, 9000)], [str(x) for x in r.integers(0, 10**6, 3500)]
    text = " ".join(head + unit * 3 + ["end"])
    (n, runs, peak, kept), = got(spark, [text], long_text=1000)
    assert n == 19501 and runs == [(9000, 10500, 3500)] and peak == (9000, 10500, 3500) and kept == " ".join([*head, *unit, "end"])


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a " * 30, "r"), (1, None, "r"), (1, "b " * 30, None)], "doc_id long, text string, runs string").withColumn("ids", F.lit(1)).withColumn("first", F.lit(0))
    assert sorted((r.doc_id or 0, len(r.runs)) for r in periodic.periodic_runs(df).collect()) == [(0, 1), (1, 0), (1, 1)]
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    some = 0
    for d in docs:
        words, h = split(d.text), zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        some += len(runs)
        r = rows[d.doc_id]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_kept(words, runs).encode()).hexdigest()
    assert some > 10
