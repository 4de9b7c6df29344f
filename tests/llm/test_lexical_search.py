import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrata.llm import lexical_search

TERM = re.compile("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        found = []
        for place, (d, bag) in enumerate(bags):
            tf, score = Counter(bag), 0
            for t in terms(text):
                if tf[t]:
                    m = 25 + (75 * len(bag) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, d if d is not None else -1, place))
        out += [(item, rank, None if d == -1 else d, -s) for rank, (s, d, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, k=10, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x")).withColumn("score", F.lit(1)).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)).withColumn("query", F.lit("y"))
    found = lexical_search.search(d, q, k, **how)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def texts(seed, n, most=40):
    r = np.random.default_rng(seed)
    return [" ".join(f"W{int(x)}" for x in r.zipf(1.3, int(r.integers(0, most))) if x < 500) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_against_brute_force(spark, k):
    docs, items = list(enumerate(texts(1, 300))), list(enumerate(texts(2, 25, 15)))
    docs += [(d + 1000, t) for d, t in docs[:40]] + [(2000 + k, docs[5][1]) for k in range(30)]
    assert got(spark, docs, items, k, slack=k) == brute(docs, items, k)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "One two,two THREE"), (3, "One two,two THREE"), (3, "one"), (4, "caf\u00e9 \u00c9t\u00e9 x1"), (5, "word " * 20_000 + "rare"), (6, "..."), (7, "one"), (7, "one")]
    items = [(1, "ONE two two"), (1, "ONE two two"), (2, None), (3, "caf\u00c9 caf\u00e9"), (None, "rare word"), (4, "nothing here"), (5, "")]
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == [] and got(spark, [(1, "a b")], []) == []


def test_vocabularies_too_large_for_tasks_and_broadcasts(spark, monkeypatch):
    docs, items = list(enumerate(texts(3, 120))), list(enumerate(texts(4, 12)))
    monkeypatch.setattr(lexical_search, "MAX_TERMS_IN_TASKS", 3)
    monkeypatch.setattr(lexical_search, "MAX_BROADCAST_ROWS", 3)
    monkeypatch.setattr(lexical_search, "MAX_PAIRS_IN_TASKS", 20)
    monkeypatch.setattr(lexical_search, "MAX_BROADCAST_CANDIDATES", 3)
    assert got(spark, docs, items) == brute(docs, items)


def test_query_equals_its_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = c.execute(entry.oracle_sql()["op11_lexical_search"]).fetchall()
    assert len(want) > 100
    found = entry.queries()["op11_lexical_search"](spark, sf_dir)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, found.collect())) == sorted(want)
