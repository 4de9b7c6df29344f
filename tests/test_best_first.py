import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph
from lodestrata.plans import graph_queries


def plain(edges, concepts, starts, most=None, goals=()):
    near, of = {}, {}
    for a, b, w in edges:
        if w is not None and w > 0 and a != b:
            for p, q in ((a, b), (b, a)):
                near.setdefault(p, {})[q] = min(near.get(p, {}).get(q, np.inf), 1 / w)
    for n, c in concepts:
        if c is not None:
            of.setdefault(n, set()).add(c)
    best, heap, settled, seen = {}, [], [], set()
    for n, s in starts:
        if s > 0 and 1 / s < best.get(n, np.inf):
            best[n] = 1 / s
            heapq.heappush(heap, (1 / s, n))
    while heap and (most is None or len(settled) < most):
        d, n = heapq.heappop(heap)
        if d > best[n] or any(n == x for x, _, _ in settled):
            continue
        new = of.get(n, set()) - seen
        settled.append((n, d, bool(new)))
        if n in goals:
            break
        seen |= new
        if new:
            for q, length in near.get(n, {}).items():
                if d + length < best.get(q, np.inf):
                    best[q] = d + length
                    heapq.heappush(heap, (best[q], q))
    return settled


@pytest.fixture(scope="module")
def made():
    r = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 60, 160), r.integers(0, 60, 160), r.choice([0.25, 0.4, 0.5, 1.0, 0.8], 160), strict=True)] + [(1, 2, 0.0), (1, 3, -1.0), (4, 5, None)]
    concepts = [(n, f"c{int(c)}") for n in range(60) for c in r.integers(0, 25, 2)] + [(3, None)]
    starts = {1: [(0, 0.9), (7, 0.3), (0, 0.5)], 2: [(30, 1.0)], 3: [(99, 0.5)], 4: [(5, 0.0)]}
    return edges, concepts, starts


@pytest.mark.parametrize("most, goal", [(None, None), (9, None), (None, 17), (30, 17)])
def test_traversal_equals_a_plain_heap(spark, made, most, goal):
    edges, concepts, starts = made
    goals = spark.createDataFrame([(1, goal), (2, goal), (2, 1000)], "query_id long, node long") if goal else None
    found = graph.best_first(
        spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(concepts, "node long, concept string"),
        spark.createDataFrame([(q, n, s) for q, one in starts.items() for n, s in one], "query_id long, node long, similarity double"), most, goals,
    ).orderBy("query_id", "place").collect()
    for q, one in starts.items():
        want = plain(edges, concepts, one, most, {goal} if goal and q < 3 else ())
        got = [(r.node, round(r.distance, 9), r.expanded) for r in found if r.query_id == q]
        assert [(n, round(d, 9), x) for n, d, x in want] == got


def test_no_starts_and_rounds_that_do_not_end(spark, made):
    edges, concepts, _ = made
    e, c = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(concepts, "node long, concept string")
    s = spark.createDataFrame([(1, 0, 1.0)], "query_id long, node long, similarity double")
    assert graph.best_first(e, c, s.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        graph.best_first(e, c, s, max_rounds=1)


def test_query_equals_a_plain_heap(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '5-LOW'").collect()
    edges = [(a, b, 1 / (1 + (a + b) % 4)) for a, b in {(r.o_custkey, r.o_orderkey * 31 % 1009) for r in o}]
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("k", F.floor(F.col("c_acctbal") / 500)).collect()
    concepts = [(r.c_custkey, f"{r.c_nationkey}-{r.k}") for r in c]
    found = graph_queries.best_first_traversal(spark, sf_dir).orderBy("query_id", "place").collect()
    assert len(found) > 20
    for q in range(5):
        starts = [(r.c_custkey, 0.5) for r in c if r.c_custkey % 40 == 1 and r.c_custkey < 200 and r.c_custkey // 40 == q]
        assert [(r.node, r.distance) for r in found if r.query_id == q] == [(n, d) for n, d, _ in plain(edges, concepts, starts, 40)]
