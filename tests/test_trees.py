import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import trees as T
from lodestrata.session import written

SHAPE = "key string, id long, ts timestamp, vector array<double>"
START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def made(seed, n, keys, size=3):
    r = np.random.default_rng(seed)
    return [(f"k{int(r.integers(0, keys))}", k, START + dt.timedelta(seconds=k // 3), r.normal(size=size).tolist()) for k in range(n)]


def plain(rows, base, rate, deep):
    """The trees as sets of (key, node, parent, depth, id, n), by lists and loops."""
    trees = {}

    def leaf(t, parent, row, n, v):
        t.append({"parent": parent, "depth": t[parent]["depth"] + 1, "id": row, "n": n, "v": v})

    for key, row, _, v in sorted(rows, key=lambda x: (x[2], x[1])):
        t = trees.setdefault(key, [{"depth": 0, "parent": None}])
        at, path = 0, []
        while True:
            best, near = None, None
            for k, node in enumerate(t):
                if k and node["parent"] == at:
                    s = round(sum(a * b for a, b in zip(node["v"], v)) / math.sqrt(sum(a * a for a in node["v"]) * sum(a * a for a in v)), 9)
                    if near is None or s > near:
                        best, near = k, s
            if best is None or near <= base * math.exp(rate * (t[at]["depth"] + 1) / deep):
                break
            at = best
            path.append(at)
        leaf(t, at, row, 1, v)
        if path:
            was = dict(t[at])
            for k in path:
                t[k]["v"], t[k]["n"], t[k]["id"] = [(a * t[k]["n"] + b) / (t[k]["n"] + 1) for a, b in zip(t[k]["v"], v)], t[k]["n"] + 1, None
            leaf(t, at, was["id"], was["n"], was["v"])
    return {(key, k, n["parent"], n["depth"], n["id"], n["n"], *(round(a, 6) for a in n["v"])) for key, t in trees.items() for k, n in enumerate(t) if k}


def tuples(df):
    return {(r.key, r.node, r.parent, r.depth, r.id, r.n, *(round(a, 6) for a in r.vector)) for r in df.collect()}


@pytest.mark.parametrize("base, rate, deep", [(0.4, 0.5, 8), (0.8, 0.1, 3), (-2.0, 0.0, 1), (2.0, 1.0, 4)])
def test_trees_equal_plain_insertion_and_go_on_from_stored_rows(spark, base, rate, deep):
    rows, shape = made(1, 120 if base > 0 else 40, 3), T.Shape(base, rate, deep)
    df = spark.createDataFrame(rows, SHAPE).repartition(5).withColumn("node", F.lit("x"))
    want = plain(rows, base, rate, deep)
    assert tuples(T.grown_trees(df, shape)) == want
    half = written(T.grown_trees(df.where("id < 30"), shape), "trees")
    assert tuples(T.grown_trees(df.where("id >= 30"), shape, half)) == want
    assert tuples(T.grown_trees(df.limit(0), shape, half)) == tuples(half)
    depths = {r[3] for r in want}
    assert max(depths) > 2 if base < 1 else depths == {1}


def test_odd_rows(spark):
    t = START
    rows = [("a", 1, t, [1.0, 0.0]), ("a", 1, t, [1.0, 0.0]), ("a", 2, t, None), ("a", 3, t, [0.0, 0.0]), ("a", 4, t, [None, 1.0]), ("a", 5, t, [float("inf"), 1.0]), (None, 6, t, [1.0, 0.0]), ("a", None, t, [1.0, 0.0]), ("a", 7, None, [1.0, 0.0]), ("a", 8, t, [1.0, 0.0, 0.0]), ("a", 9, t, [])]
    df = spark.createDataFrame(rows, SHAPE)
    got = sorted((r.node, r.parent, r.depth, r.id, r.n) for r in T.grown_trees(df, T.Shape()).collect())
    # the copy joins its twin, whose former self stands beside it; a vector of another length meets no other node
    assert got == [(1, 0, 1, None, 2), (2, 1, 2, 1, 1), (3, 1, 2, 1, 1), (4, 0, 1, 8, 1)]
    assert T.grown_trees(df.limit(0), T.Shape()).count() == 0
    stored = spark.createDataFrame([("a", 5, 0, 1, 1, 1, [1.0])], f"key string, {T.NODE}")
    with pytest.raises(Exception, match="stored tree"):
        T.grown_trees(df, T.Shape(), stored).collect()
