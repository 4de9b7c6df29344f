import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import clusters as C
from lodestrata.plans import catalog


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")


def plain(hashes, q, largest, fan, steps):
    """Cells as sets of places, by plain loops over whole numbers."""
    done, waiting = [], [list(range(len(q)))]
    while waiting:
        rows = waiting.pop()
        k = min((len(rows) + largest - 1) // largest, fan)
        by_hash = {hashes[r]: q[r] for r in rows}
        centres = [by_hash[h] for h in sorted(by_hash)[:k]]
        if len(centres) < 2:
            done.append(frozenset(rows))
            continue
        near = lambda r: min(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(q[r], centres[c])), c))  # noqa: B023, E731
        for _ in range(steps):
            parts = [[] for _ in centres]
            for r in rows:
                parts[near(r)].append(r)
            centres = [[sum(q[r][j] for r in p) // len(p) for j in range(len(c))] if p else c for p, c in zip(parts, centres)]
        parts = [[] for _ in centres]
        for r in rows:
            parts[near(r)].append(r)
        parts = [p for p in parts if p]
        if len(parts) < 2:
            done.append(frozenset(rows))
        else:
            waiting += parts
    return set(done)


def cells(rows):
    found = {}
    for r in rows:
        found.setdefault(r.cell, set()).add(r.vec_id)
        assert r.size >= 1
    return found


def test_partition_equals_plain_loops_wherever_cells_are_cut(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(230, 5)), np.tile(r.normal(size=5), (60, 1)), r.normal(size=(10, 5)) * 5])
    df = frame(spark, x)
    whole, _ = C._whole(C._sound(df))
    got = whole.orderBy("vec_id").collect()
    want = plain([w.h for w in got], [w.q for w in got], 20, 6, 3)
    one = C.kmeans_partition(df, fan=6, steps=3).collect()
    many = C.kmeans_partition(df.repartition(7), fan=6, steps=3, rows_a_task=25).collect()
    assert {frozenset(c) for c in cells(one).values()} == want
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    sizes = {c: len(v) for c, v in cells(one).items()}
    assert all(r.size == sizes[r.cell] and r.kept == (r.size > 10) for r in one)
    # equal vectors cannot be cut; all else is
    assert sorted(sizes.values())[-1] == 60 and sorted(sizes.values())[-2] <= 20


def test_odd_vectors_and_small_tables(spark):
    rows = [(k, [float(k), 1.0]) for k in range(30)] + [(50, None), (51, []), (52, [1.0]), (53, [float("nan"), 1.0]), (54, [None, 1.0]), (None, [1.0, 1.0]), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("q", F.lit(1))
    got = C.kmeans_partition(df).collect()
    assert sorted(r.vec_id for r in got) == [0, *range(30), 50, 51, 52, 53, 54]
    odd = {(r.cell, r.size) for r in got if r.vec_id >= 50}
    assert len(odd) == 1 and odd.pop()[1] == max(r.size for r in got)
    assert {(r.cell, r.size, r.kept) for r in C.kmeans_partition(df.limit(4)).collect()} == {("", 4, True)}
    assert C.kmeans_partition(df.limit(0)).count() == 0 and C.mixture_tree(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(k, None) for k in range(25)], "vec_id long, embedding array<double>")
    assert {(r.cell, r.size) for r in C.kmeans_partition(nothing).collect()} == {("", 25)}
    assert [tuple(r) for r in C.mixture_tree(df.where("vec_id = 3")).collect()] == [(0, "3", None, 1)]


def test_mixture_equals_numpy_and_its_likelihood_never_falls(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(150, 3)) * [1, 2, 0.5], r.normal(size=(100, 3)) + [3, 0, 1], r.normal(size=(50, 3)) * 0.3 - 2])
    rows = frame(spark, x).repartition(5).withColumnRenamed("embedding", "x")
    start, length = x[[0, 160, 260]], 1 + 3 * (1 + 3 + 9)
    here, seen = C.fit_mixture(lambda f: f(x), start, gain=1e-9)
    spread, also = C.fit_mixture(lambda f: C._spread_sum(rows, f, length), start, rounds=6, gain=1e-9)
    assert len(seen) > 6 and all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))
    assert np.allclose(seen[:6], also)
    # one round by hand, from the definition
    at = np.argmin(((x[:, None] - start) ** 2).sum(axis=2), axis=1)
    dens = np.stack([(at == c).mean() * np.exp(-0.5 * np.einsum("nd,de,ne->n", x - x[at == c].mean(0), np.linalg.inv(s := np.cov(x[at == c].T, bias=True) + 1e-6 * np.eye(3)), x - x[at == c].mean(0))) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(s)) for c in range(3)], axis=1)
    assert np.isclose(seen[0], np.log(dens.sum(axis=1)).mean())


@pytest.mark.parametrize("n", [2, 7, 60])
def test_tree_levels(spark, n):
    x = np.random.default_rng(5).normal(size=(n, 4)) + 4 * (np.arange(n) % 3)[:, None]
    rows = C.mixture_tree(frame(spark, x, 100)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.level, {})[r.id] = r
    assert sorted(by[0]) == sorted(str(100 + k) for k in range(n)) and all(r.n == 1 for r in by[0].values())
    assert max(by) <= 3 and all(r.parent is None for r in by[max(by)].values())
    for level in range(1, max(by) + 1):
        assert len(by[level]) <= min(10, max(1, len(by[level - 1]) // 2))
        assert sum(r.n for r in by[level].values()) == n
        for node in by[level].values():
            assert node.n == sum(r.n for r in by[level - 1].values() if r.parent == node.id)


def test_queries_take_all_vectors(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert catalog.queries()["kmeans_partition"](spark, sf_dir).count() == n
    assert catalog.queries()["mixture_tree"](spark, sf_dir).where("level = 0").count() == n
