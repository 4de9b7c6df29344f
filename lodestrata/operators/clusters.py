"""Partitions of vectors: k-means cells that are cut until they are small, and trees of Gaussian mixtures.

Cells that hold more rows than a task should are cut by rounds in which slices of a cell add up their own sums; a cell that fits a task is cut
to the end there. Both ways count in whole numbers, so the result depends neither on the order of rows nor on where a cell is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import small, written

#: Components are whole multiples of the largest one's 2^-20: products of up to 2,000 components then add up exactly in double precision.
BITS = 20


def _sound(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of doubles, null where the vector is null or empty or has null or non-finite components); rows without vec_id are left out."""
    x = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("x") > 0)
    return x.select("vec_id", F.when(sound, F.col("x")).alias("x"))


def _whole(vectors: DataFrame) -> tuple[DataFrame, float]:
    """vec_id, q (array of whole numbers) and h (a hash of q) of vectors (vec_id, x), and the unit of q; vectors of another length than the longest have null q."""
    seen = vectors.agg(F.max(F.size("x")).alias("size"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("top")).first()
    unit = (seen.top or 1.0) / 2**BITS
    q = F.when(F.size("x") == (seen.size or 0), F.transform("x", lambda v: F.round(v / F.lit(unit)).cast("long")))
    return vectors.select("vec_id", q.alias("q")).withColumn("h", F.xxhash64("q")), unit


def _matrix(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1).astype(float) if len(array) else np.empty((0, 0))


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (x.shape[1] if len(x) else 0), pa.int32()), pa.array(x.reshape(-1), kind))


def _nearest(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (q @ centres.T), axis=1)


def _sums(q: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((k, q.shape[1]), np.int64)
    np.add.at(total, at, q.astype(np.int64))
    return total, np.bincount(at, minlength=k)


def _moved(q: np.ndarray, centres: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        total, n = _sums(q, _nearest(q, centres), len(centres))
        moved = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _cut(q: np.ndarray, h: np.ndarray, cell: str, largest: int, fan: int, steps: int) -> Iterator[tuple[np.ndarray, str]]:
    """The places of the rows of each last cell, and its name."""
    waiting = [(np.arange(len(q)), cell)]
    while waiting:
        rows, name = waiting.pop()
        k = min(-(-len(rows) // largest), fan)
        first = rows[np.unique(h[rows], return_index=True)[1][:k]]
        if len(first) < 2:
            yield rows, name
            continue
        at = _nearest(q[rows], _moved(q[rows], q[first], steps))
        parts = np.unique(at)
        if len(parts) < 2:
            yield rows, name
            continue
        waiting += [(rows[at == p], f"{name}/{p}") for p in parts]


def _centres(rows: DataFrame, cells: DataFrame, fan: int, steps: int) -> DataFrame:
    """cell, at (number of the centre), q: the centres after `steps` rounds, for all cells (cell, k, slices) together. rows: cell, slice, q, h.

    A centre begins at a distinct vector of the cell, in the order of hashes, and one that loses all rows stays where it is.
    """
    distinct = rows.groupBy("cell", "h").agg(F.min("q").alias("q"))
    first = distinct.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("h"))).where(F.col("at") <= fan)
    centres = first.join(small(cells), "cell").where("at <= k").select("cell", (F.col("at") - 1).alias("at"), "q")
    centres = written(centres, "centres")

    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("at")
        total, n = _sums(_matrix(left["q"]), _nearest(_matrix(left["q"]), _matrix(right["q"])), len(right)) if len(left) and len(right) else (np.empty((0, 0), np.int64), np.empty(0, np.int64))
        return pa.table({"cell": pa.array([key[0].as_py()] * len(n), pa.string()), "at": pa.array(np.arange(len(n)), pa.int32()), "n": pa.array(n, pa.int64()), "q": _lists(total, pa.int64())})

    for _ in range(steps):
        parts = rows.groupBy("cell", "slice").cogroup(_sliced(centres, cells).groupBy("cell", "slice")).applyInArrow(add, "cell string, at int, n long, q array<long>")
        sums = parts.where("n > 0").select("cell", "at", "n", F.posexplode("q").alias("p", "v")).groupBy("cell", "at", "p").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        mean = F.struct("p", F.expr("(v - pmod(v, n)) div n").alias("m"))
        moved = sums.groupBy("cell", "at").agg(F.array_sort(F.collect_list(mean)).getField("m").alias("moved"))  # one entry for each component
        centres = written(centres.join(moved, ["cell", "at"], "left").select("cell", "at", F.coalesce("moved", "q").alias("q")), "centres")
    return centres


def _sliced(centres: DataFrame, cells: DataFrame) -> DataFrame:
    return centres.join(small(cells), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "at", "q")


def _dealt(state: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of the cells, with their slice, kept where they are for all rounds: only centres and sums move."""
    dealt = state.join(small(cells), "cell").withColumn("slice", F.pmod(F.xxhash64("vec_id", "h"), F.col("slices")).cast("int"))
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select("cell", "slice", "vec_id", "q", "h").repartition(parts, "cell", "slice").persist(StorageLevel.MEMORY_AND_DISK)


def kmeans_partition(vectors: DataFrame, largest: int = 20, smallest: int = 10, fan: int = 64, steps: int = 8, rows_a_task: int = 20_000) -> DataFrame:
    """vec_id, cell, size, kept: vectors (vec_id, embedding) in cells of `largest` rows at most; kept says that a cell has more than `smallest`, or that all rows are one cell.

    A cell of more rows is cut into size / largest parts, `fan` at most, by k-means from distinct vectors of it; what is still too large is cut again. Cells of
    equal vectors stay whole. A cell's name is the path of the parts that it came from. Rows without a sound vector (null, empty, of another length than the longest, or with null
    or non-finite components) go to the largest cell; rows without vec_id are left out; a repeated vec_id is a row like any other.
    """
    rows, _ = _whole(_sound(vectors))
    rows = written(rows, "whole")
    bare = rows.where("q is null")
    total, without = rows.count(), bare.count()
    if total <= largest:
        return rows.select("vec_id", F.lit("").alias("cell"), F.lit(total).cast("long").alias("size"), F.lit(True).alias("kept"))
    state, whole = rows.where("q is not null").withColumn("cell", F.lit("")), None
    k = F.least(F.ceil(F.col("n") / largest), F.lit(fan)).cast("int").alias("k")
    while True:
        sizes = state.groupBy("cell").agg(F.count("*").alias("n"))
        cells = written(sizes.where(F.col("n") > max(rows_a_task, largest)).select("cell", "n", k, F.ceil(F.col("n") / rows_a_task).cast("int").alias("slices")), "crowded")
        if cells.isEmpty():
            break
        dealt = _dealt(state, cells)
        centres = _centres(dealt, cells, fan, steps)

        def place(key, left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("at")
            at = _nearest(_matrix(left["q"]), _matrix(right["q"])) if len(left) else np.empty(0, np.int64)
            return left.select(["vec_id", "q", "h", "cell"]).append_column("at", pa.array(at, pa.int32()))

        placed = dealt.groupBy("cell", "slice").cogroup(_sliced(centres, cells).groupBy("cell", "slice")).applyInArrow(place, "vec_id long, q array<long>, h long, cell string, at int")
        placed = written(placed, "placed")
        parts = placed.groupBy("cell").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low = high").select("cell").join(cells.select("cell", "n"), "cell")
        parts = small(written(parts, "uncut"))
        closed = placed.join(parts, "cell").select("vec_id", "cell", F.col("n").alias("size"))
        whole = closed if whole is None else whole.union(closed)
        cut = placed.join(parts, "cell", "left_anti").select("vec_id", "q", "h", F.concat_ws("/", "cell", F.col("at").cast("string")).alias("cell"))
        state = written(cut.union(state.join(small(cells), "cell", "left_anti").select("vec_id", "q", "h", "cell")), "cells")
        dealt.unpersist()

    def finish(table: pa.Table) -> pa.Table:
        ids, name, size = table["vec_id"].to_numpy(), np.empty(len(table), object), np.empty(len(table), np.int64)
        for at, cell in _cut(_matrix(table["q"]), table["h"].to_numpy(), table["cell"][0].as_py(), largest, fan, steps):
            name[at], size[at] = cell, len(at)
        return pa.table({"vec_id": ids, "cell": pa.array(name, pa.string()), "size": size})

    ended = state.groupBy("cell").applyInArrow(finish, "vec_id long, cell string, size long")
    ended = written(ended if whole is None else ended.union(whole), "ended")
    if without:
        most = ended.orderBy(F.desc("size"), "cell").select("cell", "size").first()
        name, n = (most.cell, most.size) if most else ("", 0)
        size = F.when(F.col("cell") == name, F.col("size") + without).otherwise(F.col("size"))
        ended = ended.withColumn("size", size).union(bare.select("vec_id", F.lit(name), F.lit(n + without).cast("long")))
    return ended.withColumn("kept", F.col("size") > smallest)


class Mixture(NamedTuple):
    """Weights (k), means (k, d) and covariances (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Of each row and component: the logarithm of weight times density."""
        out = np.empty((len(x), len(self.weights)))
        for c, (weight, mean, covariance) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            low = np.linalg.cholesky(covariance)
            z = (x - mean) @ np.linalg.inv(low).T
            out[:, c] = np.log(weight) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + (z * z).sum(axis=1)) - np.log(np.diag(low)).sum()
        return out


def _statistics(x: np.ndarray, shares: np.ndarray, likelihood: float) -> np.ndarray:
    """One flat array: the log-likelihood, and the shares' sums of 1, x and x x' for each component."""
    moments = np.stack([(x * shares[:, [c]]).T @ x for c in range(shares.shape[1])])
    return np.concatenate([[likelihood], shares.sum(axis=0), (shares.T @ x).ravel(), moments.ravel()])


def _expected(x: np.ndarray, model: Mixture) -> np.ndarray:
    logs = model.log_densities(x)
    top = logs.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
    return _statistics(x, np.exp(logs - total), float(total.sum()))


def _started(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gap = (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return _statistics(x, np.eye(len(centres))[np.argmin(gap, axis=1)], 0.0)


def _maximised(sums: np.ndarray, k: int, d: int, ridge: float) -> Mixture:
    n, first, second = sums[1 : 1 + k] + 10 * np.finfo(float).eps, sums[1 + k : 1 + k + k * d].reshape(k, d), sums[1 + k + k * d :].reshape(k, d, d)
    means = first / n[:, None]
    covariances = second / n[:, None, None] - means[:, :, None] * means[:, None, :]
    return Mixture(n / n.sum(), means, (covariances + covariances.transpose(0, 2, 1)) / 2 + ridge * np.eye(d))


def fit_mixture(summed: Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray], centres: np.ndarray, rounds: int = 100, gain: float = 1e-3, ridge: float = 1e-6) -> tuple[Mixture, list[float]]:
    """The mixture and its mean log-likelihoods, round by round. summed(f) is the sum of f over parts of the rows; the first shares go to the nearest centre.

    It ends where a round gains less than `gain` for a row. Covariances are full, with `ridge` on their diagonal.
    """
    k, d = centres.shape
    begun = summed(lambda x: _started(x, centres))
    model, seen, n = _maximised(begun, k, d, ridge), [], begun[1 : 1 + k].sum()
    for _ in range(rounds):
        sums = summed(lambda x, model=model: _expected(x, model))
        seen.append(float(sums[0] / n))
        if len(seen) > 1 and abs(seen[-1] - seen[-2]) < gain:
            break
        model = _maximised(sums, k, d, ridge)
    return model, seen


def _spread_sum(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """The sum of f over rows (x), of `length` numbers: each task adds up its batches, and Spark the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = f(_matrix(batch.column("x")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["place", "value"])

    parts = rows.select("x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(length)
    for r in parts.toPandas().itertuples():  # as many as the model has numbers
        out[r.place] = r.value
    return out


def _labelled(rows: DataFrame, model: Mixture) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.argmax(model.log_densities(_matrix(b.column("x"))), axis=1) if len(b) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(at, pa.int32())], ["vec_id", "x", "at"])

    return rows.mapInArrow(run, "vec_id long, x array<double>, at int")


def mixture_clusters(rows: DataFrame, k: int, steps: int = 5, rows_a_task: int = 20_000) -> DataFrame:
    """vec_id, x, at: rows (vec_id, x: sound vectors of one length) with the most likely of k full Gaussians; fewer where there are fewer distinct vectors."""
    q, unit = _whole(rows)
    state = written(q.withColumn("cell", F.lit("")), "whole")
    slices = max(1, -(-state.count() // rows_a_task))
    cells = rows.sparkSession.createDataFrame([("", k, slices)], "cell string, k int, slices int")
    dealt = _dealt(state, cells)
    centres = _centres(dealt, cells, k, steps).orderBy("at").collect()  # k at most
    dealt.unpersist()
    if not centres:
        return rows.withColumn("at", F.lit(0))
    start = np.array([c.q for c in centres], float) * unit
    d = start.shape[1]
    length = 1 + len(start) * (1 + d + d * d)
    model, _ = fit_mixture(lambda f: _spread_sum(rows, f, length), start)
    return written(_labelled(rows, model), "labelled")


def _few_clusters(rows: DataFrame, k: int, steps: int = 5) -> DataFrame:
    """mixture_clusters() of the nodes of a level, which are at most as many as the clusters below them."""
    q, unit = _whole(rows)
    found = rows.join(q, "vec_id").orderBy("vec_id").toPandas()
    x, whole = np.array(found.x.tolist(), float), np.array(found.q.tolist(), float)
    first = np.unique(found.h.to_numpy(), return_index=True)[1][:k]
    model, _ = fit_mixture(lambda f: f(x), _moved(whole, whole[first], steps) * unit)
    return _labelled(rows, model)


def mixture_tree(vectors: DataFrame, most: int = 10, levels: int = 3) -> DataFrame:
    """level, id, parent, n (leaves below): a tree of mixtures over vectors (vec_id, embedding), from the leaves (level 0) up.

    Each level is cut into min(most, rows / 2) clusters, and the mean of a cluster's vectors is a node of the next, for as long as there are two nodes or more; the last
    level's nodes have no parent. Ids are `level_cluster`, those of leaves vec_id. Rows without vec_id or without a sound vector of the longest one's length are left out. From level 1 on
    there are `most` nodes at most.
    """
    sound = _sound(vectors).where("x is not null")
    size = sound.agg(F.max(F.size("x"))).first()[0]
    rows = written(sound.where(F.size("x") == (size or 0)), "vectors")
    out, leaves = None, None
    for level in range(1, levels + 1):
        k = min(most, rows.limit(2 * most).count() // 2)
        if k < 1:
            break
        if level == 1:
            found = mixture_clusters(rows, k)
            weight = F.lit(1).cast("long").alias("n")
        else:
            found, weight = written(_few_clusters(rows, k).join(leaves, "vec_id"), "labelled"), F.col("n")
        name = F.col("vec_id").cast("string") if level == 1 else F.concat(F.lit(f"{level - 1}_"), F.col("vec_id").cast("string"))
        nodes = found.select(F.lit(level - 1).alias("level"), name.alias("id"), F.concat(F.lit(f"{level}_"), F.col("at").cast("string")).alias("parent"), weight)
        out = nodes if out is None else out.union(nodes)
        below = found.groupBy(F.col("at").cast("long").alias("vec_id")).agg(F.sum(weight).alias("n"))
        means = found.select("at", F.posexplode("x").alias("p", "v")).groupBy("at", "p").agg(F.avg("v").alias("v")).groupBy(F.col("at").cast("long").alias("vec_id"))
        rows = written(means.agg(F.array_sort(F.collect_list(F.struct("p", "v"))).getField("v").alias("x")), "nodes")  # one entry for each component
        leaves = written(below, "below")
    if out is None:
        return rows.select(F.lit(0).alias("level"), F.col("vec_id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(1).cast("long").alias("n"))
    top = int(out.agg(F.max("level")).first()[0]) + 1
    last = leaves.select(F.lit(top).alias("level"), F.concat(F.lit(f"{top}_"), F.col("vec_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), "n")
    return out.union(last)
