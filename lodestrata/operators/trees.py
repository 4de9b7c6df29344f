"""Trees that grow row by row: each row descends to the most similar child while that passes the threshold of its depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A node: its number (from 1 in each key, in the order of making; the root is 0 and has no row), parent, depth (from 1), the row that it is made of (null for a summary),
#: the number of rows in it, and the mean of their vectors.
NODE = "node long, parent long, depth int, id long, n long, vector array<double>"
_NAMES = ["key", "node", "parent", "depth", "id", "n", "vector"]


def depth_threshold(depth: Column, base: float, rate: float, max_depth: int) -> Column:
    """base * exp(rate * depth / max_depth)."""
    return F.lit(base) * F.exp(F.lit(rate) * depth / max_depth)


class Shape:
    """Thresholds of the descent: base * exp(rate * depth / max_depth) at each depth."""

    def __init__(self, base: float = 0.4, rate: float = 0.5, max_depth: int = 8):
        self.base, self.rate, self.max_depth = base, rate, max(1, max_depth)

    def passes(self, similarity: float, depth: int) -> bool:
        return similarity > self.base * np.exp(self.rate * depth / self.max_depth)


class _Tree:
    """The nodes of one key; vectors stand in one array that doubles as it fills, and so do those of each parent's children."""

    def __init__(self, shape: Shape):
        self.shape, self.children, self.places = shape, {}, {}
        self.parent, self.depth, self.id, self.n, self.mean = [0], [0], [None], [0], [None]

    def add(self, parent: int, row: int | None, n: int, mean: np.ndarray) -> int:
        node = len(self.parent)
        for column, value in zip((self.parent, self.depth, self.id, self.n, self.mean), (parent, self.depth[parent] + 1, row, n, mean), strict=True):
            column.append(value)
        below = self.children.setdefault(parent, [np.zeros((4, len(mean))), [], len(mean)])
        if len(below[1]) == len(below[0]):
            below[0] = np.concatenate([below[0], np.zeros_like(below[0])])
        self.places[node] = len(below[1])
        below[1].append(node)
        self._point(node)
        return node

    def _point(self, node: int) -> None:
        """The direction of a node among its parent's children; nodes of another length than the first child have none."""
        below, mean = self.children[self.parent[node]], self.mean[node]
        size = np.sqrt((mean * mean).sum()) if len(mean) == below[2] else 0.0
        below[0][self.places[node]] = mean / size if size > 0 else 0.0

    def insert(self, row: int, vector: np.ndarray) -> None:
        size, at, path = np.sqrt((vector * vector).sum()), 0, []
        while at in self.children and self.children[at][2] == len(vector):
            below = self.children[at]
            near = np.round(below[0][: len(below[1])] @ vector / size, 9)
            best = int(np.argmax(near))  # the oldest of equal ones
            if not self.shape.passes(near[best], self.depth[at] + 1):
                break
            at = below[1][best]
            path.append(at)
        self.add(at, row, 1, vector)
        if not path:
            return
        before = self.id[at], self.n[at], self.mean[at]
        for node in path:
            self.mean[node] = (self.mean[node] * self.n[node] + vector) / (self.n[node] + 1)
            self.n[node], self.id[node] = self.n[node] + 1, None
            self._point(node)
        self.add(at, *before)

    def batches(self, key, kind: pa.DataType, rows: int = 4096) -> Iterator[pa.RecordBatch]:
        for at in range(1, len(self.parent), rows):
            part = slice(at, at + rows)
            numbers = range(at, min(at + rows, len(self.parent)))
            columns = [pa.array([key] * len(numbers), kind), pa.array(numbers, pa.int64()), pa.array(self.parent[part], pa.int64()), pa.array(self.depth[part], pa.int32()), pa.array(self.id[part], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(self.n[part], pa.int64()), pa.array([m.tolist() for m in self.mean[part]], pa.list_(pa.float64()))], _NAMES)


def grown_trees(rows: DataFrame, shape: Shape, stored: DataFrame | None = None) -> DataFrame:
    """key and NODE: the trees after rows (key, id, ts, vector) were put into them in the order of ts, then id; stored: such trees from before, which go on.

    A row becomes a leaf below the last node of its descent. Every node on the way then takes it into its mean (the vector of a summary is the mean of what it
    sums up), and the last one's former self becomes a leaf beside the new one. Cosines are rounded to nine digits and ties go to the older child. Rows without key, id or ts or with a null, zero
    or non-finite vector are left out. Each row meets the tree that the rows before left, so a key is read in order by one task, which holds that key's tree and no other.
    """
    x = F.col("vector").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    new = rows.where("key is not null and id is not null and ts is not null").where(F.coalesce(fine, F.lit(False)))
    none = F.lit(None)
    new = new.select("key", none.cast("long").alias("node"), none.cast("long").alias("parent"), F.col("id").cast("long").alias("id"), F.lit(1).cast("long").alias("n"), x.alias("vector"), F.lit(1).alias("turn"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    if stored is not None:
        old = stored.select(F.col("key").cast(rows.schema["key"].dataType), "node", "parent", "id", "n", "vector", F.lit(0).alias("turn"), F.col("node").alias("at"))
        new = new.unionByName(old)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key, type_ = None, None, None
        for b in batches:
            type_ = b.column("key").type
            for k, node, parent, row, n, vector in zip(*(b.column(c).to_pylist() for c in ("key", "node", "parent", "id", "n", "vector")), strict=True):
                if tree is None or k != key:
                    if tree is not None:
                        yield from tree.batches(key, type_)
                    tree, key = _Tree(shape), k
                if node is None:
                    tree.insert(row, np.array(vector, float))
                elif tree.add(parent, row, n, np.array(vector, float)) != node:
                    raise ValueError(f"node {node} of a stored tree doesn't follow the one before")
        if tree is not None:
            yield from tree.batches(key, type_)

    dealt = new.repartition("key").sortWithinPartitions("key", "turn", "at", "id")
    return dealt.select("key", "node", "parent", "id", "n", "vector").mapInArrow(run, f"key {kind}, {NODE}")
