"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree is a sorted array of 64-character bit strings: the signs of random projections. A query
descends in every tree to the longest prefix it shares with any string, which is where its own
string would be inserted, and the trees then ascend together: at each level the prefix is one bit
shorter in all trees, and the strings that share it are candidates, until a set share of the rows
has been met at the end of a level. Candidates are scored exactly.

The index is cut into blocks of rows. The sorted arrays of each block are built once and written to
the shared folder, where workers map them into memory; each block of queries meets the blocks in
runs, and a query's best are merged over the runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import mapped_array, new_folder, put_array, stored

BITS = 64
#: The longest prefix that is looked up; deeper ones hold no more than a few rows of a block.
DEEPEST = 24


@lru_cache(maxsize=2)
def _planes(size: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, trees * BITS))


def bit_strings(lifted: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """trees x rows of bit strings, as numbers."""
    planes, out = _planes(lifted.shape[1], trees, seed), np.empty((trees, len(lifted)), np.uint64)
    for at in range(0, len(lifted), 512):
        bits = np.packbits((lifted[at : at + 512] @ planes > 0).reshape(-1, trees, BITS), axis=2)
        out[:, at : at + 512] = np.ascontiguousarray(bits).view(">u8")[..., 0].T
    return out


def sorted_trees(x: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of each tree in order, and the rows they belong to."""
    norms = np.linalg.norm(x, axis=1)
    # one more component makes all rows equally long, so that the nearest by angle have the largest product
    lifted = np.column_stack([x, np.sqrt(np.maximum(0, norms.max(initial=0.0) ** 2 - norms**2))])
    strings = bit_strings(lifted, trees, seed)
    order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
    return np.take_along_axis(strings, order, axis=1), order


def query_strings(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    return bit_strings(np.column_stack([x, np.zeros(len(x))]), trees, seed)


def candidates(strings: np.ndarray, order: np.ndarray, asked: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """For each query (column of asked) the rows met at the deepest level at which all trees together have met `least` rows, or all rows."""
    trees, n = strings.shape
    # ranges of the rows that share the first `level` bits, for each level, tree and query
    lo = np.empty((DEEPEST + 1, trees, asked.shape[1]), np.int32)
    hi = np.empty_like(lo)
    for t in range(trees):
        for level in range(DEEPEST + 1):
            below = np.uint64((1 << (BITS - level)) - 1)
            lo[level, t] = np.searchsorted(strings[t], asked[t] & ~below, "left")
            hi[level, t] = np.searchsorted(strings[t], asked[t] | below, "right")
    met = (hi - lo).sum(axis=1, dtype=np.int64)  # repeats counted, so never less than what is met
    least = min(least, n)
    seen = np.zeros(n, bool)
    for q in range(asked.shape[1]):
        seen[:] = False
        for level in range(int(np.flatnonzero(met[:, q] >= least)[-1]), -1, -1):
            for rows, a, b in zip(order, lo[level, :, q].tolist(), hi[level, :, q].tolist(), strict=True):
                seen[rows[a:b]] = True
            if np.count_nonzero(seen) >= least:
                break
        yield np.flatnonzero(seen)


def best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) in parts to the k best of each query, ties to the smaller vec_id."""
    q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], v[place < k], s[place < k]


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _build(folder: str, trees: int, seed: int):
    """Writes the arrays of a block of rows or, for asked blocks, of queries."""

    def build(table: pa.Table) -> pa.Table:
        block, asked = table.column("block")[0].as_py(), table.column("asked")[0].as_py()
        x = _flat(table, "vector").reshape(len(table), -1)
        ids = table.column("ids").combine_chunks()
        if asked:
            arrays = {"x": x, "ids": ids.flatten().to_numpy(), "strings": query_strings(x, trees, seed)}
        else:
            strings, order = sorted_trees(x, trees, seed)
            arrays = {"x": x, "ids": ids.flatten().to_numpy(), "starts": np.append(0, np.cumsum(ids.value_lengths().to_numpy())), "strings": strings, "order": order}
        for name, array in arrays.items():
            put_array(f"{folder}/{'asked' if asked else 'rows'}-{block}-{name}.npy", array)
        return pa.table({"asked": [asked], "length": pa.array([x.shape[1]], pa.int32()), "block": pa.array([block], pa.int32())})

    return build


def _search(folder: str, share: float, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = lambda kind, block, name: mapped_array(f"{folder}/{kind}-{block}-{name}.npy")
        for batch in batches:
            for asked, blocks in zip(batch.column("block").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                queries, query_ids, wanted = (array("asked", asked, c) for c in ("x", "ids", "strings"))
                found = []
                for block in blocks:
                    x, ids, starts, strings, order = (array("rows", block, c) for c in ("x", "ids", "starts", "strings", "order"))
                    least = int(np.ceil(share * len(x))) + 5 * k
                    for at in range(0, len(queries), 256):
                        for q, rows in enumerate(candidates(strings, order, wanted[:, at : at + 256], least), at):
                            scores = x[rows] @ queries[q]
                            if len(rows) > k + 1:  # the query's own vector may be one of them
                                cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                                rows, scores = rows[scores >= cut], scores[scores >= cut]
                            n = starts[rows + 1] - starts[rows]
                            of = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                            v, s = ids[of], np.repeat(scores, n)
                            other = v != query_ids[q]
                            found.append((np.full(int(other.sum()), q), v[other], s[other]))
                q, v, s = best_of(found, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return search


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 128, share: float = 0.38, block_rows: int = 8192, block_queries: int = 1024, run: int = 8, seed: int = 7
) -> DataFrame:
    """The k rows found with the largest inner product with each query row.

    vectors has vec_id (long) and embedding (array of float or double); is_query is a condition on vec_id; other
    columns are ignored. Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the
    smaller vec_id, without the query's own row. Rows with a null vec_id and vectors that are null, empty,
    zero or hold null or non-finite components take no part; vectors of different lengths have no product, so each meets those of its
    own length; repeated rows (of the same vec_id and vector) count once; of a query id with several vectors the smallest is asked; fewer than k other rows
    are all found; no rows give no rows.

    The ascent ends when share of a block's rows and 5 * k more have been met: the higher, the more of the exact
    result is found. Rows with equal vectors are indexed once, with the k + 1 smallest of their ids,
    which is all that a result can name. Each task takes a block of queries through `run` blocks of rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")
    )
    # the group limit is taken in each task before the shuffle, so a common vector stays small
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    index = stored(
        rows.groupBy("vec_id", "vector").count().withColumn("n", first).where(F.col("n") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select("vector", "ids", F.size("vector").alias("length")), "vectors",
    )
    asked = stored(rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vector", F.array("vec_id").alias("ids"), F.size("vector").alias("length")), "asked")

    def by_length(df: DataFrame, size: int) -> dict[int, tuple[int, int]]:
        """For each length of vectors, of which there are few, its first block and how many it has."""
        out, at = {}, 0
        for r in df.groupBy("length").count().orderBy("length").collect():
            out[r.length] = (at, -(-r["count"] // size))
            at += out[r.length][1]
        return out

    def of_length(values: dict[int, int]) -> Column:
        return F.coalesce(*(F.when(F.col("length") == length, F.lit(x)) for length, x in values.items()), F.lit(0))

    def placed(df: DataFrame, of: dict[int, tuple[int, int]], is_asked: bool) -> DataFrame:
        own = F.pmod(F.xxhash64(F.col("ids")[0]), of_length({d: max(1, n) for d, (_, n) in of.items()}).cast("long") + (0 if of else 1))
        return df.select("vector", "ids", F.lit(is_asked).alias("asked"), (of_length({d: at for d, (at, _) in of.items()}) + own).cast("int").alias("block"))

    row_blocks, asked_blocks, folder = by_length(index, block_rows), by_length(asked, block_queries), new_folder(spark, "forest")
    both = placed(index, row_blocks, False).unionByName(placed(asked, asked_blocks, True))
    written = stored(both.groupBy("asked", "block").applyInArrow(_build(folder, trees, seed), "asked boolean, length int, block int"), "blocks")
    number = F.floor((F.col("block") - of_length({d: at for d, (at, _) in row_blocks.items()})) / run).alias("run")
    runs = written.where("not asked").groupBy("length", number).agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), of_length({d: (n - 1) // run for d, (_, n) in row_blocks.items()}).cast("long"))).alias("run")
    jobs = stored(written.where("asked").select("length", "block", every).join(runs, ["length", "run"]).select("block", "blocks"), "jobs")
    # small rows that each stand for much work, so each is a task
    found = jobs.repartition(min(100_000, max(1, jobs.count()))).mapInArrow(_search(folder, share, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
