"""Queries of trees and sessions that grow row by row; they have no SQL and are tested against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import trees
from lodestrata.session import rounded, table
from lodestrata.streaming import merged_sessions as M


def _vectors(spark, sf_dir):
    """Vectors as rows of their label, a second apart in the order of their ids."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("id"), F.timestamp_seconds("vec_id").alias("ts"), F.col("embedding").alias("vector"))


def tree_insertion(spark, sf_dir):
    """All vectors in the tree of their label, with the threshold that each node's depth asks for."""
    found = trees.grown_trees(_vectors(spark, sf_dir), trees.Shape(0.2, 0.5, 8))
    return found.select("key", "node", "parent", "depth", "id", "n", rounded(trees.depth_threshold(F.col("depth"), 0.2, 0.5, 8)).alias("threshold"))


def session_merge(spark, sf_dir):
    """All vectors with the words of the document of their number: those that seven divides visit their label's sessions, of which it keeps eight; all others are pages."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.tokens(F.lower("text"))).alias("words"))
    rows = _vectors(spark, sf_dir).join(d, "id", "left").withColumn("visit", F.col("id") % 7 == 0)
    return M.merged_sessions(rows, M.Merging(8, 0.3, 0.1))


QUERIES = {"tree_insertion": (tree_insertion, None), "session_merge": (session_merge, None)}
