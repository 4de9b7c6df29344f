"""Queries of vector partitions; they have no SQL and are tested against plain loops."""

from __future__ import annotations

from lodestrata.operators import clusters as C
from lodestrata.session import table


def kmeans_partition(spark, sf_dir):
    """All vectors in cells of 20 rows at most."""
    return C.kmeans_partition(table(spark, sf_dir, "embeddings"))


def mixture_tree(spark, sf_dir):
    """The tree of Gaussian mixtures over all vectors, three levels at most."""
    return C.mixture_tree(table(spark, sf_dir, "embeddings"))


QUERIES = {"kmeans_partition": (kmeans_partition, None), "mixture_tree": (mixture_tree, None)}
