"""Greedy selections and sequential clustering over bounded candidate lists: each list is one small group, lists are distributed.

Candidates come as the best of a search, so a list has at most `most` rows; a longer one raises an error rather than fill a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import rounded


def _per_list(rows: DataFrame, group: str, choose: Callable[[pd.DataFrame, np.ndarray], tuple[list[int], list[float]]], most: int) -> DataFrame:
    """group, id, place, score of the rows that choose() takes of each list, in its order."""

    def run(table: pa.Table) -> pa.Table:
        if len(table) > most:
            raise ValueError(f"a list has over {most} candidates")
        t = table.to_pandas().sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        x = np.array(t.vector.tolist(), float).reshape(len(t), -1)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        taken, scores = choose(t, np.nan_to_num(x @ x.T))
        return pa.table({group: pa.array(t[group].to_numpy()[taken], pa.int64()), "id": pa.array(t["id"].to_numpy()[taken], pa.int64()), "place": pa.array(np.arange(1, len(taken) + 1), pa.int64()), "score": pa.array(scores, pa.float64())})

    kept = rows.select(F.col(group).cast("long").alias(group), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), "vector")
    return kept.groupBy(group).applyInArrow(run, f"{group} long, id long, place long, score double")


def mmr(rows: DataFrame, group: str, k: int, weight: float = 0.8, prefill: int = 5, steep: float = 0.9, most: int = 1000) -> DataFrame:
    """Maximal marginal relevance: of each list (group, id, score, vector) k rows, the `prefill` most relevant first, then those with the
    highest weight * relevance - (1 - weight) * penalty, where the penalty is the similarity to what is taken, and beyond `steep` that times e^(10 * (s - steep)).
    The result is in the order of relevance.
    """

    def choose(t: pd.DataFrame, sims: np.ndarray):
        taken = list(range(min(prefill, k, len(t))))
        score = t.score.to_numpy()
        while len(taken) < min(k, len(t)):
            near = sims[:, taken].max(axis=1) if taken else np.zeros(len(t))
            penalty = np.where(near > steep, near * np.exp(10 * (near - steep)), near)
            gain = np.round(weight * score - (1 - weight) * penalty, 9)
            gain[taken] = -np.inf
            taken.append(int(np.argmax(gain)))
        taken.sort()
        return taken, score[taken].tolist()

    return _per_list(rows, group, choose, most)


def greedy_distinct(rows: DataFrame, group: str, threshold: float, k: int | None = None, most: int = 1000) -> DataFrame:
    """Of each list (group, id, score, vector), in the order of the scores, the rows whose cosine to every row kept so far is at most the threshold; at most k."""

    def choose(t: pd.DataFrame, sims: np.ndarray):
        taken: list[int] = []
        for i in range(len(t)):
            if (k is None or len(taken) < k) and (not taken or np.round(sims[i, taken], 9).max() <= threshold):
                taken.append(i)
        return taken, t.score.to_numpy()[taken].tolist()

    return _per_list(rows, group, choose, most)


def _cluster(times: list[int], vectors: np.ndarray, least: float, days: float) -> list[int]:
    centres, counts, last, out = [], [], [], []
    for at, x in zip(times, vectors, strict=True):
        size = np.linalg.norm(x)
        best, score = -1, least
        for c in range(len(centres)):
            if abs(at - last[c]) <= days * 86_400_000_000:
                s = round(float(x @ centres[c] / max(size * np.linalg.norm(centres[c]), 1e-12)), 9)
                if s >= least and (best < 0 or s > score):
                    best, score = c, s
        if best < 0:
            centres.append(x.copy()), counts.append(1), last.append(at)
            best = len(centres) - 1
        else:
            centres[best] = (centres[best] * counts[best] + x) / (counts[best] + 1)
            counts[best], last[best] = counts[best] + 1, at
        out.append(best)
    return out


def incremental_clusters(rows: DataFrame, group: str, least: float = 0.65, days: float = 7.0) -> DataFrame:
    """group, id, cluster (from 0, by first row): each row (group, id, at in microseconds, vector), in the order of (at, id), joins the cluster with the most similar centre
    of at least that cosine whose last row is at most `days` away, or opens one; centres are running means. A group is one conversation or user: its rows are read in order.
    """

    def run(table: pa.Table) -> pa.Table:
        t = table.to_pandas().sort_values(["at", "id"], kind="stable")
        found = _cluster(t["at"].tolist(), np.array(t.vector.tolist(), float), least, days)
        return pa.table({group: pa.array(t[group].to_numpy(), pa.int64()), "id": pa.array(t["id"].to_numpy(), pa.int64()), "cluster": pa.array(found, pa.int64())})

    kept = rows.select(F.col(group).cast("long").alias(group), F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), "vector")
    return kept.groupBy(group).applyInArrow(run, f"{group} long, id long, cluster long")


def combined_similarity(dice: Column, tfidf: Column, bigram: Column, embedding: Column, gate: float = 0.9) -> Column:
    """0.40 Dice + 0.35 TF-IDF + 0.25 bigram similarity where the embeddings pass the gate, else 0."""
    return F.when(embedding > gate, rounded(dice * 0.40 + tfidf * 0.35 + bigram * 0.25)).otherwise(0.0)
