"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32,), "newline": (10,),
    "full_stop": (46,), "comma": (44,), "exclamation": (33,), "bar": (124,), "dollar": (36,), "percent": (37,),
    "ampersand": (38,), "star": (42,), "hash": (35,), "equals": (61,), "slash": (47,), "angle": (60, 62), "colon": (58, 59),
    "quote": (34, 39, 96), "bracket": (40, 41, 91, 93, 123, 125), "dash": (45, 95), "question": (63,), "at": (64,),
    "control": (*range(0, 10), *range(11, 32), 127), "lead": range(192, 256), "wide": range(226, 256),
}
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _i, _codes in enumerate(CLASSES.values()):
    _CLASS_OF[list(_codes)] = _i
_SUMS = np.zeros((256, len(CLASSES)))
for _i, _codes in enumerate(CLASSES.values()):
    _SUMS[list(_codes), _i] = 1
NAMES = (
    *CLASSES, "log_bytes", "log_words", "log_lines", "bytes_per_word", "words_per_line", "distinct_words", "distinct_lines",
    "top_word", "distinct_bytes", "byte_entropy", "stops_per_word", "capitals_per_word",
)


def statistics(text: str | None) -> list[float]:
    """Shares of byte classes, lengths, repetition and entropy of a whole text; all defined for no text."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    words, lines = raw.split(), raw.split(b"\n")
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    n_words = max(1, len(words))
    share = counts[counts > 0] / n
    own = [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), len(raw) / n_words, len(words) / len(lines),
        len(seen) / n_words, len(set(lines)) / len(lines), max(seen.values(), default=0) / n_words,
        float(len(share)), float(-(share * np.log(share)).sum()), counts[46] / n_words, counts[65:91].sum() / n_words,
    ]
    return [*(counts @ _SUMS / n), *own]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(x.as_py()) for x in batch.column("text")], np.float32).reshape(-1, len(NAMES))
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), arrays], ["doc_id", "stats"])


@dataclass
class Trees:
    """Complete trees of one depth, flattened: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; a value above it goes to the second child
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics; all rows go down a level at once."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, smooth: float = 5.0) -> Trees:
    """Boosting on log loss with second-order gains; values are cut into at most `bins` quantile bins.

    Without rows, or with one label only, every score is the smoothed share of label 1.
    """
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    inner, width = 2**depth - 1, x.shape[1]
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    if len(y) == 0 or y.min() == y.max():
        return Trees(feature, cut, leaf, start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1)
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for f in range(width):
                slot = (node - first) * bins + binned[:, f]
                gs = np.bincount(slot, g, n * bins).reshape(n, bins).cumsum(1)
                hs = np.bincount(slot, h, n * bins).reshape(n, bins).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + smooth) + (ga - gs) ** 2 / (ha - hs + smooth) - ga**2 / (ha + smooth)
                gain = gain[:, : len(edges[f])]
                if gain.shape[1]:
                    at = gain.argmax(1)
                    better = (top := gain[np.arange(n), at]) > best
                    best[better] = top[better]
                    feature[t, first : first + n][better] = f
                    cut[t, first : first + n][better] = edges[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf[t] = rate * gs / (hs + smooth)
        total += leaf[t, node - inner]
    return Trees(feature, cut, leaf, start)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """One label per doc_id: 1 where the mean of its labels is 0.5 or more; null ids and labels are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
        .groupBy("doc_id").agg((F.avg(name) >= 0.5).cast("int").alias("label"))
    )


def fitted(docs: DataFrame, labels: DataFrame, max_training_rows: int = 40_000) -> Trees:
    """Trees fitted on the driver, on the max_training_rows labelled documents, not held out, with the smallest hash of their id.

    That bounds the fit; only the statistics of those documents come to the driver.
    """
    known = labels_of(labels, "quality").where(~held_out(F.col("doc_id")))
    drawn = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training_rows))  # the limit bounds it
    sample = (
        docs.select("doc_id", "text").join(drawn, "doc_id").select(F.struct("doc_id", "label").alias("doc_id"), "text")
        .mapInArrow(_statistics, "doc_id struct<doc_id: " + docs.schema["doc_id"].dataType.simpleString() + ", label: int>, stats array<float>")
        .select("doc_id.*", "stats").groupBy("doc_id").agg(F.min(F.struct("stats", "label")).alias("one"))  # of an id with several texts one, always the same
        .orderBy("doc_id").select("one.*").toArrow()
    )
    x = sample.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    return fit(x, sample.column("label").to_numpy().astype(float))


def _scores(trees: Trees, batch: pa.RecordBatch) -> np.ndarray:
    return trees.score(np.array([statistics(x.as_py()) for x in batch.column("text")], np.float32).reshape(-1, len(NAMES)))


def score_quality(docs: DataFrame, labels: DataFrame, max_training_rows: int = 40_000) -> DataFrame:
    """A quality score of each whole text.

    docs has doc_id and text, labels has doc_id and quality; other columns are ignored. Returns
    one row per input row: doc_id, held_out, score (0 to 1). Null and empty texts have the statistics of an empty text.
    Without any label every score is 0.5. Repeated rows get the same score.
    """
    trees = fitted(docs, labels, max_training_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_scores(trees, batch))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double"
    )


def keep_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_training_rows: int = 40_000) -> DataFrame:
    """docs without the rows that score below the cut; all columns stay, and rows are as in score_quality()."""
    trees = fitted(docs, labels, max_training_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(trees, batch) >= cut))

    return docs.mapInArrow(keep, docs.schema)
