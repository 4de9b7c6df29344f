"""Runs of words that repeat with a period, by an all-lag scan.

The word ids of a text are compared with themselves, shifted by each lag up to a third (1 / least
exponent) of their number; long enough true stretches are runs. The comparisons are arrays of lags by
words. Short texts are scanned where they are read; of long ones each range of lags is a row of its own, so
that many tasks share one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import stored
from lodestrata.llm.words import Words, batches_of_text, words_of

#: Eight true comparisons, read as one number.
_EIGHT = np.uint64(0x0101010101010101)
RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lags(n: int, least_exponent: int) -> int:
    """The largest period of a run among n words."""
    return n // least_exponent


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each stretch of at least `least` true values."""
    edge = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    size = np.diff(edge) - 1
    found = np.flatnonzero(size >= least)
    return edge[found] + 1, size[found]


def runs_of(ids: np.ndarray, first: int, last: int, least_length: int = 24, least_exponent: int = 3, block: int = 1 << 18) -> np.ndarray:
    """(start, length, period) of the runs that lags first to last find; of one stretch the smallest of these lags.

    A run with period q and at least three times its length has no smaller period but divisors of q, whose run is the same
    stretch, so the smallest lag that finds a stretch is its smallest period. Stretches hold eight true values at a place divisible by eight,
    for least_length of 24 and least_exponent of 3 or more.
    """
    n, last = len(ids), min(last, lags(len(ids), least_exponent))
    if first > last or n < least_length:
        return np.empty((0, 3), np.int64)
    wide = -(-n // 8) * 8
    left, right = np.full(wide, -2, np.int32), np.full(wide + last + 1, -1, np.int32)
    left[:n] = right[:n] = ids
    rows, found, out = max(1, block // wide), set(), []
    step = right.strides[0]
    for at in range(first, last + 1, rows):
        upto = min(last + 1, at + rows)
        same = as_strided(right[at:], (upto - at, wide), (step, step)) == left
        for row in np.flatnonzero((same.view(np.uint64) == _EIGHT).any(axis=1)):
            q = at + int(row)
            for s, size in zip(*_stretches(same[row, : n - q], max(least_length - q, (least_exponent - 1) * q, 1)), strict=True):
                if (key := (int(s), int(size) + q)) not in found:
                    found.add(key)
                    out.append((*key, q))
    return np.array(out, np.int64).reshape(-1, 3)


def merged(found: np.ndarray) -> np.ndarray:
    """Runs by start, then period; of each stretch that several ranges of lags found the smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (np.diff(found[:, :2], axis=0) != 0).any(axis=1)
    found = found[fresh]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equal ones that with the smallest start, then period."""
    return max((tuple(map(int, r)) for r in found), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(w: Words, text: int, found: np.ndarray) -> bytes:
    """A text's words, joined by spaces, without those that any run holds after its first period."""
    first, last = w.text[text], w.text[text + 1]
    change = np.zeros(last - first + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = first + np.flatnonzero(np.cumsum(change[:-1]) == 0)
    raw = w.raw.data
    return b" ".join(bytes(raw[s:e]) for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist(), strict=True))


def _answer(key: pa.Array, w: Words, found: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    none = pa.scalar(None, _RUN.value_type)
    every = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"]),
    )
    best = [strongest(f) for f in found]
    peak = pa.array([none if b is None else {"start": b[0], "length": b[1], "period": b[2]} for b in best], _RUN.value_type)
    texts = pa.array([collapsed(w, k, f).decode("utf-8", "replace") for k, f in enumerate(found)], pa.string())
    return pa.RecordBatch.from_arrays([key, pa.array(np.diff(w.text), pa.int64()), runs, peak, texts], names)


def _ids(w: Words) -> np.ndarray:
    return np.unique(w.hash, return_inverse=True)[1].reshape(-1).astype(np.int32)


def periodic_runs(
    docs: DataFrame, least_length: int = 24, least_exponent: int = 3, long_text: int = 60_000, lags_a_row: int = 1024, compared_a_row: int = 1 << 28
) -> DataFrame:
    """The periodic runs of each whole text, and the text without what they repeat.

    docs has doc_id and text; other columns are ignored. Words are divided by ASCII white space, and words are the same if their bytes are (told by
    64-bit hashes). A run is a stretch of at least max(least_length, least_exponent * period) words that its smallest period holds in,
    and no longer stretch; least_length is 24 or more and least_exponent 3 or more. Returns one row per row of docs: doc_id, n_words, runs (start, length, period;
    by start, then period), peak (the run with the greatest length / period; ties to the smallest start, then period; null without runs), collapsed (the words joined by
    spaces, without those that a run holds after its first period). Null and empty texts have no words, no runs and collapse to an empty text. Repeated rows
    have the same result each. Texts of over long_text characters are scanned once for each distinct text, in rows of
    at least lags_a_row lags and about compared_a_row comparisons.
    """
    if least_length < 24 or least_exponent < 3:
        raise ValueError("least_length must be 24 or more, and least_exponent 3 or more")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "runs", "peak", "collapsed"]
    shape = f"doc_id {kind}, n_words bigint, runs array<{RUN}>, peak {RUN}, collapsed string"
    docs = docs.select("doc_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches, most_bytes=4_000_000):
            w = words_of(batch.column("text").to_pylist(), lower=False)
            ids = _ids(w)
            found = [merged(runs_of(ids[a:b], 1, b - a, least_length, least_exponent)) for a, b in zip(w.text[:-1], w.text[1:], strict=True)]
            yield _answer(batch.column("doc_id"), w, found, names)

    def word_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches, most_bytes=1):
            w = words_of(batch.column("text").to_pylist(), lower=False)
            ids = pa.ListArray.from_arrays(pa.array([0, len(w.hash)], pa.int32()), pa.array(_ids(w)))
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), ids], ["text_hash", "ids"])

    def scan_lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids = batch.column("ids").slice(k, 1).flatten().to_numpy()
                first, last = batch.column("first")[k].as_py(), batch.column("last")[k].as_py()
                found = runs_of(ids, first, last, least_length, least_exponent)
                columns = [pa.array(found[:, c]) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("text_hash")[k].as_py()] * len(found), pa.string()), *columns], ["text_hash", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches, most_bytes=1):
            w = words_of(batch.column("text").to_pylist(), lower=False)
            runs = batch.column("runs").flatten()
            found = np.stack([runs.field(c).to_numpy() for c in range(3)], axis=1) if len(runs) else np.empty((0, 3), np.int64)
            yield _answer(batch.column("doc_id"), w, [merged(found)], names)

    short = docs.where(F.coalesce(F.length("text") <= long_text, F.lit(True))).mapInArrow(scan, shape)
    long = docs.where(F.length("text") > long_text).withColumn("text_hash", F.sha2("text", 256))
    # a task holds a few long texts at most
    texts = stored(long.groupBy("text_hash").agg(F.first("text").alias("text")).mapInArrow(word_ids, "text_hash string, ids array<int>"), "word-ids")
    n = F.size("ids")
    step = F.greatest(F.lit(lags_a_row), F.floor(F.lit(compared_a_row) / n)).cast("int")
    pieces = texts.where(n >= least_length).select("text_hash", "ids", step.alias("step"), F.explode(F.sequence(F.lit(1), F.floor(n / least_exponent).cast("int"), step)).alias("first"))
    dealt = pieces.select("text_hash", "ids", "first", (F.col("first") + F.col("step") - 1).alias("last")).repartition(F.col("text_hash"), F.col("first"))
    found = dealt.mapInArrow(scan_lags, "text_hash string, start bigint, length bigint, period bigint")
    # of one text at most as many runs as it has words
    by_text = found.groupBy("text_hash").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    both = long.join(by_text, "text_hash", "left").select("doc_id", "text", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"))
    return short.unionByName(both.mapInArrow(finish, shape))
