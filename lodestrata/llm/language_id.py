"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Words are runs of letters in lower case, between marks; their n-grams of one to four characters fall into
hashed buckets. A text's weight of a bucket is its share of the text's n-grams times the bucket's inverse document
frequency over all texts that are learned from. The regression is fitted by the follow-the-regularised-leader
rule with an elastic net, on a bounded sample; a temperature is fitted on sampled texts that it hasn't seen.
As weights are linear in counts, a batch's distinct words are scored once, and a text's score is the sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import small_enough
from lodestrata.llm.words import batches_of_text, mixed

BUCKETS, LONGEST = 1 << 18, 4
#: What stands before and after a word; no letter has this code.
MARK = 1
#: Weights are about 1 in size with this factor, which suits the fit's rates.
SCALE = 20.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


@dataclass
class Grams:
    """The words of some texts, and the buckets of each distinct word's n-grams."""

    word: np.ndarray  # the distinct word of each word, text by text
    text: np.ndarray  # where each text's words begin, and their number
    bucket: np.ndarray  # of all distinct words, one after the other
    start: np.ndarray  # of each distinct word in bucket
    size: np.ndarray


def grams_of(texts: list[str | None]) -> Grams:
    lower = [(t or "").lower() for t in texts]
    code = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate([[False], _letters()[code], [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    first, size = edge[0::2], edge[1::2] - edge[0::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in lower)])
    place = _ranges(np.zeros(len(size), np.int64), size)
    each = mixed(code[_ranges(first, size)].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(32)))
    whole = np.add.reduceat(each, np.cumsum(size) - size) if len(size) else np.empty(0, np.uint64)
    _, one, word = np.unique(whole, return_index=True, return_inverse=True)
    first_of, size_of = first[one], size[one]
    framed = np.zeros((size_of + 2).sum() + LONGEST, np.uint64)
    at = np.cumsum(size_of + 2) - (size_of + 2)
    framed[_ranges(at + 1, size_of)] = code[_ranges(first_of, size_of)]
    framed[at] = framed[at + size_of + 1] = MARK
    count = [size_of, *(np.maximum(0, size_of + 3 - n) for n in range(2, LONGEST + 1))]
    total = np.sum(count, axis=0)
    start, bucket = np.cumsum(total) - total, np.empty(total.sum(), np.int32)
    key, into = framed[: len(framed) - LONGEST], start
    for n in range(1, LONGEST + 1):
        if n > 1:
            key = mixed(key) + framed[n - 1 : len(framed) - LONGEST + n - 1]
        hashed = (mixed(key ^ np.uint64(n << 56)) % np.uint64(BUCKETS)).astype(np.int32)
        bucket[_ranges(into, count[n - 1])] = hashed[_ranges(at + (n == 1), count[n - 1])]
        into = into + count[n - 1]
    return Grams(word.reshape(-1), np.searchsorted(first, bounds), bucket, start, total)


def counts_of(g: Grams, text: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text and how many of its n-grams fall into each."""
    words, n = np.unique(g.word[g.text[text] : g.text[text + 1]], return_counts=True)
    buckets = g.bucket[_ranges(g.start[words], g.size[words])]
    found, of = np.unique(buckets, return_inverse=True)
    return found, np.bincount(of.reshape(-1), np.repeat(n, g.size[words]), len(found))


@dataclass
class Model:
    languages: list[str]
    row: np.ndarray  # of each bucket in weights; 0 for buckets without weight
    weights: np.ndarray  # (rows, languages) for a text's share of n-grams, times idf
    bias: np.ndarray
    temperature: float

    def logits(self, g: Grams) -> np.ndarray:
        """(texts, languages)"""
        n, k = len(g.text) - 1, len(self.languages)
        of_word = np.zeros((len(g.start), k))
        step = max(1, 4_000_000 // max(1, k))
        ends, at = g.start + g.size, 0
        while at < len(g.start):
            upto = max(at + 1, int(np.searchsorted(ends, g.start[at] + step, "right")))
            part = self.weights[self.row[g.bucket[g.start[at] : ends[upto - 1]]]]
            of_word[at:upto] = np.add.reduceat(part, g.start[at:upto] - g.start[at], axis=0, dtype=float)
            at = upto
        text = np.repeat(np.arange(n), np.diff(g.text))
        total = np.maximum(1, np.bincount(text, g.size[g.word], n))
        sums = np.stack([np.bincount(text, of_word[g.word, c], n) for c in range(k)], axis=1)
        return sums / total[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        g = grams_of(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(g) / self.temperature)
        some, best = np.diff(g.text) > 0, p.argmax(axis=1)
        return [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, p.max(axis=1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, n_features: int, n_labels: int,
    alpha: float = 0.5, beta: float = 0.1, l1: float = 0.05, l2: float = 0.05, epochs: int = 3,
) -> np.ndarray:
    """Weights (features, labels) by FTRL-proximal, one row (features, values) after the other; the last feature is the bias, which has no penalty.

    Each coordinate keeps z and n; its weight is 0 while |z| <= l1, else -(z - sign(z) * l1) / ((beta + sqrt(n)) / alpha + l2).
    """
    z, n = np.zeros((n_features, n_labels)), np.zeros((n_features, n_labels))

    def weights(at) -> np.ndarray:
        free = (np.asarray(at) == n_features - 1)[:, None]
        one, two = np.where(free, 0.0, l1), np.where(free, 0.0, l2)
        part = z[at]
        return np.where(np.abs(part) <= one, 0.0, (np.sign(part) * one - part) / ((beta + np.sqrt(n[at])) / alpha + two))

    for _ in range(epochs):
        for (at, x), y in zip(rows, label, strict=True):
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[at] = after
    return weights(np.arange(n_features))


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature between 1/20 and 20 with the least mean cross-entropy, by golden sections of its logarithm; 1 without rows."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        top = x.max(axis=1)
        return float((np.log(np.exp(x - top[:, None]).sum(axis=1)) + top - x[np.arange(len(x)), label]).mean())

    low, high, ratio = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray) -> Model:
    """A model from texts' (buckets, counts) and languages; every fifth of them is left for the temperature, if there are ten."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros(BUCKETS, np.int32), np.zeros((1, 0), np.float32), np.zeros(0), 1.0)
    label = np.array([languages.index(x) for x in labels], int)
    used = np.unique(np.concatenate([b for b, _ in rows]))
    values = [np.append(c / max(1, c.sum()) * idf[b] * SCALE, 1.0) for b, c in rows]
    places = [np.append(np.searchsorted(used, b), len(used)) for b, _ in rows]
    apart = np.arange(len(rows)) % 5 == 4 if len(rows) >= 10 else np.zeros(len(rows), bool)
    seen = np.flatnonzero(~apart)
    w = fit_ftrl([(places[k], values[k]) for k in seen], label[seen], len(used) + 1, len(languages))
    logits = np.array([values[k] @ w[places[k]] for k in np.flatnonzero(apart)]).reshape(-1, len(languages))
    kept = np.flatnonzero((w[:-1] != 0).any(axis=1))
    row = np.zeros(BUCKETS, np.int32)
    row[used[kept]] = np.arange(1, len(kept) + 1)
    table = np.zeros((len(kept) + 1, len(languages)), np.float32)
    table[1:] = w[kept] * (idf[used[kept]] * SCALE)[:, None]
    return Model(languages, row, table, w[-1], fit_temperature(logits, label[apart]))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with letters, and of how many of them each bucket is part; at most one row for each bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, last, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int32), 0
        for batch in batches_of_text(batches, most_bytes=2_000_000):
            g = grams_of(batch.column("text").to_pylist())
            for a, b in zip(g.text[:-1], g.text[1:], strict=True):
                words = np.unique(g.word[a:b])
                buckets = g.bucket[_ranges(g.start[words], g.size[words])]
                order = np.arange(len(buckets), dtype=np.int32)
                last[buckets] = order  # of equal buckets one place stays
                df[buckets[last[buckets] == order]] += 1
                n += b > a
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], ["bucket", "df"])

    found = texts.select("text").mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    bucket, df = found.column("bucket").to_numpy(), found.column("df").to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = df[bucket >= 0]
    return int(df[bucket < 0].sum()), out


def fitted(docs: DataFrame, rows_per_language: int = 1000, max_training_rows: int = 4000) -> Model:
    """A model of the documents that are not held out and have a language and a text.

    Document frequencies are of all of them. The regression is fitted on the driver, on at most rows_per_language
    documents of each language and max_training_rows in all, those with the smallest hashes of their id and text; only their counts come to the driver.
    """
    learned = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    learned = learned.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    n_texts, df = document_frequencies(learned)
    chance = F.xxhash64("doc_id", F.xxhash64("text"))
    counts = learned.groupBy("lang").agg(F.count("*").alias("n"))
    # chances are dealt evenly, so about twice as many rows as are wanted of a language go on to be ranked
    often = F.pmod("chance", F.lit(1 << 30)) < F.lit(2.0 * (1 << 30) * rows_per_language) / F.col("n")
    drawn = learned.select("lang", chance.alias("chance")).join(small_enough(counts, 10_000), "lang").where(often).select("lang", "chance").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("chance"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= rows_per_language).orderBy("place", "chance", "lang").limit(max_training_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches, most_bytes=2_000_000):
            g = grams_of(batch.column("text").to_pylist())
            found = [counts_of(g, k) for k in range(len(batch))]
            columns = [pa.array([f[c].astype(kind) for f in found], pa.list_(pa.from_numpy_dtype(kind))) for c, kind in ((0, np.int32), (1, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("chance"), *columns], ["lang", "chance", "buckets", "counts"])

    # the limit bounds what is broadcast
    sample = learned.withColumn("chance", chance).join(F.broadcast(drawn), ["lang", "chance"]).select("lang", "chance", "text").dropDuplicates(["lang", "chance"])
    rows = sample.mapInArrow(features, "lang string, chance long, buckets array<int>, counts array<int>").toArrow()
    order = np.lexsort((rows.column("lang").to_numpy(zero_copy_only=False).astype(str), mixed(rows.column("chance").to_numpy().view(np.uint64))))
    lists = {c: rows.column(c).combine_chunks() for c in ("buckets", "counts")}
    part = lambda c, k: lists[c].slice(k, 1).flatten().to_numpy()
    found = [(part("buckets", k), part("counts", k)) for k in order.tolist()]
    languages = rows.column("lang").to_pylist()
    kept = [k for k, f in enumerate(found) if len(f[0])]
    idf = np.log((1 + n_texts) / (1 + df)) + 1
    return fit([found[k] for k in kept], [languages[order[k]] for k in kept], idf)


def identify(docs: DataFrame, rows_per_language: int = 1000, max_training_rows: int = 4000) -> DataFrame:
    """The language of each whole text.

    docs has doc_id, text and lang; other columns are ignored. Returns one row per input row: doc_id, held_out, lang_pred, score (the calibrated probability of
    lang_pred). Null and empty texts and those without letters, and all texts where no language is learned, get `und` with score 0. Repeated
    rows get the same prediction; of equal probabilities the language that comes first is taken.
    """
    model = fitted(docs, rows_per_language, max_training_rows)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches, most_bytes=2_000_000):
            languages, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
