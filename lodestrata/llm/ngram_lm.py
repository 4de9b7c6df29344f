"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Counts move as blocks: each task counts what it reads and sends one block of sorted keys and counts
to each shard, where blocks are added up. A shard of the model is a pair of files in the shared folder, sorted 64-bit
hashes and their counts, which workers map into memory. Pairs are dealt to shards by their
first word, so that what follows a word is counted in one place; words that would crowd a shard
have their pairs dealt by both words, and what is counted of them in each shard is added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import mapped_array, new_folder, put_array, stored
from lodestrata.llm.words import batches_of_text, mixed, words_of

BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
#: What is known of a word: its count, in how many pairs it is second, and how many pairs it begins that occur once, twice, more.
COLUMNS = ("count", "before", "once", "twice", "more")
#: Bytes of text that a task takes apart at once.
PART_BYTES = 2_000_000
#: Most words whose pairs are dealt by both words; a list of 8 bytes each goes to all tasks.
MOST_CROWDED = 1 << 20
BLOCK = "shard int, keys binary, firsts binary, runs binary, counts binary"


class Tokens(NamedTuple):
    hash: np.ndarray  # of all tokens, each text's end included
    before: np.ndarray  # of the token before each
    text: np.ndarray  # of each token


def tokens_of(texts: list[str | None]) -> Tokens:
    w = words_of(texts)
    h = np.insert(w.hash, w.text[1:], END)
    text = np.repeat(np.arange(len(texts)), np.diff(w.text) + 1)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.searchsorted(text, np.arange(len(texts)))] = BEGIN
    return Tokens(h, before, text)


def pair_keys(before: np.ndarray, word: np.ndarray, crowded: np.ndarray, bits: int) -> np.ndarray:
    """Keys of pairs; the first `bits` bits are the shard: those of the first word, or of the pair if that word is crowded."""
    pair = mixed(before * np.uint64(0x9E3779B97F4A7C15) ^ word)
    if not bits:
        return pair
    place = np.where(np.isin(before, crowded), mixed(pair), before)
    rest = np.uint64(64 - bits)
    return (place >> rest << rest) | (pair >> np.uint64(bits))


def _shards(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard begins in sorted keys, and their number."""
    if not bits:
        return np.array([0, len(keys)])
    firsts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def _row(shard: int, keys=b"", firsts=b"", runs=b"", counts=b"") -> dict:
    return {"shard": shard, "keys": bytes(keys), "firsts": bytes(firsts), "runs": bytes(runs), "counts": bytes(counts)}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("firsts", pa.binary()), ("runs", pa.binary()), ("counts", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def _word_blocks(keys: np.ndarray, columns: list[np.ndarray], bits: int) -> Iterator[dict]:
    """Blocks of sorted word hashes with their columns."""
    at = _shards(keys, bits)
    for shard in np.flatnonzero(np.diff(at)):
        part = slice(at[shard], at[shard + 1])
        yield _row(int(shard), keys[part].tobytes(), counts=np.stack([c[part] for c in columns]).astype(np.int64).tobytes())


def _summed(keys: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their columns (columns x keys)."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], columns[:, order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(columns, first, axis=1) if len(keys) else columns


def _read_blocks(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    counts = [np.frombuffer(x.as_py(), np.int64).reshape(width, -1) for x in table.column("counts")]
    return np.concatenate(keys), np.concatenate(counts, axis=1)


def _map_words(bits: int, flush: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches_of_text(batches, most_bytes=PART_BYTES):
            held.append(tokens_of(batch.column("text").to_pylist()).hash)
            if sum(map(len, held)) >= flush:
                yield _counted(held)
                held = []
        if held:
            yield _counted(held)

    def _counted(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return _batch(list(_word_blocks(keys, [n], bits)))

    return count


def _add_words(width: int, bits: int):
    def add(table: pa.Table) -> pa.Table:
        keys, columns = _summed(*_read_blocks(table, width))
        return pa.Table.from_batches([_batch(list(_word_blocks(keys, list(columns), bits)))])

    return add


def _map_pairs(bits: int, crowded: np.ndarray, flush: int):
    def blocks(held: list[Tokens]) -> pa.RecordBatch:
        before, word = (np.concatenate([getattr(t, k) for t in held]) for k in ("before", "hash"))
        held.clear()
        keys, index, n = np.unique(pair_keys(before, word, crowded, bits), return_index=True, return_counts=True)
        before, word, at, rows = before[index], word[index], _shards(keys, bits), []
        for shard in np.flatnonzero(np.diff(at)):
            part = slice(at[shard], at[shard + 1])
            order = np.argsort(before[part], kind="stable")
            b = before[part][order]
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            runs = np.diff(np.append(first, len(b))).astype(np.uint32)
            rows.append(_row(int(shard), word[part][order].tobytes(), b[first].tobytes(), runs.tobytes(), n[part][order].astype(np.uint32).tobytes()))
        return _batch(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Tokens] = []
        for batch in batches_of_text(batches, most_bytes=PART_BYTES):
            held.append(tokens_of(batch.column("text").to_pylist()))
            if sum(len(t.hash) for t in held) >= flush:
                yield blocks(held)
        if held:
            yield blocks(held)

    return count


def _add_pairs(folder: str, bits: int, crowded: np.ndarray, word_bits: int):
    """Adds up a shard's pairs, writes its files, and gives what they say of single words."""

    def add(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        word = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")])
        first = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("firsts")])
        runs = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("runs")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
        before = np.repeat(first, runs)
        keys = pair_keys(before, word, crowded, bits)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        keys, total = keys[start], np.add.reduceat(counts[order].astype(np.int64), start) if len(keys) else np.empty(0, np.int64)
        before, word = before[order][start], word[order][start]
        put_array(f"{folder}/pairs-{shard}-keys.npy", keys)
        put_array(f"{folder}/pairs-{shard}-counts.npy", total if total.max(initial=0) >= 2**32 else total.astype(np.uint32))
        zero, one = np.zeros(len(word), np.int64), np.ones(len(word), np.int64)
        facts = np.concatenate([
            np.stack([zero, one, zero, zero, zero]),
            np.stack([zero, zero, total == 1, total == 2, total > 2]).astype(np.int64),
        ], axis=1)
        keys, columns = _summed(np.concatenate([word, before]), facts)
        rows = list(_word_blocks(keys, list(columns), word_bits))
        rows.append(_row(-1, counts=np.bincount(np.minimum(total, 5), minlength=6)[1:5].astype(np.int64).tobytes()))
        return pa.Table.from_batches([_batch(rows)])

    return add


def _write_words(folder: str):
    """Adds up all that is known of a shard's words, writes its files, and gives how many words there are and follow how many."""

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, columns = _summed(*_read_blocks(table, len(COLUMNS)))
        put_array(f"{folder}/words-{shard}-keys.npy", keys)
        put_array(f"{folder}/words-{shard}-columns.npy", columns)
        kinds = np.bincount(np.minimum(columns[1], 5), minlength=6)[1:5]
        facts = [(columns[0] > 0).sum(), columns[0].sum(), columns[1].sum(), *kinds, (columns[1] > 2).sum()]
        return pa.Table.from_batches([_batch([_row(shard, counts=np.array(facts, np.int64).tobytes())])])

    return write


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many counts are 1 to 4; plain values where one is missing."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.05 * k, 0.95 * k)) for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1))


class Model(NamedTuple):
    """What scoring needs besides the files; a few numbers and the crowded words."""

    folder: str
    word_bits: int
    pair_bits: int
    crowded: np.ndarray
    tokens: int  # in training
    kinds: int  # distinct tokens
    pairs: int  # distinct pairs
    texts: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_left: float  # what the word discounts take off all words

    def _found(self, name: str, keys: np.ndarray, bits: int, values: str) -> np.ndarray:
        """Rows of sorted keys in the files, 0 for keys that they lack."""
        at, out = _shards(keys, bits), None
        for shard in np.flatnonzero(np.diff(at)):
            part = slice(at[shard], at[shard + 1])
            uri = f"{self.folder}/{name}-{shard}"
            # every shard has its files, if only empty ones: an absent file is an error
            known, found = mapped_array(f"{uri}-keys.npy"), mapped_array(f"{uri}-{values}.npy")
            if out is None:
                out = np.zeros((*found.shape[:-1], len(keys)), np.int64)
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
            out[..., part] = np.where(known[place] == keys[part], found[..., place], 0)
        return out if out is not None else np.zeros((len(COLUMNS), len(keys)) if name == "words" else len(keys), np.int64)

    def word_probability(self, before: np.ndarray) -> np.ndarray:
        """Of words by the number of words they follow; discounts go to all words and one unknown word alike."""
        if self.pairs == 0:
            return np.full(len(before), 1 / (self.kinds + 1))
        d = np.array([0, *self.word_discounts])[np.minimum(before, 3)]
        return (before - d) / self.pairs + self.word_left / self.pairs / (self.kinds + 1)

    def token_scores(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """For each token its training count and log10 of its probability after the token before it."""
        keys, place = np.unique(np.concatenate([t.hash, t.before]), return_inverse=True)
        known = self._found("words", keys, self.word_bits, "columns")
        word, before = place[: len(t.hash)], place[len(t.hash) :]
        pairs, at = np.unique(pair_keys(t.before, t.hash, self.crowded, self.pair_bits), return_inverse=True)
        c = self._found("pairs", pairs, self.pair_bits, "counts")[at]
        count = known[0]
        # every token but an end has one after it, and every text has a first
        followed = np.where(keys == BEGIN, self.texts, np.where(keys == END, 0, count))
        left = np.tensordot(np.array(self.pair_discounts), known[2:5], 1)
        back = np.where(followed > 0, left / np.maximum(followed, 1), 1.0)
        d = np.array([0, *self.pair_discounts])[np.minimum(c, 3)]
        p = (c - d) / np.maximum(followed[before], 1) + back[before] * self.word_probability(known[1])[word]
        return count[word], np.log10(p)

    def score_texts(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        t = tokens_of(texts)
        count, score = self.token_scores(t)
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))
        n = len(texts)
        return np.bincount(t.text, minlength=n), np.bincount(t.text, count > 0, n).astype(np.int64), np.bincount(t.text, base, n), np.bincount(t.text, score, n)


def train(docs: DataFrame, shard_bytes: int = 8_000_000, flush: int = 500_000) -> Model:
    """A model of the texts of docs; nothing but sums and the crowded words, at most MOST_CROWDED, comes to the driver."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "lm")
    texts = docs.select("text")
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, (n_bytes // shard_bytes).bit_length())
    counted = texts.mapInArrow(_map_words(bits, flush), BLOCK).groupBy("shard").applyInArrow(_add_words(1, bits), BLOCK)
    words = stored(counted, "lm-words")

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(x.as_py(), np.int64).sum()) for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], ["n"])

    tokens = words.select("counts").mapInArrow(facts, "n long").agg(F.sum("n")).first()[0] or 0
    least = max(1, tokens >> (bits + 2), tokens // MOST_CROWDED)  # of a word's tokens, so no more words than that
    every_shard = spark.range(1 << bits).select(F.col("id").cast("int").alias("shard"), *(F.lit(b"").alias(c) for c in ("keys", "firsts", "runs", "counts")))

    def crowded_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                k = np.frombuffer(keys.as_py(), np.uint64)[np.frombuffer(counts.as_py(), np.int64) >= least]
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64))], ["k"])

    crowded = words.select("keys", "counts").mapInArrow(crowded_words, "k long").toArrow().column("k").to_numpy().view(np.uint64)
    crowded = np.sort(np.append(crowded, BEGIN))
    told = stored(
        texts.mapInArrow(_map_pairs(bits, crowded, flush), BLOCK).union(every_shard).groupBy("shard").applyInArrow(_add_pairs(folder, bits, crowded, bits), BLOCK), "lm-pairs"
    )

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "counts")), strict=True):
                wide = np.zeros((len(COLUMNS), len(keys) // 8), np.int64)
                wide[0] = np.frombuffer(counts, np.int64)
                rows.append(_row(shard, keys, counts=wide.tobytes()))
            yield _batch(rows)

    about = words.mapInArrow(widened, BLOCK).union(told.where("shard >= 0")).union(every_shard)
    about = stored(about.groupBy("shard").applyInArrow(_write_words(folder), BLOCK), "lm-about")

    def sums(df: DataFrame, width: int) -> list[int]:
        """Sums of the columns of rows of counts, added up in Spark."""

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column("counts"):
                    values = np.frombuffer(x.as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(values)], ["i", "n"])

        found = {r.i: r.n for r in df.select("counts").mapInArrow(apart, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
        return [found.get(i, 0) for i in range(width)]

    n_words, n_tokens, n_pairs, *kinds, three_or_more = sums(about, 8)
    of_pairs = sums(told.where("shard < 0"), 4)
    d_words = discounts(np.array(kinds))
    left = d_words[0] * kinds[0] + d_words[1] * kinds[1] + d_words[2] * three_or_more
    return Model(folder, bits, bits, crowded, n_tokens, n_words, n_pairs, docs.count(), discounts(np.array(of_pairs)), d_words, left)


def learned(doc_id: Column) -> Column:
    """Documents that the model learns from: crc32 of the id as text leaves other than 1 when divided by 5; null ids too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def score_lm(docs: DataFrame) -> DataFrame:
    """The log10 probability of each whole text under a model of the texts that are not held out.

    docs has doc_id and text; other columns are ignored. Returns one row per input row: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score (under smoothed single-token shares), score. Null and empty
    texts are their end alone, which is learned like any token. Repeated rows count as often as
    they come and get the same score. If nothing is learned from, every token has the one probability that is left.
    """
    texts = docs.select("doc_id", (~learned(F.col("doc_id"))).alias("held_out"), "text")
    model = train(docs.where(learned(F.col("doc_id"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches, most_bytes=4_000_000):
            n, known, base, scores = (pa.array(x) for x in model.score_texts(batch.column("text").to_pylist()))
            total = pa.array(np.full(len(batch), model.tokens), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), n, known, total, base, scores],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
