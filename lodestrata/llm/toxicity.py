"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input joins a vector of the word and the scaled sum of the vectors of its character 3- and
4-grams, word bounds included. The network reads the windows that begin at every word; attention
pools the states of a window into one score, and a text's score is that of its highest window, put
on a probability scale. In training, a toxic text stands for its highest window and any other text for its highest
window and some others, so the words that make texts toxic are found without marks inside texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.quality_gbt import held_out, labels_of
from lodestrata.llm.words import Words, batches_of_text, mixed, words_of

WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
DIM, HIDDEN, WINDOW = 8, 8, 10
#: Texts are scored in the windows at every word; the fit chooses among fewer.
FIT_STRIDE = 8
#: Windows that are computed together.
BLOCK = 8192


@dataclass
class Vocabulary:
    """The distinct words of some texts: their rows in the tables of words and of character n-grams."""

    of: np.ndarray  # the distinct word of each word
    row: np.ndarray
    gram: np.ndarray  # of all distinct words, one after the other
    start: np.ndarray  # of each distinct word in gram; every word has n-grams

    def scale(self) -> np.ndarray:
        return (1 / np.sqrt(np.diff(np.append(self.start, len(self.gram))))).astype(np.float32)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def vocabulary(w: Words) -> Vocabulary:
    found, first, of = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], (w.end - w.start)[first]
    # each word between two marks; a mark is byte 32, which no word holds
    framed = w.raw[np.minimum(_ranges(start - 1, size + 2), len(w.raw) - 1)].astype(np.uint64)
    at = np.cumsum(size + 2) - (size + 2)
    framed[at] = framed[at + size + 1] = 32
    framed = np.concatenate([framed, np.zeros(3, np.uint64)])
    # in place and one size after the other, as the driver's memory is narrow in the fit
    three = framed[:-3].copy()
    for k in (1, 2):
        three |= framed[k : len(framed) - 3 + k] << np.uint64(8 * k)
    row = lambda codes: (mixed(codes) % np.uint64(GRAM_ROWS)).astype(np.int32)
    of_three = row(three)
    three |= framed[3:] << np.uint64(24)
    three |= np.uint64(1 << 40)
    of_four = row(three)
    del framed, three
    n3, n4 = size, np.maximum(0, size - 1)
    both = np.empty((n3 + n4).sum(), np.int32)
    begin = np.cumsum(n3 + n4) - (n3 + n4)
    both[_ranges(begin, n3)] = of_three[_ranges(at, n3)]
    both[_ranges(begin + n3, n4)] = of_four[_ranges(at, n4)]
    return Vocabulary(of.reshape(-1), (found % np.uint64(WORD_ROWS)).astype(np.int32), both, begin)


def windows(w: Words, stride: int = FIT_STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of each window: one every `stride` words, up to the one that reaches the text's end; none for no words."""
    n = np.diff(w.text)
    count = np.where(n == 0, 0, np.maximum(1, -(-(n - WINDOW) // stride) + 1))
    text = np.repeat(np.arange(len(n)), count)
    return _ranges(np.zeros(len(n), np.int64), count) * stride + w.text[text], text


def window_words(w: Words, v: Vocabulary, first: np.ndarray, text: np.ndarray) -> np.ndarray:
    """windows x WINDOW of distinct words; -1 past a text's end."""
    at = first[:, None] + np.arange(WINDOW)
    inside = at < w.text[text + 1][:, None]
    return np.where(inside, v.of[np.minimum(at, len(v.of) - 1)], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """All parameters in one dict of float32 arrays; both directions are stacked in the first axis."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        n = lambda *shape, s: r.normal(scale=s, size=shape).astype(np.float32)
        self.p = {
            "word": n(WORD_ROWS, DIM, s=0.02), "gram": n(GRAM_ROWS, DIM, s=0.02),
            "x": n(2, 2 * DIM, 3 * HIDDEN, s=0.25), "u": n(2, HIDDEN, 3 * HIDDEN, s=0.25), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "attention": n(2 * HIDDEN, s=0.3), "out": n(2 * HIDDEN, s=0.3), "bias": np.zeros(1, np.float32),
        }
        self.slope, self.level = 1.0, 0.0

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """distinct words x inputs, with a row of zeros at the end, which -1 means."""
        out = np.zeros((len(v.row) + 1, 2 * DIM), np.float32)
        out[:-1, :DIM] = self.p["word"][v.row]
        for at in range(0, len(v.row), 65_536):  # the n-grams of some words at a time
            upto = min(len(v.row), at + 65_536)
            stop = v.start[upto] if upto < len(v.row) else len(v.gram)
            out[at:upto, DIM:] = np.add.reduceat(self.p["gram"][v.gram[v.start[at] : stop]], v.start[at:upto] - v.start[at], axis=0)
        out[:-1, DIM:] *= v.scale()[:, None]
        return out

    def forward(self, ids: np.ndarray, x: np.ndarray, keep: bool = False):
        """Scores before the sigmoid; with keep, also what backward() needs. States are in rows, windows in columns."""
        p, h2, n = self.p, 2 * HIDDEN, len(ids)
        both, kept = np.empty((WINDOW, h2, n), np.float32), ([], [])
        for d, order in enumerate((ids.T, ids.T[::-1])):
            projected, u = x @ p["x"][d] + p["b"][d], np.ascontiguousarray(p["u"][d].T)
            whole, h = bool((order >= 0).all()), np.zeros((HIDDEN, n), np.float32)
            for t in range(WINDOW):
                g, hu = np.ascontiguousarray(projected.take(order[t], axis=0).T), u @ h
                zr = g[:h2]
                zr += hu[:h2]
                np.exp(np.negative(zr, out=zr), out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:HIDDEN], zr[HIDDEN:]
                new = np.tanh(g[h2:] + r * hu[h2:])
                if keep:
                    kept[d].append((h, z, r, new, hu[h2:]))
                after = new + z * (h - new)
                h = after if whole else np.where(order[t] >= 0, after, h)
                both[t if d == 0 else WINDOW - 1 - t, d * HIDDEN : (d + 1) * HIDDEN] = h
        weight = np.where(ids.T >= 0, p["attention"] @ both, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,thb->hb", weight, both) * (ids[:, 0] >= 0)
        logit = p["out"] @ pooled + p["bias"]
        return (logit, (kept, both, weight, pooled)) if keep else logit

    def backward(self, ids, x, memory, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of x; slope: of the loss by each score."""
        p = self.p
        kept, both, weight, pooled = memory
        grad = {"out": pooled @ slope, "bias": slope.sum(keepdims=True), "u": np.zeros_like(p["u"]), "b": np.empty_like(p["b"]), "x": np.empty_like(p["x"])}
        to_pooled = p["out"][:, None] * (slope * (ids[:, 0] >= 0))
        to_weight = (both * to_pooled).sum(axis=1)
        to_score = weight * (to_weight - (weight * to_weight).sum(axis=0))
        grad["attention"] = np.einsum("tb,thb->h", to_score, both)
        to_both = weight[:, None] * to_pooled + to_score[:, None] * p["attention"][:, None]
        to_x = np.zeros_like(x)
        for d, order in enumerate((ids.T, ids.T[::-1])):
            to_state = to_both[:, :HIDDEN] if d == 0 else to_both[::-1, HIDDEN:]
            dh, dg = np.zeros((HIDDEN, len(ids)), np.float32), np.empty((WINDOW, 3 * HIDDEN, len(ids)), np.float32)
            for t in reversed(range(WINDOW)):
                h, z, r, new, hn = kept[d][t]
                dh = dh + to_state[t]
                live = order[t] >= 0
                da = dh * live
                dn = da * (1 - z) * (1 - new * new)
                dz, dr = da * (h - new) * z * (1 - z), dn * hn * r * (1 - r)
                dg[t] = np.concatenate([dz, dr, dn])
                du = np.concatenate([dz, dr, dn * r])
                grad["u"][d] += h @ du.T
                dh = da * z + dh * ~live + p["u"][d] @ du
            grad["b"][d] = dg.sum(axis=(0, 2))
            at = order.reshape(-1) % len(x)
            summed = np.stack([np.bincount(at, dg[:, k].reshape(-1), len(x)) for k in range(3 * HIDDEN)], axis=1)
            grad["x"][d] = x.T @ summed
            to_x += (summed @ p["x"][d].T).astype(np.float32)
        to_x[-1] = 0
        return grad, to_x

    def score_windows(self, w: Words, v: Vocabulary, first: np.ndarray, text: np.ndarray) -> np.ndarray:
        x, out = self.inputs(v), np.empty(len(first), np.float32)
        for at in range(0, len(first), 4096):
            part = slice(at, at + 4096)
            out[part] = self.forward(window_words(w, v, first[part], text[part]), x)
        return out

    def score_every(self, of: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of the windows at every word of a sequence of distinct words, WINDOW or more.

        Windows at neighbouring words read the same projected inputs, shifted by one; of each state only its
        part in the attention and in the output is kept.
        """
        p, h2, h3 = self.p, 2 * HIDDEN, 3 * HIDDEN
        out = np.empty(len(of) - WINDOW + 1, np.float32)
        # both gates are negated, so that they are 1 / (1 + exp(g))
        sign = np.repeat(np.array([-1, -1, 1], np.float32), HIDDEN)
        projected = [(x @ p["x"][d] + p["b"][d]) * sign for d in (0, 1)]
        halves = [np.stack([p[k][d * HIDDEN : (d + 1) * HIDDEN] for k in ("attention", "out")]) for d in (0, 1)]
        steps = [np.concatenate([(p["u"][d] * sign).T, halves[d]]) for d in (0, 1)]
        for at in range(0, len(out), BLOCK):
            n = min(BLOCK, len(out) - at)
            parts = np.zeros((WINDOW, 2, n), np.float32)  # of each place: attention, output
            zr, new, hu = np.empty((h2, n), np.float32), np.empty((HIDDEN, n), np.float32), np.empty((h3 + 2, n), np.float32)
            for d in (0, 1):
                g = np.ascontiguousarray(projected[d].take(of[at : at + n + WINDOW - 1], axis=0).T)
                h, hu[:] = np.zeros((HIDDEN, n), np.float32), 0
                for t in range(WINDOW):
                    k = t if d == 0 else WINDOW - 1 - t
                    np.add(g[:h2, k : k + n], hu[:h2], out=zr)
                    np.exp(np.minimum(zr, 80, out=zr), out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    np.multiply(zr[HIDDEN:], hu[h2:h3], out=new)
                    new += g[h2:, k : k + n]
                    np.tanh(new, out=new)
                    h -= new
                    h *= zr[:HIDDEN]
                    h += new
                    np.matmul(steps[d], h, out=hu)
                    parts[k] += hu[h3:]
            weight = np.exp(parts[:, 0] - parts[:, 0].max(axis=0))
            out[at : at + n] = (weight * parts[:, 1]).sum(axis=0) / weight.sum(axis=0)
        return out + p["bias"]

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text's highest window before the sigmoid; of a text of fewer words than a window, of its one window."""
        w = words_of(texts)
        out, n = np.full(len(texts), self.p["bias"][0], np.float32), np.diff(w.text)
        if not len(w.hash):
            return out
        v = vocabulary(w)
        x = self.inputs(v)
        short, long = np.flatnonzero((n > 0) & (n < WINDOW)), np.flatnonzero(n >= WINDOW)
        for at in range(0, len(short), BLOCK):
            part = short[at : at + BLOCK]
            out[part] = self.forward(window_words(w, v, w.text[part], part), x)
        if len(long):
            # long texts one after the other; windows over the end of one are left out of its highest
            every = self.score_every(v.of[_ranges(w.text[long], n[long])], x)
            begin = np.cumsum(n[long]) - n[long]
            bounds = np.stack([begin, begin + n[long] - WINDOW + 1], axis=1).reshape(-1)
            out[long] = np.maximum.reduceat(np.append(every, np.float32(-np.inf)), bounds)[::2]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.highest(texts).astype(float) * self.slope + self.level)


def _log_odds(rows: np.ndarray, text: np.ndarray, n: int, y: np.ndarray) -> np.ndarray:
    """For each of n table rows, how much likelier toxic texts are to hold it; 0 for what is seen in few texts."""
    pairs = np.unique(text.astype(np.int64) * n + rows)
    texts, found = pairs // n, pairs % n
    toxic = np.bincount(found, y[texts], n)
    seen = np.bincount(found, minlength=n)
    base = y.mean()
    odds = np.log((toxic + 4 * base) / (seen - toxic + 4 * (1 - base))) - np.log(base / (1 - base))
    return odds.astype(np.float32)


def fit(texts: list[str], y: np.ndarray, epochs: int = 4, least_steps: int = 100, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Network:
    """A network trained on whole texts and their labels; on no text or one label only, its scores are the share of label 1."""
    net, rng = Network(), np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    net.level, net.slope = float(np.log(share / (1 - share))), 0.0
    w = words_of(texts)
    if len(y) == 0 or y.min() == y.max() or not len(w.hash):
        return net
    v = vocabulary(w)
    first, text = windows(w, FIT_STRIDE)
    of_word = np.repeat(np.arange(len(texts)), np.diff(w.text))
    # the first component of each vector starts as what the labels say of its row alone
    one = np.unique(of_word.astype(np.int64) * len(v.row) + v.of)
    words, owners = one % len(v.row), one // len(v.row)
    n_grams = np.diff(np.append(v.start, len(v.gram)))
    net.p["word"][:, 0] = _log_odds(v.row[words], owners, WORD_ROWS, y) * 0.5
    net.p["gram"][:, 0] = _log_odds(v.gram[_ranges(v.start[words], n_grams[words])], np.repeat(owners, n_grams[words]), GRAM_ROWS, y) * 0.25
    x = net.inputs(v)
    peak = x[:, DIM] + x[:, 0]
    high = np.concatenate([peak[window_words(w, v, first[a : a + 8192], text[a : a + 8192])].max(axis=1) for a in range(0, len(first), 8192)])
    means, squares = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}
    step = 0
    epochs = max(epochs, -(-least_steps * batch // (2 * len(np.unique(text)))))
    texts_with = np.unique(text)
    starts = np.searchsorted(text, texts_with)
    for epoch in range(epochs):
        if epoch:
            high = net.score_windows(w, v, first, text)
        top = np.array([s + np.argmax(high[s:e]) for s, e in zip(starts, [*starts[1:], len(text)], strict=True)])
        clean = np.flatnonzero(y[text] == 0)
        chosen = np.concatenate([top, rng.choice(clean, min(len(clean), len(top)), replace=False)])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            part = chosen[at : at + batch]
            step += 1
            ids = window_words(w, v, first[part], text[part])
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape) - (used[0] < 0)
            used = used[used >= 0]
            small = Vocabulary(used, v.row[used], v.gram[_ranges(v.start[used], n_grams[used])], np.cumsum(n_grams[used]) - n_grams[used])
            x = net.inputs(small)
            # words are left out at random, so that windows are not known by their rare words
            seen = np.ones(x.shape, np.float32)
            seen[:-1, :DIM] = rng.random((len(used), 1)) < 0.5
            seen[:-1] *= rng.random((len(used), 1)) < 0.8
            x *= seen
            logit, memory = net.forward(local, x, keep=True)
            grad, to_x = net.backward(local, x, memory, (_sigmoid(logit) - y[text[part]]).astype(np.float32) / len(part))
            to_x *= seen
            rows = {"word": (small.row, to_x[:-1, :DIM])}
            per_gram = np.repeat(to_x[:-1, DIM:] * small.scale()[:, None], n_grams[used], axis=0)
            rows["gram"] = (small.gram, per_gram)
            for name, (row, values) in rows.items():
                touched, inverse = np.unique(row, return_inverse=True)
                summed = np.stack([np.bincount(inverse, values[:, k], len(touched)) for k in range(DIM)], axis=1).astype(np.float32)
                _adam(net.p[name], means[name], squares[name], touched, summed, rate, step)
            for name, g in grad.items():
                _adam(net.p[name], means[name], squares[name], slice(None), g.astype(np.float32), rate, step)
    del w, v, x, first, text, of_word, one, words, owners, peak
    net.slope, net.level = _scaled(np.concatenate([net.highest(texts[a : a + 256]) for a in range(0, len(texts), 256)]).astype(float), y)
    return net


def _adam(p, mean, square, at, grad, rate: float, step: int) -> None:
    mean[at] = 0.9 * mean[at] + 0.1 * grad
    square[at] = 0.99 * square[at] + 0.01 * grad * grad
    p[at] -= rate * (mean[at] / (1 - 0.9**step)) / (np.sqrt(square[at] / (1 - 0.99**step)) + 1e-6)


def _scaled(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve through the labels, by a few damped Newton steps; the slope stays within 0.1 and 5."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * score + b)
        r, h = p - y, p * (1 - p) + 1e-4
        g = np.array([(r * score).mean() + 1e-3 * (a - 1), r.mean()])
        m = np.array([[(h * score**2).mean() + 1e-3, (h * score).mean()], [(h * score).mean(), h.mean()]])
        da, db = np.linalg.solve(m, g) * 0.5
        a, b = float(np.clip(a - da, 0.1, 5)), float(np.clip(b - db, -50, 50))
    return a, b


def score_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_other: int = 3000, max_chars: int = 6000) -> DataFrame:
    """A toxicity score of each whole text.

    docs has doc_id and text, labels has doc_id and toxic; other columns are ignored. Returns one
    row per input row: doc_id, held_out, score (0 to 1). The network is fitted on the driver, on at
    most max_toxic and max_other labelled documents, not held out and of at most max_chars
    characters, with the smallest hash of their id; that bounds the fit, while every window of every text is scored. Null and empty
    texts get the score of a window without words. Without any label every score is 0.5. Repeated rows get the same score.
    """
    known = labels_of(labels, "toxic").where(~held_out(F.col("doc_id")))
    # texts too long for the fit are found only after the choice, so twice as many ids are drawn
    ids = [
        known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
        for label, most in ((1, max_toxic), (0, max_other))
    ]
    drawn = F.broadcast(ids[0].union(ids[1]))  # at most 2 * (max_toxic + max_other) rows
    sample = (
        docs.where(F.length("text") <= max_chars).select(F.col("doc_id"), "text").join(drawn, "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text")).toArrow()  # of an id with several texts the smallest
    )
    label, order = sample.column("label").to_numpy(), np.argsort(mixed(sample.column("doc_id").to_numpy().astype(np.uint64)))
    kept = np.concatenate([order[label[order] == k][:most] for k, most in ((0, max_other), (1, min(max_toxic, max_other)))])
    chosen = order[np.isin(order, kept)]
    texts = sample.column("text").take(pa.array(chosen)).to_pylist()
    del sample  # the driver's memory is the narrow one here
    net = fit(texts, label[chosen].astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches, most_bytes=8_000_000):
            scores = pa.array(net.score(batch.column("text").to_pylist()).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double"
    )
