"""Token counts by compiling a byte-pair tokenizer into a deterministic transducer.

Byte-pair encodings have two properties that make them finite-state: the encoding of a prefix that
ends between tokens is a prefix of the encoding, and tokens in a row are an encoding exactly if each
two neighbours are one. So, reading symbol by symbol, there is one last token at each position, and
it is found from the last tokens at earlier positions that lie within one token's length. A state
holds those: for each suffix that may still grow into a token, its node in the trie of tokens, the
token before it, and the count there against the count now. Transitions carry the change of the
count, and are compiled when first taken.

A text is cut into chunks. A chunk's map from the state before it to the count and state after it
is constant but for what precedes its first and follows its last white space, at which the
transducer is in its initial state; so a map is a head, a count and a tail; a chunk without white space is a head only.
Maps are joined pairwise, which is associative, in log2(chunks) rounds.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: The pre-tokenizer's pattern, as the vocabulary file states it; text between matches is dropped.
#: The same for ASCII text, in the faster module of the standard library.
ASCII_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]+"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letters that stand for bytes: printable Latin-1 characters as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Pieces(dict):
    """Counts of pieces; those that are missing are counted."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, piece: str) -> int:
        return self.count(piece)


class Transducer:
    """Counts the tokens of pieces; compiled from a vocabulary file of byte pairs with word ends."""

    def __init__(self, path: str, max_states: int = 200_000, max_pieces: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("not a byte-pair vocabulary with word ends")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        letters = byte_letters()
        # symbols 0-255 are bytes within a piece, 256-511 bytes at its end
        self.symbol = {s: i for i, s in enumerate([*letters, *(x + END for x in letters)])}
        self.token = [t for t in model["vocab"]]
        self.spelled = [self._spell(t) for t in self.token]
        self.trie: list[dict[int, int]] = [{}]
        self.accepts: dict[int, int] = {}
        for t, spelled in enumerate(self.spelled):
            node = 0
            for s in spelled:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                node = self.trie[node][s]
            self.accepts[node] = t
        self.max_states, self.max_pieces = max_states, max_pieces
        self.joins: dict[int, bool] = {}
        self.pieces = Pieces(self.piece)
        self.reset()

    def _spell(self, token: str) -> list[int]:
        body, last = (token[: -len(END)], True) if token.endswith(END) and len(token) > len(END) else (token, False)
        out = [self.symbol[x] for x in body]
        if last:
            out[-1] += 256
        return out

    def reset(self) -> None:
        """Forgets the compiled transitions, which bounds the memory; they are compiled again when met."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def _merged(self, symbols: list[int]) -> list[str]:
        names = list(self.symbol)
        parts = [names[s] for s in symbols] if not hasattr(self, "_names") else [self._names[s] for s in symbols]
        self._names = names
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 30))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _follows(self, before: int, token: int) -> bool:
        """Whether `token` may come right after `before` (-1: at the start of a piece)."""
        key = (before + 1) * len(self.token) + token
        if key not in self.joins:
            if len(self.joins) > 2_000_000:
                self.joins.clear()
            want = [self.token[token]] if before < 0 else [self.token[before], self.token[token]]
            self.joins[key] = self._merged((self.spelled[before] if before >= 0 else []) + self.spelled[token]) == want
        return self.joins[key]

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        grown, found = [], None
        for node, before, count in self.states[state]:
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            if self.trie[child]:
                grown.append((child, before, count))
            token = self.accepts.get(child)
            if found is None and token is not None and self._follows(before, token):
                found = (token, count + 1)
        if found is None:
            raise ValueError("the vocabulary has no token for a byte")
        last, change = found
        after = (*((n, b, c - change) for n, b, c in grown), (0, last, 0))
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
            self.next.append({})
        self.next[state][symbol] = step = (self.numbers[after], change)
        return step

    def piece(self, piece: str) -> int:
        if len(self.states) > self.max_states:
            self.reset()
        raw = piece.encode("utf-8", "surrogatepass")
        state = count = 0
        for symbol in (*raw[:-1], raw[-1] + 256):
            step = self.next[state].get(symbol) or self._compile(state, symbol)
            state, count = step[0], count + step[1]
        if len(piece) <= 40:
            if len(self.pieces) >= self.max_pieces:
                self.pieces.clear()
            self.pieces[piece] = count
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings, from the initial state."""
        if text.isascii():
            found = ASCII_PATTERN.findall(text.lower())
        else:
            found = PATTERN.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())  # no final form of sigma
        return sum(map(self.pieces.__getitem__, found))

    def count(self, text: str) -> int:
        """Tokens of a text; special strings are one token each, as they are spelled in the raw text."""
        if any(s in text for s in self.specials):
            parts = regex.split("|".join(map(regex.escape, self.specials)), text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


PATTERN, ASCII_PATTERN = regex.compile(PIECE), re.compile(ASCII_PIECE)
GAP = regex.compile(r"\p{White_Space}")


class ChunkMap(NamedTuple):
    """head and tail touch other chunks; middle is the count between; without white space there is a head only."""

    head: str
    middle: int = 0
    tail: str | None = None


def chunk_map(t: Transducer, chunk: str) -> ChunkMap:
    first = GAP.search(chunk)
    if first is None:
        return ChunkMap(chunk)
    last = next(i for i in range(len(chunk) - 1, -1, -1) if GAP.match(chunk[i]))
    return ChunkMap(chunk[: first.start()], t.count(chunk[first.start() : last + 1]), chunk[last + 1 :])


def joined(t: Transducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    if a.tail is None:
        return ChunkMap(a.head + b.head, b.middle, b.tail)
    if b.tail is None:
        return ChunkMap(a.head, a.middle, a.tail + b.head)
    return ChunkMap(a.head, a.middle + t.count(a.tail + b.head) + b.middle, b.tail)


def reduced(t: Transducer, maps: list[ChunkMap]) -> ChunkMap:
    """All maps joined, two neighbours at a time in log2(chunks) rounds: the last prefix of the scan, which is all that a total needs."""
    while len(maps) > 1:
        maps = [joined(t, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def count_tokens(t: Transducer, text: str | None, chunk: int = 65_536) -> int:
    text = text or ""
    if len(text) <= chunk:  # one chunk, which begins and ends in the initial state
        return t.count(text)
    whole = reduced(t, [chunk_map(t, text[i : i + chunk]) for i in range(0, len(text), chunk)])
    return t.count(whole.head) + whole.middle + (t.count(whole.tail) if whole.tail else 0)


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """One transducer for each worker process and vocabulary."""
    return Transducer(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of each whole text, without begin, end or added special tokens.

    docs has doc_id and text; other columns are ignored. path is the vocabulary's place on every
    machine. Returns one row per input row: doc_id, n_bytes, n_tokens, over_limit. Null and empty
    texts have no bytes and no tokens; repeated rows have a result each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(path)
        for batch in batches:
            n = pa.array([count_tokens(t, x.as_py()) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select("doc_id", size, "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
