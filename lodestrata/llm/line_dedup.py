"""Line dedup by an exact set-similarity join of lines.

A line is the set of its words, A-Z in lower case. Words are ordered by rarity; two sets with a Jaccard
similarity of at least the threshold share a word among their first (rarest) ones, the prefix. So
lines meet at the words of their prefixes, where pairs must pass the length filter, the positional
filter (what can still be common after the shared word) and a 128-bit parity sketch of the sets, whose
differing bits are at most the differing words. What passes is verified on the whole sets.

Lines are in the order of doc_id and place. Equal sets are met by their key and compared once. One
earlier match is enough to remove a line, so of each line only the candidates with the closest sketches are verified at first:
few where a sketch is close, more where all are doubtful. Lines whose candidates failed while more
were left are searched again with more candidates, until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import stored
from lodestrata.llm.words import batches_of_text, coded, mixed, words_of

#: Words of one cell share a rarity, so the table of rarities has this size at any number of words.
CELL_BITS, SHARD_BITS = 23, 6
LAST = 2**63 - 1
#: Bytes of text that a task takes apart at once, and pairs that it compares at once.
PART_BYTES, PART_PAIRS = 4_000_000, 500_000


class Sets(NamedTuple):
    """The distinct words of each line that has words."""

    line: np.ndarray  # number of the line among all lines of the texts
    start: np.ndarray  # of each line in hash
    size: np.ndarray
    hash: np.ndarray
    key: np.ndarray  # uint64, equal for equal sets
    more: np.ndarray  # uint64, 64 bits more of the key, so that different sets are not taken for equal
    first: np.ndarray  # number of the first line of each text, and the number of lines


def line_sets(texts: list[str | bytes | None]) -> Sets:
    texts = coded(texts)
    w = words_of(texts)
    ends = np.flatnonzero(w.raw[:-8] == 10)
    line = np.searchsorted(ends, w.start)
    first = np.searchsorted(ends, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    bits = max(1, int(len(ends)).bit_length())
    place = (line.astype(np.uint64) << np.uint64(64 - bits)) | (w.hash >> np.uint64(bits))
    order = np.argsort(place)
    h, ordered = w.hash[order], place[order]
    if ((ordered[1:] == ordered[:-1]) & (h[1:] != h[:-1])).any():
        order = np.lexsort((w.hash, line))
        h = w.hash[order]
    lines = line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (lines[1:] != lines[:-1])
    h, lines = h[new], lines[new]
    start = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1]])) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(h)))
    key = mixed(np.add.reduceat(mixed(h), start) + size.astype(np.uint64)) if len(h) else h
    more = np.add.reduceat(mixed(~h), start) if len(h) else h
    return Sets(lines[start], start, size, h, key, more, first)


def _changes(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Where rows in an order differ from the row before, and the first row."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return new


def _order_id(docs: DataFrame) -> DataFrame:
    """Null ids come last; rows of one id and different texts are told apart by a hash of the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At the end of a task, the counts of cells by shard and the bytes read."""
    kinds = pa.schema([("shard", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("n_bytes", pa.int64())])
    total, n_bytes = np.zeros(1 << CELL_BITS, np.uint32), 0
    for batch in batches_of_text(batches, most_bytes=PART_BYTES):
        w = words_of(batch.column("text").to_pylist())
        n_bytes += len(w.raw)
        np.add.at(total, (w.hash >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
    rows = []
    for shard, part in enumerate(total.reshape(1 << SHARD_BITS, -1)):
        cells = np.flatnonzero(part)
        if len(cells):
            rows.append({"shard": shard, "cells": cells.astype(np.uint32).tobytes(), "counts": part[cells].tobytes(), "n_bytes": n_bytes})
            n_bytes = 0
    yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _rarity_codes(table: pa.Table) -> pa.Table:
    """The codes of a shard's cells: counts up to 16 as they are, above in eighths of a doubling."""
    total = np.zeros(1 << (CELL_BITS - SHARD_BITS), np.int64)
    for cells, counts in zip(table.column("cells"), table.column("counts"), strict=True):
        total[np.frombuffer(cells.as_py(), np.uint32)] += np.frombuffer(counts.as_py(), np.uint32)
    codes = np.where(total <= 16, total, np.minimum(255, 16 + 8 * np.log2(np.maximum(total, 16) / 16))).astype(np.uint8)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "codes": pa.array([codes.tobytes()])})


#: The first code of words that may be in more lines than one task should meet.
COMMON_CODE = 16 + 8 * 11
ENTRY = ("token", "key", "doc", "line", "size", "place", "sketch", "sketch2")
KINDS = {"token": np.uint64, "key": np.uint64, "doc": np.int64, "line": np.int32, "size": np.int32, "place": np.int32, "sketch": np.uint64, "sketch2": np.uint64}
BLOCK = "bucket int, lo int, hi int, " + ", ".join(f"{c} binary" for c in ENTRY)


def _blocks(entries: dict[str, np.ndarray], bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """A row for each (bucket, lo, hi), whose columns are arrays of the entries."""
    order = np.lexsort((hi, lo, bucket))
    b, i, j = bucket[order], lo[order], hi[order]
    at = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(b) else np.empty(0, np.int64)
    stop = np.append(at[1:], len(b))[: len(at)]
    columns = [pa.array(x[at], pa.int32()) for x in (b, i, j)]
    for c in ENTRY:
        values = entries[c][order]
        if KINDS[c] == np.int32 and values.max(initial=0) < 1 << 16:  # half the bytes; the length of the row tells
            values = values.astype(np.uint16)
        columns.append(pa.array([values[x:y].tobytes() for x, y in zip(at, stop, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["bucket", "lo", "hi", *ENTRY])


def _read(table: pa.Table) -> dict[str, np.ndarray]:
    n = [len(x.as_py()) // 8 for x in table.column("token")]
    out = {}
    for c, kind in KINDS.items():
        parts = [(x.as_py(), k) for x, k in zip(table.column(c), n, strict=True)]
        out[c] = np.concatenate([np.frombuffer(x, np.uint16 if kind == np.int32 and len(x) == 2 * k else kind).astype(kind, copy=False) for x, k in parts])
    return out


def prefix_size(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def smaller_prefix_size(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many of its first words a line shares one with any similar line that is no smaller."""
    return size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64) + 1


def _entries(s: Sets, doc: np.ndarray, codes: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The words of the lines' prefixes that another line may hold too, each with what the filters need."""
    # of equal sets in the batch the earliest
    text = np.searchsorted(s.first, s.line, "right") - 1
    place = s.line - s.first[text]
    order = np.lexsort((place, doc[text], s.more, s.key))
    one = np.sort(order[_changes(order, s.key, s.more)])
    size = s.size[one]
    ends = np.cumsum(size)
    mine = np.arange(ends[-1] if len(ends) else 0) + np.repeat(s.start[one] - (ends - size), size)
    h = s.hash[mine]
    code = codes[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    owner = np.repeat(np.arange(len(one)), size)
    bits = max(1, len(one).bit_length())
    rank = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (code.astype(np.uint64) << np.uint64(56 - bits)) | (h >> np.uint64(bits + 8))
    order = np.argsort(rank)
    if (rank[order][1:] == rank[order][:-1]).any():
        order = np.lexsort((h, code, owner))
    at = np.arange(len(h)) - np.repeat(ends - size, size)
    pick = (at < prefix_size(size, threshold)[owner]) & (code[order] > 1)  # a word counted once is in no other line
    bit, one_bit = (h >> np.uint64(11)) & np.uint64(127), np.uint64(1)
    halves = (np.where(low, one_bit << (bit & np.uint64(63)), np.uint64(0)) for low in (bit < 64, bit >= 64))
    sketch, sketch2 = (np.bitwise_xor.reduceat(x, ends - size) if len(h) else h for x in halves)
    o = owner[pick]
    return {
        "token": h[order][pick], "key": s.key[one][o], "doc": doc[text[one]][o], "line": place[one][o].astype(np.int32),
        "size": size[o].astype(np.int32), "place": at[pick].astype(np.int32), "sketch": sketch[o], "sketch2": sketch2[o], "code": code[order][pick],
    }


#: How many candidates of a line are verified at first: few where the closest is close, more where all are doubtful.
CLOSE, FAR = 16, 512
PAIR = ("later", "earlier", "rank", "distance", "later_doc", "later_line", "earlier_doc", "earlier_line")


def _candidates(e: dict[str, np.ndarray], side: np.ndarray | None, threshold: float, most: int, wanted: tuple[bytes, int] | None = None) -> dict[str, np.ndarray]:
    """Pairs of a later and an earlier line that meet at a word and pass the filters.

    Of each later line at one word those with the closest sketches, CLOSE * most if the closest is within half of what the
    filter allows, else FAR * most; rank 0, or -1 for one more, which says that there are more. side: pairs must have different sides; wanted: a filter of bits of the later lines' keys.
    """
    order = np.lexsort((e["size"], e["token"]))
    e = {c: e[c][order] for c in ENTRY}
    side = None if side is None else side[order]
    n = len(order)
    group = np.cumsum(np.concatenate([[False], e["token"][1:] != e["token"][:-1]])) if n else np.empty(0, np.int64)
    place = (group.astype(np.int64) << 32) | e["size"]
    lowest = np.ceil(threshold * e["size"] - 1e-9).astype(np.int64)
    start = np.searchsorted(place, (group.astype(np.int64) << 32) | lowest)
    before = np.arange(n) - start
    short = e["place"] < smaller_prefix_size(e["size"].astype(np.int64), threshold)
    done = np.concatenate([[0], np.cumsum(before)])

    def closest(late, early, distance, allowed):
        """Of each later line its closest candidates and one more, in order, with their ranks and how many may come."""
        order = np.lexsort((e["line"][early], e["doc"][early], distance, late))
        late, early, distance, allowed = late[order], early[order], distance[order], allowed[order]
        first = np.flatnonzero(np.concatenate([[True], late[1:] != late[:-1]])) if len(late) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(late)))
        rank = np.arange(len(late)) - np.repeat(first, size)
        cap = np.repeat(np.where(distance[first] * 2 <= allowed[first], CLOSE * most, FAR * most), size)
        keep = rank <= cap
        return [x[keep] for x in (late, early, distance, allowed)], rank[keep], cap[keep]

    none = np.empty(0, np.int64)
    out, held, at = [(none, none, none, none)], 0, 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(done, done[at] + PART_PAIRS, "right")) - 1)
        count = before[at:upto]
        j = np.repeat(np.arange(at, upto), count)
        i = np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count) + start[j]
        at = upto
        both = e["size"][i] + e["size"][j]
        least = np.ceil(threshold / (1 + threshold) * both - 1e-9)
        allowed = (both - 2 * least).astype(np.int64)
        distance = sum(np.bitwise_count(e[c][i] ^ e[c][j]).astype(np.int64) for c in ("sketch", "sketch2"))
        ok = (distance <= allowed) & (np.minimum(e["size"][i] - e["place"][i], e["size"][j] - e["place"][j]) >= least)
        ok &= (e["key"][i] != e["key"][j]) & short[i]  # i is the smaller one
        if side is not None:
            ok &= side[i] != side[j]
        i, j, distance, allowed = i[ok], j[ok], distance[ok], allowed[ok]
        swap = (e["doc"][i] > e["doc"][j]) | ((e["doc"][i] == e["doc"][j]) & ((e["line"][i] > e["line"][j]) | ((e["line"][i] == e["line"][j]) & (e["key"][i] > e["key"][j]))))
        late, early = np.where(swap, i, j), np.where(swap, j, i)
        ok = slice(None) if wanted is None else _has_bit(e["key"][late], *wanted)
        out.append((late[ok], early[ok], distance[ok], allowed[ok]))
        held += len(out[-1][0])
        if held > 4 * PART_PAIRS:  # what can't come any more goes, so that a crowd of lines holds no more than its caps
            out = [closest(*(np.concatenate(x) for x in zip(*out, strict=True)))[0]]
            held = 0
    (late, early, distance, _), rank, cap = closest(*(np.concatenate(x) for x in zip(*out, strict=True)))
    return {
        "later": e["key"][late], "earlier": e["key"][early], "rank": np.where(rank == cap, -1, 0), "distance": distance,
        "later_doc": e["doc"][late], "later_line": e["line"][late], "earlier_doc": e["doc"][early], "earlier_line": e["line"][early],
    }


def _distinct(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of entries with equal word and set the earliest."""
    order = np.lexsort((e["line"], e["doc"], e["sketch"], e["key"], e["token"]))
    keep = order[_changes(order, e["token"], e["key"], e["sketch"])]
    return {c: e[c][keep] for c in ENTRY}


PAIR_COLUMNS = "later long, earlier long, rank long, distance long, later_doc long, later_line int, earlier_doc long, earlier_line int"


def _pair_table(found: dict[str, np.ndarray]) -> pa.Table:
    """A pair that met at several words of this block once, with rank -1 if it has that at any."""
    order = np.lexsort((found["rank"], found["earlier"], found["later"]))
    a, b = found["later"][order], found["earlier"][order]
    keep = order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(order) else order
    kinds = {"later_line": np.int32, "earlier_line": np.int32}
    return pa.table({c: pa.array(found[c][keep].view(np.int64) if found[c].dtype == np.uint64 else found[c][keep].astype(kinds.get(c, np.int64))) for c in PAIR})


def _met_table(pairs: pa.Table | None = None, entries: dict | None = None, lines: dict | None = None) -> pa.Table:
    """One of the three results of a block, with nulls for the others."""
    kinds = {**dict.fromkeys(PAIR, pa.int64()), "later_line": pa.int32(), "earlier_line": pa.int32(), **{f"e_{c}": pa.binary() for c in ENTRY}}
    kinds |= {"key": pa.int64(), "doc": pa.int64(), "version": pa.int64(), "line": pa.int32(), "first": pa.bool_()}
    given: dict[str, pa.Array] = {}
    if pairs is not None:
        given = {c: pairs.column(c) for c in PAIR}
    elif entries is not None:
        given = {f"e_{c}": pa.array([entries[c].tobytes()]) for c in ENTRY}
    elif lines is not None:
        given = {"key": pa.array(lines["key"].view(np.int64)), "doc": pa.array(lines["doc"]), "version": pa.array(lines["token"].view(np.int64)), "line": pa.array(lines["line"]), "first": pa.array(lines["first"])}
    n = len(next(iter(given.values())))
    return pa.table({c: given[c] if c in given else pa.nulls(n, kind) for c, kind in kinds.items()})


MET_COLUMNS = PAIR_COLUMNS + "".join(f", e_{c} binary" for c in ENTRY) + ", key long, doc long, version long, line int, first boolean"


def meet_lines(texts: DataFrame, codes: bytes, n_bytes: int, threshold: float, most: int = 1, wanted: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs of candidates, lines: key, doc, version, line and whether it is the first of its set).

    A word's group has no more lines than the word's count. Words that are in more lines than one
    task should meet are dealt apart by key; what is left of equal sets is counted, and slices meet in pairs.
    wanted: filters of bits of words and of keys; only such words are dealt and only lines of such keys get pairs; no lines.
    """
    spark = texts.sparkSession
    words, laters = wanted or (None, None)
    shared = spark.sparkContext.broadcast((codes, words, laters))
    buckets = max(32, n_bytes // 3_000_000)
    slice_rows = 32_768

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, only = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        for batch in batches_of_text(batches, most_bytes=PART_BYTES):
            s = line_sets(batch.column("text").to_pylist())
            e = _entries(s, batch.column("doc").to_numpy(), table, threshold)
            if only is not None:
                hit = _has_bit(e["token"], *only)
                e = {c: x[hit] for c, x in e.items()}
            bucket = (e["token"] % np.uint64(buckets)).astype(np.int32)
            common = e["code"] >= COMMON_CODE
            parts = np.exp2((e["code"].astype(float) - 16) / 8 + 4 - 14)  # the count in units of 16,384
            slices = np.maximum(1, np.ceil(parts)).astype(np.uint64)
            lo = np.where(common, (e["key"] % slices).astype(np.int64), -1).astype(np.int32)
            yield _blocks(e, bucket, lo, np.full(len(bucket), -1, np.int32))
            if only is None:
                text = np.searchsorted(s.first, s.line, "right") - 1
                doc, version = batch.column("doc").to_numpy()[text], batch.column("version").to_numpy()[text]
                place = (s.line - s.first[text]).astype(np.int32)
                order = np.lexsort((place, version, doc, s.more, s.key))
                first = _changes(order, s.key, s.more)
                # what repeats an earlier line of the batch is known to go, and not dealt by its key, which may be in very many lines
                for rows, lo, spread in ((order[first], -2, s.key), (order[~first], -3, mixed(doc.view(np.uint64)))):
                    none = np.zeros(len(rows), np.int32)
                    f = {"token": version[rows].view(np.uint64), "key": s.key[rows], "doc": doc[rows], "line": place[rows], "size": none, "place": none, "sketch": s.more[rows], "sketch2": np.zeros(len(rows), np.uint64)}
                    yield _blocks(f, (spread[rows] % np.uint64(buckets)).astype(np.int32), none + lo, none - 1)

    def meet(table: pa.Table) -> pa.Table:
        """Pairs of a bucket of rare words; lines with whether they are the first of their set; the distinct entries of common words as a block."""
        e, lo = _read(table), table.column("lo")[0].as_py()
        if lo <= -2:
            order = np.lexsort((e["line"], e["token"].view(np.int64), e["doc"], e["sketch"], e["key"]))
            first = _changes(order, e["key"], e["sketch"]) if lo == -2 else np.zeros(len(order), bool)
            return _met_table(lines={c: e[c][order] for c in ("token", "key", "doc", "line")} | {"first": first})
        e = _distinct(e)
        return _met_table(entries=e) if lo >= 0 else _met_table(_pair_table(_candidates(e, None, threshold, most, shared.value[2])))

    dealt = texts.mapInArrow(deal, BLOCK)
    met = stored(dealt.groupBy("bucket", "lo").applyInArrow(meet, MET_COLUMNS), "met")
    pairs = met.where("later is not null").select(*PAIR)
    crowd = met.where("e_key is not null").select(*(F.col(f"e_{c}").alias(c) for c in ENTRY))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("token"):
                token, n = np.unique(np.frombuffer(x.as_py(), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n, pa.int64())], ["token", "n"])

    # of all words only those with over slice_rows lines left: fewer than lines / slice_rows
    large = crowd.select("token").mapInArrow(sizes, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > slice_rows).collect()
    n_slices = {r.token: -(-r.n // slice_rows) for r in large}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _read(pa.Table.from_batches([batch]))
            n = np.array([n_slices.get(int(t), 1) for t in e["token"].view(np.int64)], np.int64)
            own = (e["key"] % n.astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lo, hi = np.minimum(own[row], other), np.maximum(own[row], other)
            copies = {c: e[c][row] for c in ENTRY}
            yield _blocks(copies, (copies["token"] % np.uint64(buckets)).astype(np.int32), lo.astype(np.int32), hi.astype(np.int32))

    def meet_slices(table: pa.Table) -> pa.Table:
        e, lo, hi = _read(table), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        n = np.array([n_slices.get(int(t), 1) for t in e["token"].view(np.int64)], np.uint64)
        return _pair_table(_candidates(e, None if lo == hi else e["key"] % n, threshold, most, shared.value[2]))

    sliced = crowd.mapInArrow(spread, BLOCK).groupBy("bucket", "lo", "hi").applyInArrow(meet_slices, PAIR_COLUMNS)
    return pairs.union(sliced), met.where("doc is not null").select("key", "doc", "version", "line", "first")


def _has_bit(values: np.ndarray, table: bytes, size: int) -> np.ndarray:
    place = mixed(values) % np.uint64(size)
    bits = np.frombuffer(table, np.uint8)[(place >> np.uint64(3)).astype(np.int64)]
    return ((bits >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)


def _bit_filter(values: DataFrame) -> tuple[bytes, int]:
    """A filter that has a bit for each value (column v), and so passes all of them and few others; at most 8 MB."""
    size = 1 << min(26, max(16, (values.count() * 16).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = mixed(batch.column("v").to_numpy().view(np.uint64)) % np.uint64(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(place).astype(np.int64))], ["bit"])

    parts = values.mapInArrow(bits, "bit long").groupBy((F.col("bit") / 65_536).cast("int").alias("part")).agg(F.collect_set((F.col("bit") % 65_536).cast("int")).alias("bits"))
    wanted = np.zeros(size, bool)
    for r in parts.toLocalIterator():
        wanted[r.part * 65_536 + np.array(r.bits)] = True
    return np.packbits(wanted).tobytes(), size


def _position(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mixed(doc.astype(np.int64).view(np.uint64)) ^ line.astype(np.uint64)


def sets_at(texts: DataFrame, positions: DataFrame) -> DataFrame:
    """key, words: the sets of at least the lines at the given positions (doc, line). Only lines that pass a filter of bits are taken apart."""

    def positioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _position(batch.column("doc").to_numpy(), batch.column("line").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64))], ["v"])

    shared = texts.sparkSession.sparkContext.broadcast(_bit_filter(positions.mapInArrow(positioned, "v long")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches, most_bytes=PART_BYTES):
            parts = coded(batch.column("text").to_pylist())
            joined = b"\n".join(parts) + b"\n"
            ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
            starts = np.concatenate([[0], ends[:-1] + 1])
            first = np.searchsorted(ends, np.cumsum([0, *(len(p) + 1 for p in parts)]))
            text = np.repeat(np.arange(len(parts)), np.diff(first))
            hit = np.flatnonzero(_has_bit(_position(batch.column("doc").to_numpy()[text], np.arange(len(ends)) - first[text]), *shared.value))
            s = line_sets([joined[a:b] for a, b in zip(starts[hit], ends[hit], strict=True)])
            offsets = pa.array(np.append(s.start, len(s.hash)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(s.key.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(s.hash.view(np.int64)))], ["key", "words"])

    return texts.select("doc", "text").mapInArrow(sets, "key long, words array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (later, earlier) whose whole sets are similar enough."""
    a = sets.select(F.col("key").alias("later"), F.col("words").alias("a"))
    b = sets.select(F.col("key").alias("earlier"), F.col("words").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    similar = common >= F.lit(threshold) * (F.size("a") + F.size("b") - common) - 1e-9
    return pairs.join(a, "later").join(b, "earlier").where(similar).select("later", "earlier").distinct()


def gone_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc, version, gone: the places of the lines of a text that go; texts that lose none are not listed."""
    texts = _order_id(docs)
    told = stored(texts.select("text").mapInArrow(_cells, "shard int, cells binary, counts binary, n_bytes long"), "cells")
    n_bytes = told.agg(F.sum("n_bytes")).first()[0] or 0
    found = told.groupBy("shard").applyInArrow(_rarity_codes, "shard int, codes binary").toArrow()
    width = 1 << (CELL_BITS - SHARD_BITS)
    by_shard = dict(zip(found.column("shard").to_pylist(), found.column("codes").to_pylist(), strict=True))
    codes = b"".join(by_shard.get(k, bytes(width)) for k in range(1 << SHARD_BITS))  # one byte a cell

    met, lines = meet_lines(texts, codes, n_bytes, threshold)
    removed, most, wanted = None, 1, None
    while True:
        pairs = stored(met if removed is None else met.join(wanted, "later", "left_semi"), "candidates")
        later = pairs.select(F.col("later_doc").alias("doc"), F.col("later_line").alias("line"))
        earlier = pairs.select(F.col("earlier_doc").alias("doc"), F.col("earlier_line").alias("line"))
        sets = stored(sets_at(texts, later.union(earlier).distinct()), "sets")
        # the closest candidate of each line first, then the others of the lines that it doesn't remove
        tries = pairs.where("rank = 0")
        nearest = F.min(F.struct("distance", "earlier_doc", "earlier_line", "earlier"))["earlier"].alias("earlier")
        at_first = stored(verified(tries.groupBy("later").agg(nearest), sets, threshold).select("later").distinct(), "matches")
        rest = tries.join(at_first, "later", "left_anti").select("later", "earlier").distinct()
        matched = at_first.union(verified(rest, sets, threshold).select("later").distinct())
        removed = stored(matched if removed is None else matched.union(removed), "removed")
        wanted = stored(pairs.where("rank < 0").select("later").distinct().join(removed, "later", "left_anti"), "open")
        if wanted.isEmpty():
            break
        words = sets.join(wanted.withColumnRenamed("later", "key"), "key", "left_semi").select(F.explode("words").alias("v"))
        most *= 256  # few lines are left, so nearly all their candidates may come
        met, _ = meet_lines(texts, codes, n_bytes, threshold, most, (_bit_filter(words.distinct()), _bit_filter(wanted.select(F.col("later").alias("v")))))
    similar = lines.where("first").join(removed.select(F.col("later").alias("key")).distinct(), "key", "left_semi")
    gone = lines.where("not first").union(similar.select(lines.columns))
    return stored(gone.groupBy("doc", "version").agg(F.collect_set("line").alias("gone")), "gone")


def text_without(text: Column, lines: Column, gone: Column) -> Column:
    """text without the lines at some places; null stays null. lines must be a column of its own, as it is read at each place."""
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(F.size(gone) == 0, text).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))


def line_decisions(docs: DataFrame, threshold: float = 0.8, name: str = "gone") -> DataFrame:
    """docs with a column (of that name, which it replaces): the places (from 0) of the lines that go.

    docs has doc_id and text; all other columns stay. A line goes if an earlier line, by doc_id and place,
    has a Jaccard similarity of words of at least the threshold, whether that one stays or not. Lines without words stay. Null ids come
    last; rows of one id are versions in the order of a hash of their texts, and repeated rows (same id and text) are
    one document, so that all lose the same lines. Null and empty texts lose nothing.
    """
    gone = gone_lines(docs, threshold).select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("gone").alias("__gone"))
    keyed = docs.drop(name).withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__version", F.xxhash64("text"))
    # hashing the short lists spares the sort of whole texts
    joined = keyed.join(gone.hint("shuffle_hash"), ["__doc", "__version"], "left")
    return joined.withColumn(name, F.coalesce("__gone", F.array().cast("array<int>"))).drop("__doc", "__version", "__gone")


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs whose texts have lost the lines that match an earlier line; n_chars, where present, follows; a text that lost every line with words goes as a row.

    All other columns stay as they are. Lines go as in line_decisions().
    """
    found = line_decisions(docs, threshold, "__places").withColumn("__lines", F.split("text", "\n", -1))
    found = found.withColumn("__text", text_without(F.col("text"), F.col("__lines"), F.col("__places")))
    lost = F.size("__places") > 0
    out = found.where(~lost | F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__text")).select(*docs.columns)
