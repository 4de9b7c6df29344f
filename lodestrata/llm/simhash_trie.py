"""SimHash near-dedup: fingerprints linked by a self-join of binary tries over them.

The join follows pairs of trie nodes of one depth together: the children of a pair are paired with
each other, a pair on different branches spends one bit of the Hamming budget, and a pair that has
overspent is dropped. To keep the upper levels of a huge trie from being paired at all, the bits are
cut into budget + 2 segments: two fingerprints within the budget agree on two whole segments at
least, so in one of the tries that read these two first they share the upper half. There the budget
is zero, each node is paired with itself alone, and every trie holds every fingerprint once.
The traversal runs on sorted arrays, in which a node is a range.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import small_enough, stored
from lodestrata.llm.components import components

#: Fixed seed of the query contract.
SEED = 42
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64 bits of a text that are set in over half of its shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest, n = xxhash.xxh64_digest, max(1, len(words) - shingle + 1)
    sums = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        upto = min(n, at + 65_536)
        hashes = b"".join([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, upto)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        # sums of up to 255 rows fit a byte each, which is far faster than widening every bit
        whole = len(bits) // 255 * 255
        if whole:
            sums += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        sums += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(prints)], [*others, "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a long, for each row of docs."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fingerprint long")


def linked(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of prints at most `budget` bits apart in the same node; nodes are the ranges [lo, hi) at `depth` of the sorted prints.

    Each pair of a node comes once.
    """
    stack = [(depth, lo, hi, lo, hi, np.full(len(lo), budget), np.ones(len(lo), bool))]
    while stack:
        level, la, ha, lb, hb, left, twin = stack.pop()
        if len(la) > 500_000:  # one half waits, so that a level of many pairs stays small
            half = len(la) // 2
            stack += [(level, *(x[:half] for x in (la, ha, lb, hb, left, twin))), (level, *(x[half:] for x in (la, ha, lb, hb, left, twin)))]
            continue
        few = ((ha - la) * (hb - lb) <= 16) | (level == 64)
        if few.any():
            na, nb = (ha - la)[few], (hb - lb)[few]
            total = na * nb
            pair = np.repeat(np.arange(len(total)), total)
            at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            i, j = la[few][pair] + at // nb[pair], lb[few][pair] + at % nb[pair]
            near = (np.bitwise_count(prints[i] ^ prints[j]) <= budget) & (~twin[few][pair] | (i < j))
            if near.any():
                yield i[near], j[near]
            la, ha, lb, hb, left, twin = (x[~few] for x in (la, ha, lb, hb, left, twin))
        if not len(la):
            continue
        zeros = np.concatenate([[0], np.cumsum(((prints >> np.uint64(63 - level)) & ONE) == 0)])
        ma, mb = la + zeros[ha] - zeros[la], lb + zeros[hb] - zeros[lb]
        apart, cross = left > 0, ~twin
        parts = [
            (la, ma, lb, mb, left, twin), (ma, ha, mb, hb, left, twin),
            tuple(x[apart] for x in (la, ma, mb, hb, left - 1, np.zeros(len(twin), bool))),
            tuple(x[apart & cross] for x in (ma, ha, lb, mb, left - 1, np.zeros(len(twin), bool))),
        ]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        alive = (joined[1] > joined[0]) & (joined[3] > joined[2])
        if alive.any():
            stack.append((level + 1, *(x[alive] for x in joined)))


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For each of n nodes the smallest node of its component."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            ri, rj = root[i], root[j]
            if (ri == rj).all():
                break
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (deeper := root[root] != root).any():
                root[deeper] = root[root[deeper]]
    return root


def _node_links(depth: int, budget: int, least: int = 65_536):
    """Links within the nodes at `depth` of tries, whose rows come sorted by trie and bits; a spanning forest of each part of the stream."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def whole(last: bool) -> pa.RecordBatch:
            """The links of what is held, but for the last node if more of it may come; that stays held."""
            trie, bits, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            node = bits >> np.uint64(64 - depth)
            start = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (trie[1:] != trie[:-1])]))
            end = np.append(start[1:], len(bits))
            upto = len(start) - (not last)
            held[:] = [] if last else [(trie[start[-1] :], bits[start[-1] :], ids[start[-1] :])]
            pick = np.flatnonzero(end[:upto] - start[:upto] > 1)
            root = forest(linked(bits, start[pick], end[pick], depth, budget), len(bits))
            of = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(ids[root[of]])], ["a", "b"])

        for batch in batches:
            held.append((batch.column("trie").to_numpy(), batch.column("bits").to_numpy().view(np.uint64), batch.column("id").to_numpy()))
            if sum(len(x[0]) for x in held) >= least:
                yield whole(False)
        if held:
            yield whole(True)

    return links


def _reordered(bits: Column, upto: int, parts: int) -> list[tuple[Column, int]]:
    """For each two of the segments into which the bits after `upto` are cut: bits with these two moved ahead, and how many bits are then fixed."""
    edges = [upto + (64 - upto) * k // parts for k in range(parts + 1)]
    segments = list(zip(edges, edges[1:], strict=False))
    out = []
    for two in combinations(range(parts), 2):
        order = [segments[k] for k in two] + [x for k, x in enumerate(segments) if k not in two]
        moved, at = bits.bitwiseAND(F.lit(-1 << (64 - upto) if upto else 0).cast("long")), upto
        for lo, hi in order:
            part = F.shiftrightunsigned(bits, 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
            at += hi - lo
            moved = moved.bitwiseOR(F.shiftleft(part, 64 - at))
        out.append((moved, upto + sum(hi - lo for lo, hi in order[:2])))
    return out


def _in_tries(rows: DataFrame, upto: int, budget: int) -> tuple[DataFrame, int]:
    """rows (trie, bits, id) dealt to the tries of the next two segments, and the depth to which the budget is zero in all of them."""
    orders = _reordered(F.col("bits"), upto, budget + 2)
    depth = min(fixed for _, fixed in orders)
    tries = F.array(*(F.struct((F.col("trie") * len(orders) + k).cast("int").alias("trie"), moved.alias("bits")) for k, (moved, _) in enumerate(orders)))
    return rows.select(F.explode(tries).alias("t"), "id").select("t.trie", "t.bits", "id"), depth


def trie_links(prints: DataFrame, budget: int = 2, most_rows: int = 65_536) -> DataFrame:
    """Distinct fingerprints (fingerprint, id) to links (a, b) between ids whose components are those of all pairs within budget.

    Each task gives spanning forests of the links it finds, so a cluster gives no more links than
    it has members in the tries. A fingerprint is in six tries (at a budget of 2), whatever the
    number of rows. A node of over most_rows fingerprints at half depth is dealt once more, by the
    remaining bits, to six tries in which three quarters of the bits are fixed, so that no node has over 65,536.
    """
    tried, depth = _in_tries(prints.select(F.lit(0).alias("trie"), F.col("fingerprint").alias("bits"), "id"), 0, budget)
    node = F.shiftrightunsigned("bits", 64 - depth).alias("node")
    kinds = "a long, b long"

    def links(rows: DataFrame, depth: int) -> DataFrame:
        dealt = rows.repartition("trie", F.shiftrightunsigned("bits", 64 - depth)).sortWithinPartitions("trie", "bits")
        return dealt.select("trie", "bits", "id").mapInArrow(_node_links(depth, budget), kinds)

    if prints.count() <= most_rows:  # no node can have more
        return links(tried, depth)
    crowded = stored(tried.groupBy("trie", node).count().where(F.col("count") > most_rows).select("trie", "node"), "crowded")
    crowded = small_enough(crowded, 100_000)
    tried = tried.withColumn("node", node)
    again, deeper = _in_tries(tried.join(crowded, ["trie", "node"], "left_semi").select("trie", "bits", "id"), depth, budget)
    return links(tried.join(crowded, ["trie", "node"], "left_anti"), depth).union(links(again, deeper))


def simhash_components(docs: DataFrame, budget: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (long), component_id.

    docs has doc_id and text; other columns are ignored. Documents whose fingerprints differ in at most `budget` bits are
    linked, and component_id is the smallest doc_id that can be reached. Null, empty and blank
    texts have fingerprint 0, which is linked like any other. Repeated rows and copies share a
    fingerprint and so a component; a row with a null doc_id keeps a null doc_id and links nothing
    but takes the component of its fingerprint. No rows give no rows.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "distinct")
    found = components(trie_links(distinct.where("id is not null"), budget)).withColumnRenamed("node", "id")
    classes = distinct.join(found, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_dedup(docs: DataFrame, budget: int = 2) -> DataFrame:
    """docs without the near-copies: of each component the text with the smallest (doc_id, hash of the text) stays.

    Different texts of one doc_id are apart: each goes or stays with its own component. Of rows that repeat both, one stays, the same on each
    run (maps don't count in that choice); rows with a null doc_id, which name no document, all stay. All columns stay.
    """
    keyed = docs.where("doc_id is not null").withColumn("text_hash_", F.xxhash64("text"))
    prints = keyed.select(F.col("doc_id").cast("long"), "text_hash_", "text").mapInArrow(_fingerprints, "doc_id long, text_hash_ long, fingerprint long")
    prints = stored(prints, "fingerprints")
    # fingerprints are their own ids here, as one doc_id may have several
    found = components(trie_links(stored(prints.select("fingerprint", F.col("fingerprint").alias("id")).distinct(), "distinct"), budget))
    placed = prints.join(found, F.col("fingerprint") == F.col("node"), "left")
    kept = placed.groupBy(F.coalesce("component", "fingerprint")).agg(F.min(F.struct("doc_id", "text_hash_")).alias("first")).select("first.*").distinct()
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = keyed.join(kept, ["doc_id", "text_hash_"], "left_semi").groupBy("doc_id", "text_hash_").agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("row")
    )
    return one.select("row.*").union(docs.where("doc_id is null"))


def hex_print(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
