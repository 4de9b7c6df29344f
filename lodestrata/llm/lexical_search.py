"""Ranked lexical search by the three-phase uniform threshold method over term-partitioned postings.

The postings of query terms are lists by term, cut into blocks whose entries are sorted by score, so that a
frequent term's list is many rows of bounded size. Phase one fetches the heads of the lists: of each query the sums of what its heads hold give a
lower bound of its k-th score. Phase two fetches from each list all entries of at least that bound divided by the
query's number of lists: a document without any such entry can't reach the bound. What is fetched meets by
slices of documents, each entry once for all queries, and is summed there. Phase three looks up the
exact scores of those candidates whose upper bound still reaches the raised lower bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import small_enough, stored
from lodestrata.llm.words import NOT_ALNUM, batches_of_text, words_of

#: Tables of query terms up to this many rows, and numbers of candidate documents up to the other, are broadcast; larger ones are shuffled.
MAX_BROADCAST_ROWS, MAX_BROADCAST_CANDIDATES = 200_000, 1_000_000
#: Hashes of query terms up to this number go to the tasks that read documents; with more, all terms are posted and joined with the queries' after that.
MAX_TERMS_IN_TASKS = 1_000_000
#: Queries go to the tasks of phase two in parts of about this many lists.
MAX_PAIRS_IN_TASKS = 500_000


def _counted(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, term (64-bit hash) and count of each term of each text, by text, and the number of terms of each text."""
    w = words_of(texts, between=NOT_ALNUM)
    size = np.diff(w.text)
    text = np.repeat(np.arange(len(size), dtype=np.int64), size)
    found, of = np.unique(w.hash, return_inverse=True)
    pair, tf = np.unique(text * max(1, len(found)) + of.reshape(-1), return_counts=True)
    return pair // max(1, len(found)), found[pair % max(1, len(found))].view(np.int64) if len(found) else np.empty(0, np.int64), tf, size


def query_terms(items: DataFrame) -> DataFrame:
    """query (a number of each row of items), item_id, term, qf: the terms of each item and how often it has them."""
    kind = items.schema["item_id"].dataType.simpleString()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches):
            text, term, qf, _ = _counted(batch.column("text").to_pylist())
            columns = [batch.column(c).take(pa.array(text)) for c in ("query", "item_id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(term), pa.array(qf.astype(np.int64))], ["query", "item_id", "term", "qf"])

    return items.select(F.monotonically_increasing_id().alias("query"), "item_id", "text").mapInArrow(terms, f"query long, item_id {kind}, term long, qf long")


def _bounds(of: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else np.array([0])


def posted(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """Blocks of postings: term, slice, rows, ids (doc_id), tf, n (terms of the document), and blocks without a term that count documents and their terms.

    wanted: the sorted hashes of the terms to post; None for all. A block holds the documents of one slice of a batch, named by its first row.
    """
    kind = docs.schema["doc_id"].dataType

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_text(batches):
            text, term, tf, size = _counted(batch.column("text").to_pylist())
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, term), max(0, len(wanted) - 1))
                keep = wanted[at] == term if len(wanted) else np.zeros(len(term), bool)
                text, term, tf = text[keep], term[keep], tf[keep]
            order = np.argsort(term, kind="stable")
            text, term, tf = text[order], term[order], tf[order]
            bounds = _bounds(term)
            place = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(place, batch.column(c).take(pa.array(text))) for c in ("row", "doc_id")]
            lists += [pa.ListArray.from_arrays(place, pa.array(x.astype(np.int64))) for x in (tf, size[text])]
            none = pa.nulls(len(bounds) - 1, pa.int64())
            own = pa.array(np.full(len(bounds) - 1, batch.column("row")[0].as_py() if len(batch) else 0))
            names = ["term", "slice", "rows", "ids", "tf", "n", "n_docs", "n_terms"]
            yield pa.RecordBatch.from_arrays([pa.array(term[bounds[:-1]]), own, *lists, none, none], names)
            empty = [pa.nulls(1, x.type) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *empty, pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])], names)

    shape = f"term long, slice long, rows array<long>, ids array<{kind.simpleString()}>, tf array<long>, n array<long>, n_docs long, n_terms long"
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(post, shape)


def by_impact(blocks: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks with the column weight to (term, slice, best, rows, ids, scores), each sorted from the highest score on, ties to the smaller row.

    The score of an entry is weight * ((1000000000 * tf) div (1000 * tf + 8 * m)), with m = 25 + (75 * n * n_docs) div n_terms.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("rows").value_lengths().to_numpy()
            flat = {c: batch.column(c).flatten() for c in ("rows", "ids", "tf", "n")}
            rows, tf, n = (flat[c].to_numpy() for c in ("rows", "tf", "n"))
            m = 25 + (75 * n * n_docs) // max(1, n_terms)
            scores = np.repeat(batch.column("weight").to_numpy(), size) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            order = np.lexsort((rows, -scores, np.repeat(np.arange(len(size)), size)))
            place = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(place), x) for x in (pa.array(rows[order]), flat["ids"].take(pa.array(order)), pa.array(scores[order]))]
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("slice"), pa.array(scores[order][place[:-1]] if len(size) else scores), *lists], ["term", "slice", "best", "rows", "ids", "scores"])

    kind = blocks.schema["ids"].dataType.simpleString()
    return blocks.select("term", "slice", "weight", "rows", "ids", "tf", "n").mapInArrow(score, f"term long, slice long, best long, rows array<long>, ids {kind}, scores array<long>")


def build_lists(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The scored lists of the queries' terms over docs (doc_id, text), range-partitioned by term and block, in the shared folder."""
    spark: SparkSession = docs.sparkSession
    vocabulary = stored(queries.select("term").distinct(), "query-terms")
    bounded = vocabulary.limit(MAX_TERMS_IN_TASKS + 1).count() <= MAX_TERMS_IN_TASKS
    wanted = np.sort(vocabulary.toArrow().column("term").to_numpy()) if bounded else None
    raw = stored(posted(docs, wanted), "postings")
    totals = raw.where("term is null").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    n_docs, n_terms = totals.n_docs or 0, totals.n_terms or 0
    blocks = raw.where("term is not null")
    if not bounded:
        blocks = blocks.join(vocabulary, "term", "left_semi")
    df = blocks.groupBy("term").agg(F.sum(F.size("rows")).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1))).alias("weight")
    weights = small_enough(stored(df.select("term", weight), "weights"), MAX_BROADCAST_ROWS)
    dealt = blocks.join(weights, "term").repartitionByRange("term", "slice")
    return stored(by_impact(dealt, n_docs, n_terms).where("best > 0"), "lists")


def _entries(lists: DataFrame, *extra: str) -> DataFrame:
    """The entries of blocks: term, row, doc_id, score and the extra columns."""
    zipped = F.arrays_zip(F.col("rows").alias("row"), F.col("ids").alias("doc_id"), F.col("scores").alias("score"))
    return lists.select("term", *extra, F.inline(zipped))


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """query, and its k-th highest sum; queries with fewer rows are left out."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sum")))
    return sums.select("query", "sum", place.alias("place")).where(F.col("place") <= k).where(F.col("place") == k).select("query", F.col("sum").alias(name))


def _summed(score: Column, *more: Column):
    return F.sum(F.col("qf") * score).alias("sum"), *more


def fetched_sums(lists: DataFrame, cuts: DataFrame, k: int) -> DataFrame:
    """query, row, sum, upper: what the entries of lists from each query's thresholds on sum to, and the most that a document's score can be.

    cuts: query, term, qf, bound, cut, rest. Entries meet by slices of documents; of each slice the documents stay whose upper bound reaches
    the query's bound and the slice's own k-th sum. The thresholds go to the driver: the caller bounds their number.
    """
    asked = cuts.select("query", "term", "qf", "bound", "cut", "rest").orderBy("query", "term").toArrow()
    query, term, qf, bound, cut, rest = (asked.column(c).to_numpy() for c in ("query", "term", "qf", "bound", "cut", "rest"))
    own = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1, [len(query)]]) if len(query) else np.zeros(1, int)

    def add(group: pa.Table) -> pa.Table:
        size = group.column("rows").combine_chunks().value_lengths().to_numpy()
        rows, scores = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("rows", "scores"))
        known, at = np.unique(rows, return_inverse=True)
        ends = np.cumsum(size)
        block = {t: (e - n, e) for t, e, n in zip(group.column("term").to_pylist(), ends.tolist(), size.tolist(), strict=True)}
        out = []
        for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
            sums, seen = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            for p in range(a, b):
                if (place := block.get(int(term[p]))) is not None:
                    mine = scores[place[0] : place[1]]
                    n = int(np.searchsorted(-mine, -cut[p], "right"))
                    here = at[place[0] : place[0] + n]  # a document is once in a block
                    sums[here] += qf[p] * mine[:n]
                    seen[here] += rest[p]
            some = np.flatnonzero(sums)
            if len(some):
                upper = sums[some] + (rest[a:b].sum() - seen[some])
                least = max(bound[a], np.partition(sums[some], -k)[-k] if len(some) >= k else 0)
                left = upper >= least
                out.append((np.full(left.sum(), query[a]), known[some[left]], sums[some[left]], upper[left]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("query", "row", "sum", "upper"), columns, strict=True)))

    least = small_enough(cuts.groupBy("term").agg(F.min("cut").alias("least")), MAX_BROADCAST_ROWS)
    n = F.size(F.filter("scores", lambda s: s >= F.col("least")))
    reached = lists.join(least, "term").where("best >= least").select("term", "slice", F.slice("rows", F.lit(1), n).alias("rows"), F.slice("scores", F.lit(1), n).alias("scores"))
    return stored(reached.groupBy("slice").applyInArrow(add, "query long, row long, sum long, upper long"), "sums")


def search(docs: DataFrame, items: DataFrame, k: int = 10, slack: int = 4) -> DataFrame:
    """The k highest-scoring documents of each item.

    docs has doc_id and text, items has item_id and text; other columns are ignored. Terms are maximal runs of ASCII letters, digits and characters beyond
    ASCII, A-Z in lower case, told by 64-bit hashes; null and empty texts have none. Scores are as in by_impact(), with
    weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a term that an item repeats counts as often. Returns item_id, rank (from 1), doc_id, score, of scores above 0:
    ties go to the smaller doc_id (null first), then to the row read first. Each row of docs is a document and each row of items an item, so
    repeated rows have results of their own; items without terms or matches have none. Lists are fetched down to bound / (slack * m): 1 fetches least;
    more narrows what entries that are not fetched can add, and so the candidates. Results are the same.
    """
    asked = stored(query_terms(items), "asked")
    lists = build_lists(docs, asked)
    best = lists.groupBy("term").agg(F.max("best").alias("best"))
    pairs = stored(asked.join(best, "term"), "query-lists")

    # phase one: the heads of the lists. A block's first k entries hold all of it that can be in its list's head
    heads = _entries(lists.select("term", *(F.slice(c, 1, k).alias(c) for c in ("rows", "ids", "scores"))))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "row"))
    heads = heads.withColumn("place", place).where(F.col("place") <= k).select("term", "row", "score")
    seen = heads.join(small_enough(pairs, MAX_BROADCAST_ROWS), "term").groupBy("query", "row").agg(*_summed(F.col("score")))
    first = _kth(seen, k, "bound")

    # phase two: a document that reaches a query's bound has an entry of at least bound / m in one of its m lists
    m = pairs.groupBy("query").agg(F.count("*").alias("m"))
    limits = m.join(first, "query", "left").select("query", "m", F.coalesce("bound", F.lit(0)).alias("bound"))
    cut = F.expr(f"(bound + {int(slack)} * m * qf - 1) div ({int(slack)} * m * qf)")
    cuts = pairs.join(limits, "query").withColumn("cut", F.greatest(cut, F.lit(1)))
    # what an entry that is not fetched can add at most
    cuts = stored(cuts.withColumn("rest", F.col("qf") * F.least(F.col("best"), F.col("cut") - 1)), "thresholds")
    parts, sums = max(1, -(-cuts.count() // MAX_PAIRS_IN_TASKS)), None
    for part in range(parts):
        of_part = cuts.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part)
        found = fetched_sums(lists, of_part, k)
        sums = found if sums is None else sums.unionByName(found)
    second = _kth(sums, k, "raised")
    left = sums.join(small_enough(limits.join(second, "query", "left"), MAX_BROADCAST_ROWS), "query")
    candidates = stored(left.where(F.col("upper") >= F.greatest("bound", F.coalesce("raised", F.lit(0)))).select("query", "row"), "candidates")

    # phase three: exact scores of the candidates from all lists
    rows = small_enough(candidates.select("row").distinct(), MAX_BROADCAST_CANDIDATES)
    wanted = candidates.join(small_enough(pairs.select("query", "item_id", "term", "qf"), MAX_BROADCAST_ROWS), "query")
    exact = _entries(lists).join(rows, "row", "left_semi").join(wanted, ["term", "row"])
    scored = exact.groupBy("query", "row").agg(*_summed(F.col("score"), F.first("item_id").alias("item_id"), F.first("doc_id").alias("doc_id")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sum"), "doc_id", "row")).cast("int")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", F.col("sum").alias("score"))


SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT q, item_id, term, count(*) AS qf FROM b GROUP BY ALL),
t AS (SELECT count(*) AS nd, sum(len(ws))::BIGINT AS nt FROM d WHERE len(ws) > 0),
p AS (SELECT r, doc_id, len(ws)::BIGINT AS n, term, count(*) AS tf FROM (SELECT r, doc_id, ws, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, t GROUP BY term, nd),
s AS (
  SELECT q, item_id, r, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score
  FROM qt JOIN p USING (term) JOIN w USING (term), t GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r) AS k FROM s WHERE score > 0) WHERE k <= 10
"""
