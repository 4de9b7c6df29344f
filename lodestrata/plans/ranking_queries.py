"""Queries of re-ranking, earlier neighbours, anchored texts, intervals and pages, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import cleanup as C
from lodestrata.functions import text as T
from lodestrata.operators import lists as L
from lodestrata.operators import retrieval as R
from lodestrata.session import table

_D = "CAST({} AS DOUBLE[])"


def earlier_neighbours(spark, sf_dir):
    """For each vector whose number 50 divides the ten first others of its twenty nearest that are no later; a vector's time is that of the event of its number."""
    at = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(at, "vec_id")
    return R.earlier_neighbours(v, v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "at"))


def _cosine(a, b):
    a, b = _D.format(a), _D.format(b)
    return f"round(list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 1e-12::DOUBLE), 6)::DOUBLE"


EARLIER = f"""
WITH v AS (SELECT vec_id, embedding, ts FROM embeddings JOIN events ON event_id = vec_id),
n AS (SELECT q.vec_id AS query_id, v.vec_id, {_cosine('q.embedding', 'v.embedding')} AS score FROM v AS q JOIN v ON v.ts <= q.ts WHERE q.vec_id % 50 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 20)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM n WHERE query_id <> vec_id QUALIFY rank <= 10"""


def cosine_rerank_padded(spark, sf_dir):
    """Each label's vectors, with the language of the document of their number as level, re-ranked for the label's first vector; those that seven divides have no vector, and in label 0 none has one.

    Of every label as many places are asked for as some have vectors, so that padding is met.
    """
    v = table(spark, sf_dir, "embeddings").withColumn("query_id", F.col("label").cast("long"))
    asked = v.groupBy("query_id").agg(F.min_by("embedding", "vec_id").alias("query"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("level"))
    vector = F.when((F.col("vec_id") % 7 != 0) & (F.col("label") != 0), F.col("embedding"))
    relativity = F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") / 1000)
    rows = v.join(d, "vec_id", "left").select("query_id", F.col("vec_id").alias("id"), F.col("vec_id").alias("place"), vector.alias("vector"), "level", relativity.alias("relativity"))
    return R.weighted_rerank(rows, asked, 48, {"en": 1.2, "de": 1.1, "fr": 0.8})


PADDED = f"""
WITH a AS (SELECT label, min_by(embedding, vec_id) AS q FROM embeddings GROUP BY label),
c AS (SELECT e.label, vec_id, vec_id % 7 <> 0 AND e.label <> 0 AS has, CASE WHEN vec_id % 3 = 0 THEN vec_id / 1000 END AS relativity, {_cosine('embedding', 'q')} AS s,
  CASE lang WHEN 'en' THEN 1.2 WHEN 'de' THEN 1.1 WHEN 'fr' THEN 0.8 ELSE 1.0 END::DOUBLE AS w, embedding, q FROM embeddings AS e JOIN a ON a.label = e.label LEFT JOIN documents ON doc_id = vec_id),
m AS (SELECT *, round({_cosine('embedding', 'q').replace('round(', '(').replace(', 6)', ')')} * w, 6)::DOUBLE AS near, bool_or(has) OVER (PARTITION BY label) AS found FROM c),
s AS (SELECT label, vec_id, CASE WHEN NOT found THEN coalesce(nullif(relativity, 0), 0.5) WHEN has THEN near ELSE -1 END::DOUBLE AS score, CASE WHEN found AND NOT has THEN 1 ELSE 0 END AS last, CASE WHEN has THEN -near ELSE 0 END AS down FROM m)
SELECT CAST(label AS BIGINT) AS query_id, vec_id AS id, score, row_number() OVER (PARTITION BY label ORDER BY last, down, vec_id) AS rank FROM s QUALIFY rank <= 48"""


def anchored_containment(spark, sf_dir):
    """Documents that hold a benchmark text of up to 128 characters, or an anchor of one, both normalised."""
    items = table(spark, sf_dir, "benchmark").select("item_id", C.matching_form(F.col("text")).alias("text"))
    return R.anchored_matches(items, table(spark, sf_dir, "documents").select("doc_id", C.matching_form(F.col("text")).alias("text")))


_NORMAL = r"""regexp_replace(trim(regexp_replace(translate(translate(text, '‘’“”–—' || chr(160), '''''""-- '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')), ' +([,.;:!?])', '\1', 'g')"""
ANCHORED = f"""
WITH i AS (SELECT item_id, {_NORMAL} AS t FROM benchmark WHERE text IS NOT NULL), d AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
w AS (SELECT item_id, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM i), n AS (SELECT *, len(w) AS n, least(16, greatest(8, len(w) // 4)) AS k FROM w),
a AS (SELECT item_id, t, n, list_transform([0, greatest(0, n // 4 - k // 2), greatest(0, n // 2 - k // 2), greatest(0, 3 * n // 4 - k // 2), greatest(0, n - k)], lambda s: array_to_string(w[s + 1 : s + k], ' ')) AS a FROM n),
f AS (SELECT item_id, t, n, list_filter(a, lambda x: length(x) >= 24) AS a FROM a),
p AS (SELECT item_id, unnest(list_concat(CASE WHEN length(t) <= 128 AND t <> '' THEN [t] ELSE [] END, CASE WHEN n = 0 THEN [] WHEN n <= 16 OR len(a) = 0 THEN [t] ELSE a END)) AS p FROM f)
SELECT DISTINCT item_id, doc_id FROM p JOIN d ON contains(d.t, p.p)"""


def interval_search(spark, sf_dir):
    """Five stated intervals, one a region's: a day, one open at each end, one without ends and one after all events; the eight best events by value in it, or of all events of the region's user where it has none."""
    day = lambda n: F.lit("2024-01-01").cast("timestamp") + F.expr(f"make_interval(0, 0, 0, {n})")
    r = F.col("r_regionkey")
    since = F.when(r == 0, day(2)).when(r == 1, day(25)).when(r == 4, day(400))
    until = F.when(r == 0, day(3)).when(r == 2, day(4)).when(r == 4, day(500))
    asked = table(spark, sf_dir, "region").select(r.cast("long").alias("query_id"), since.alias("since"), until.alias("until"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("score"), F.col("user_id").alias("query_id"))
    return R.in_intervals(asked, e, e, 8)


INTERVALS = """
WITH a AS (SELECT CAST(r_regionkey AS BIGINT) AS q, CASE r_regionkey WHEN 0 THEN TIMESTAMP '2024-01-03' WHEN 1 THEN TIMESTAMP '2024-01-26' WHEN 4 THEN TIMESTAMP '2024-01-01' + INTERVAL 400 DAY END AS s,
  CASE r_regionkey WHEN 0 THEN TIMESTAMP '2024-01-04' WHEN 2 THEN TIMESTAMP '2024-01-05' WHEN 4 THEN TIMESTAMP '2024-01-01' + INTERVAL 500 DAY END AS u FROM region),
i AS (SELECT q, event_id AS id, value AS score, 'events' AS source FROM a JOIN events ON coalesce(ts >= s, true) AND coalesce(ts <= u, true) WHERE s IS NOT NULL OR u IS NOT NULL),
f AS (SELECT * FROM i UNION ALL SELECT q, event_id, value, 'fallback' FROM a JOIN events ON user_id = q WHERE q NOT IN (SELECT q FROM i))
SELECT q AS query_id, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank, source FROM f QUALIFY rank <= 8"""


def keyset_slices(spark, sf_dir):
    """Pages of orders by date and key: the 20 before the dearest order, from the latest on, and the middle 20 between the cheapest and the dearest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    order = ["o_orderdate", "o_orderkey"]
    dear, cheap = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1), o.orderBy("o_totalprice", "o_orderkey").limit(1)
    ends = dear.union(cheap)
    low, high = ends.orderBy(*order).limit(1), ends.orderBy(*(F.desc(c) for c in order)).limit(1)
    middle = L.keyset_slice(o, order, 20, low, high).withColumn("page", F.lit("between"))
    before = L.keyset_slice(o, order, 20, before=dear, ascending=False).withColumn("page", F.lit("before"))
    return before.unionByName(middle).select("page", "o_orderkey", "o_orderdate")


SLICES = """
WITH e AS ((SELECT o_orderdate AS d, o_orderkey AS k, 'dear' AS c FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) UNION ALL (SELECT o_orderdate, o_orderkey, 'cheap' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)),
b AS (SELECT 'before' AS page, o_orderkey, o_orderdate FROM orders, e WHERE c = 'dear' AND (o_orderdate, o_orderkey) < (d, k) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20),
m AS (SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (SELECT (d, k) FROM e ORDER BY d, k LIMIT 1) AND (o_orderdate, o_orderkey) < (SELECT (d, k) FROM e ORDER BY d DESC, k DESC LIMIT 1) ORDER BY o_orderdate, o_orderkey LIMIT 40),
n AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n, count(*) OVER () AS c FROM m)
SELECT * FROM b UNION ALL SELECT 'between', o_orderkey, o_orderdate FROM n WHERE c <= 20 OR (n >= c // 2 - 10 AND n < c // 2 + 10)"""

def bm25_stemmed_topk(spark, sf_dir):
    """The ten best documents of each benchmark item by BM25 over stems."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.ranked(R.bm25_stemmed(table(spark, sf_dir, "documents"), asked), "query_id", "score", "doc_id", 10)


def tiered_retrieval(spark, sf_dir):
    """For each vector whose number 50 divides the ten first pages of its label's sessions, both tiers at 0.1.

    A session is 25 numbers of a label; its summary is its first vector, with the words of the document of that number.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("key"), F.floor(F.col("vec_id") / 25).cast("long").alias("session"), F.col("vec_id").alias("page"), F.col("embedding").alias("vector"))
    first = v.groupBy("key", "session").agg(F.min_by(F.struct("page", "vector"), "page").alias("f")).select("key", "session", F.col("f.page").alias("vec_id"), "f.vector").join(d, "vec_id", "left")
    asked = v.where(F.col("page") % 50 == 0).withColumnRenamed("page", "vec_id").join(d, "vec_id", "left").select(F.col("vec_id").alias("query_id"), "key", F.col("vector").alias("query"), "words")
    return R.tiered_pages(asked, first, v, 0.1, 0.1, 10)


_HELD = "list_distinct(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"
TIERED = f"""
WITH v AS (SELECT CAST(label AS BIGINT) AS key, vec_id // 25 AS session, vec_id AS page, embedding AS x, coalesce({_HELD}, []) AS w FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key, session ORDER BY page) = 1),
m AS (SELECT q.page AS query_id, q.x, s.key, s.session, {_cosine('q.x', 's.x').replace('round(', '(').replace(', 6)', ')')} AS c, len(list_intersect(q.w, s.w)) AS n, len(q.w) AS a, len(s.w) AS b FROM v AS q JOIN s ON s.key = q.key WHERE q.page % 50 = 0),
t AS (SELECT *, round(c + CASE WHEN n > 0 THEN (n / a + n / b) * 0.5 ELSE 0 END, 6)::DOUBLE AS score FROM m),
p AS (SELECT query_id, v.page, v.session, score, {_cosine('t.x', 'v.x')} AS page_score FROM t JOIN v ON v.key = t.key AND v.session = t.session WHERE score >= 0.1)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_score DESC, page) AS rank FROM p WHERE page_score >= 0.1 QUALIFY rank <= 10"""

QUERIES = {
    "earlier_neighbours": (earlier_neighbours, EARLIER), "cosine_rerank_padded": (cosine_rerank_padded, PADDED), "anchored_containment": (anchored_containment, ANCHORED),
    "interval_search": (interval_search, INTERVALS), "keyset_slices": (keyset_slices, SLICES),
    "bm25_stemmed_topk": (bm25_stemmed_topk, None), "tiered_retrieval": (tiered_retrieval, TIERED),
}
