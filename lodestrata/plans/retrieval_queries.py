"""Queries of retrieval, fusion and recall, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import retrieval as R
from lodestrata.plans.text_queries import _STOP, _TOKENS, _WORDS
from lodestrata.session import small, table, written


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark, sf_dir, k=10):
    return R.bm25_topk(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), k)


def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "doc_id", "score", "rank")


_BM25 = f"""
w AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS ws FROM documents),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({_TOKENS.format("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(len(ws)) AS avg_size FROM w),
po AS (SELECT doc_id, term, count(*) AS tf, first(size) AS size FROM (SELECT doc_id, len(ws) AS size, unnest(ws) AS term FROM w) GROUP BY doc_id, term),
pq AS (SELECT * FROM po WHERE term IN (SELECT term FROM q)),
raw AS (SELECT term, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM po, st GROUP BY term, n_docs),
df AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
sc AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avg_size))), 6)::DOUBLE AS score
  FROM pq JOIN df USING (term) JOIN q USING (term), st GROUP BY query_id, doc_id),
lex AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""
BM25 = f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lex WHERE rank <= 10"


def _overlap(spark, sf_dir, multiset, k=10):
    docs, asked = table(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    found = R.ranked(R.jaccard(docs, asked, True), "query_id", "score", "doc_id", k) if multiset else R.jaccard_topk(docs, asked, k)
    return found.select("query_id", "doc_id", "score", "rank")


def jaccard_topk(spark, sf_dir):
    return _overlap(spark, sf_dir, False)


def multiset_jaccard_topk(spark, sf_dir):
    return _overlap(spark, sf_dir, True)


def _jaccard_sql(count, name="jac"):
    return f"""
{name}_d AS (SELECT doc_id, term, {count} AS tf FROM (SELECT doc_id, unnest({_WORDS.format("coalesce(text, '')", 1)}) AS term FROM documents) WHERE term NOT IN ({_STOP}) GROUP BY doc_id, term),
{name}_q AS (SELECT query_id, term, {count} AS tf FROM (SELECT item_id AS query_id, unnest({_WORDS.format("coalesce(text, '')", 1)}) AS term FROM benchmark) WHERE term NOT IN ({_STOP}) GROUP BY query_id, term),
{name}_c AS (SELECT query_id, doc_id, sum(least(d.tf, q.tf)) AS c FROM {name}_d AS d JOIN {name}_q AS q USING (term) GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, round(c / (nd + nq - c), 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(c / (nd + nq - c), 6) DESC, doc_id) AS rank
  FROM {name}_c JOIN (SELECT doc_id, sum(tf) AS nd FROM {name}_d GROUP BY doc_id) AS x USING (doc_id) JOIN (SELECT query_id, sum(tf) AS nq FROM {name}_q GROUP BY query_id) AS y USING (query_id))"""


JACCARD = f"WITH {_jaccard_sql('1')} SELECT query_id, doc_id, score, rank FROM jac WHERE rank <= 10"
MULTISET = f"WITH {_jaccard_sql('count(*)')} SELECT query_id, doc_id, score, rank FROM jac WHERE rank <= 10"


def _dense(spark, sf_dir, k, where="true", within=None):
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id").withColumnRenamed("embedding", "query")
    return R.dense_topk(v.where(where), asked, k, within).select("query_id", "vec_id", "score", "rank")


def knn_cosine_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10)


_COS = """
cs AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, q.label AS query_label,
  round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))
    / greatest(sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))), 1e-12), 6)::DOUBLE AS score
  FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs)"""
KNN = f"WITH {_COS} SELECT query_id, vec_id, score, rank FROM knn WHERE rank <= 10"


def knn_by_label_filter(spark, sf_dir):
    """The filter holds before any row is scored."""
    return _dense(spark, sf_dir, 5, "label in (1, 2, 3)")


KNN_FILTER = f"WITH {_COS} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs WHERE label IN (1, 2, 3) QUALIFY rank <= 5"


def _two_lists(spark, sf_dir):
    """Written once, as fusions read each list more than once."""
    lexical = written(_lexical(spark, sf_dir, 20).withColumnRenamed("doc_id", "id"), "lexical")
    return lexical, written(_overlap(spark, sf_dir, False, 20).withColumnRenamed("doc_id", "id"), "overlap")


_TWO = f"WITH {_BM25}, {_jaccard_sql('1')}, a AS (SELECT query_id, doc_id AS id, score, rank FROM lex WHERE rank <= 20), b AS (SELECT query_id, doc_id AS id, score, rank FROM jac WHERE rank <= 20)"


def rrf_two_lists(spark, sf_dir):
    a, b = _two_lists(spark, sf_dir)
    return R.ranked(R.reciprocal_ranks(a, b), "query_id", "score", "id", 10).select("query_id", "id", "score", "rank")


RRF = f"""{_TWO}, f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 6)::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10"""


def _hashed(spark, sf_dir, k):
    """The k nearest of all documents by hash embedding."""
    return R.hashed_topk(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), k).select("query_id", F.col("doc_id").alias("id"), "score", "rank")


def hybrid_minmax_fusion(spark, sf_dir):
    """The 20 best documents by BM25 and the 20 nearest of all by hash embedding, scaled and summed."""
    lexical = written(_lexical(spark, sf_dir, 20).select("query_id", F.col("doc_id").alias("id"), "score"), "candidates")
    both = R.hybrid(lexical, written(_hashed(spark, sf_dir, 20).select("query_id", "id", "score"), "dense"))
    return R.ranked(both, "query_id", "score", "id", 10).select("query_id", "id", "score", "rank")


def _embedded(name, rows):
    return f"""
{name}_t AS (SELECT id, w AS term, 1.0::DOUBLE AS weight FROM (SELECT id, unnest(ws) AS w FROM {rows}) UNION ALL
  SELECT id, ws[i] || ' ' || ws[i + 1], 0.5 FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM {rows})),
{name}_s AS (SELECT id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS bucket, sum(weight) AS weight FROM {name}_t GROUP BY ALL),
{name} AS (SELECT id, bucket, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM {name}_s)"""


_MM = "CASE WHEN max(score) OVER p - min(score) OVER p <= 1e-6 THEN CASE WHEN max(score) OVER p > 0 THEN 1.0 ELSE 0.0 END ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p + 1e-6) END"
_NEAR = f"""qt AS (SELECT item_id AS id, {_TOKENS.format("coalesce(text, '')")} AS ws FROM benchmark), dt AS (SELECT doc_id AS id, ws FROM w),
{_embedded('ed', 'dt')}, {_embedded('eq', 'qt')}, owners AS (SELECT DISTINCT id FROM ed), askers AS (SELECT DISTINCT id AS query_id FROM eq),
dots AS (SELECT eq.id AS query_id, ed.id, sum(ed.weight * eq.weight) AS dot FROM eq JOIN ed USING (bucket) GROUP BY ALL),
near AS (SELECT query_id, owners.id, round(coalesce(dot, 0), 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dot, 0), 6) DESC, owners.id) AS rank
  FROM askers CROSS JOIN owners LEFT JOIN dots USING (query_id, id))"""
HYBRID = f"""WITH {_BM25}, a AS (SELECT query_id, doc_id AS id, score FROM lex WHERE rank <= 20), {_NEAR}, b AS (SELECT query_id, id, score FROM near WHERE rank <= 20),
x AS (SELECT query_id, id, {_MM} AS s FROM a WINDOW p AS (PARTITION BY query_id)), y AS (SELECT query_id, id, {_MM} AS s FROM b WINDOW p AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, round(coalesce(x.s, 0) * 0.5 + coalesce(y.s, 0) * 0.5, 6)::DOUBLE AS score FROM x FULL JOIN y USING (query_id, id))
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10"""


def priority_merge(spark, sf_dir):
    a, b = _two_lists(spark, sf_dir)
    return R.priority_merge(a, b)


PRIORITY = f"""{_TWO}, u AS (SELECT query_id, id, 0 AS l, rank FROM a UNION ALL SELECT query_id, id, 1, rank FROM b),
f AS (SELECT query_id, id, CAST(l AS BIGINT) AS list, rank AS list_rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY l, rank) = 1)
SELECT query_id, id, list, list_rank, row_number() OVER (PARTITION BY query_id ORDER BY list, list_rank, id) AS rank FROM f"""


def _label_gold(spark, sf_dir):
    """Found neighbours of each query, and as gold the query's ten nearest of its own label."""
    return tuple(_dense(spark, sf_dir, 10, within=w).withColumnRenamed("vec_id", "id").select("query_id", "id", "rank") for w in (None, "label"))


_GOLD = f"""WITH {_COS}, f AS (SELECT query_id, vec_id AS id, rank FROM knn WHERE rank <= 10),
g AS (SELECT query_id, vec_id AS id FROM cs WHERE label = query_label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10)"""


def recall_at_k_strict(spark, sf_dir):
    found, gold = _label_gold(spark, sf_dir)
    return R.strict_recall(found, gold.select("query_id", "id"))


RECALL = f"""{_GOLD} SELECT query_id, count(*) AS n_gold, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS recall_at_1,
round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS recall_at_10
FROM g LEFT JOIN f USING (query_id, id) GROUP BY query_id"""


def prefix_any_all_coverage(spark, sf_dir):
    found, gold = _label_gold(spark, sf_dir)
    return R.prefix_coverage(found, gold.select("query_id", "id"))


PREFIX = f"""{_GOLD}, n AS (SELECT query_id, count(*) AS n FROM g GROUP BY query_id),
h AS (SELECT f.query_id, f.rank, sum(CASE WHEN g.id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY f.query_id ORDER BY f.rank) AS c FROM f LEFT JOIN g USING (query_id, id))
SELECT query_id, rank, CAST(c > 0 AS DOUBLE) AS any_hit, CAST(coalesce(n > 0 AND c = n, false) AS DOUBLE) AS all_hit, round(CASE WHEN n > 0 THEN c / n ELSE 0.0 END, 6)::DOUBLE AS coverage
FROM h LEFT JOIN n USING (query_id)"""


def containment_join(spark, sf_dir):
    """Documents that hold a whole benchmark text."""
    return R.contained(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item")), table(spark, sf_dir, "documents"))


CONTAINS = "SELECT item_id, doc_id FROM benchmark AS b JOIN documents AS d ON contains(d.text, b.text)"

QUERIES = {
    "bm25_topk": (bm25_topk, BM25), "jaccard_topk": (jaccard_topk, JACCARD), "multiset_jaccard_topk": (multiset_jaccard_topk, MULTISET),
    "knn_cosine_topk": (knn_cosine_topk, KNN), "knn_by_label_filter": (knn_by_label_filter, KNN_FILTER), "rrf_two_lists": (rrf_two_lists, RRF),
    "hybrid_minmax_fusion": (hybrid_minmax_fusion, HYBRID), "priority_merge": (priority_merge, PRIORITY),
    "recall_at_k_strict": (recall_at_k_strict, RECALL), "prefix_any_all_coverage": (prefix_any_all_coverage, PREFIX),
    "containment_join": (containment_join, CONTAINS),
}
