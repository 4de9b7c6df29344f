"""Queries that compose retrieval, selection and clustering operators, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import cleanup as C
from lodestrata.functions import text as T
from lodestrata.functions import vector as V
from lodestrata.operators import retrieval as R
from lodestrata.operators import selection as S
from lodestrata.plans.retrieval_queries import _BM25, _COS, _NEAR, _dense, _embedded, _hashed, _lexical, _questions
from lodestrata.plans.text_queries import _TOKENS
from lodestrata.session import rounded, table, written


def bm25_tfidf_rerank(spark, sf_dir):
    """Twenty candidates by BM25, then 0.7 of their score within the highest plus 0.3 of the hash-embedding cosine; ten stay."""
    lexical = written(_lexical(spark, sf_dir, 20).select("query_id", "doc_id", F.col("score").alias("bm25")), "candidates")
    cosine = R.hashed_cosine(lexical.select("query_id", "doc_id"), table(spark, sf_dir, "documents"), _questions(spark, sf_dir))
    top = F.max("bm25").over(Window.partitionBy("query_id"))
    both = lexical.join(cosine, ["query_id", "doc_id"]).withColumn("score", rounded(F.when(top > 0, F.col("bm25") / top).otherwise(0.0) * 0.7 + F.col("score") * 0.3))
    return R.ranked(both.select("query_id", "doc_id", "score"), "query_id", "score", "doc_id", 10)


RERANK = f"""WITH {_BM25}, a AS (SELECT query_id, doc_id AS id, score FROM lex WHERE rank <= 20),
dt AS (SELECT doc_id AS id, ws FROM w WHERE doc_id IN (SELECT id FROM a)), qt AS (SELECT item_id AS id, {_TOKENS.format("coalesce(text, '')")} AS ws FROM benchmark),
{_embedded('ed', 'dt')}, {_embedded('eq', 'qt')},
b AS (SELECT query_id, a.id, any_value(a.score) AS bm25, round(coalesce(sum(ed.weight * eq.weight), 0), 6)::DOUBLE AS cs FROM a LEFT JOIN eq ON eq.id = query_id LEFT JOIN ed ON ed.id = a.id AND ed.bucket = eq.bucket GROUP BY query_id, a.id),
f AS (SELECT query_id, id AS doc_id, round(CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY query_id) ELSE 0.0 END * 0.7 + cs * 0.3, 6)::DOUBLE AS score FROM b)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10"""


def lightweight_hybrid(spark, sf_dir):
    """The 50 best by BM25 and the 50 nearest of all documents by embedding, fused by reciprocal ranks; 20 stay."""
    lexical = written(_lexical(spark, sf_dir, 50).select("query_id", F.col("doc_id").alias("id"), "rank"), "candidates")
    fused = R.reciprocal_ranks(lexical, written(_hashed(spark, sf_dir, 50).select("query_id", "id", "rank"), "dense"))
    return R.ranked(fused, "query_id", "score", "id", 20).select("query_id", "id", "score", "rank")


LIGHT = f"""WITH {_BM25}, a AS (SELECT query_id, doc_id AS id, rank FROM lex WHERE rank <= 50), {_NEAR}, d AS (SELECT query_id, id, rank FROM near WHERE rank <= 50),
f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 6)::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM d) GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 20"""


def relation_bm25(spark, sf_dir):
    """The five relations (user, kind, key) that match each of twenty questions best."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("u"), "user_id"), "event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("text"))
    asked = spark.range(0, 20).select(F.col("id").alias("query_id"), F.concat(F.lit("did u"), F.col("id") % 15, F.lit(" click or signup k"), F.col("id") * 4).alias("text"))
    return R.ranked(R.bm25(e, asked), "query_id", "score", "doc_id", 5).select("query_id", "doc_id", "score", "rank")


RELATIONS = """
WITH w AS (SELECT event_id AS doc_id, string_split('u' || user_id || ' ' || event_type || coalesce(' k' || json_extract_string(props, '$.k'), ''), ' ') AS ws FROM events),
q AS (SELECT i AS query_id, unnest(string_split('did u' || i % 15 || ' click or signup k' || i * 4, ' ')) AS term FROM range(20) AS t(i)),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(len(ws)) AS avg_size FROM w), po AS (SELECT doc_id, term, count(*) AS tf, first(size) AS size FROM (SELECT doc_id, len(ws) AS size, unnest(ws) AS term FROM w) GROUP BY doc_id, term),
raw AS (SELECT term, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM po, st GROUP BY term, n_docs), df AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avg_size))), 6)::DOUBLE AS score FROM po JOIN df USING (term) JOIN q USING (term), st GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 5"""


def synonymy_edges(spark, sf_dir):
    """Of each asked vector its neighbours of a cosine of 0.4 at least, ten at most, as edges without loops; ids of over two characters only."""
    found = _dense(spark, sf_dir, 10).where("score >= 0.4")
    return found.where("length(cast(vec_id as string)) > 1 and query_id <> vec_id").select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("score").alias("weight"))


SYNONYMS = f"WITH {_COS} SELECT query_id AS src, vec_id AS dst, score AS weight FROM knn WHERE rank <= 10 AND score >= 0.4 AND length(CAST(vec_id AS VARCHAR)) > 1"


def conflict_candidates(spark, sf_dir):
    """The five nearest of each asked vector that have another label: what a judge would be asked about."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _dense(spark, sf_dir, 20)
    both = near.join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").where("label <> own")
    return R.ranked(both.select("query_id", "vec_id", "score"), "query_id", "score", "vec_id", 5)


CONFLICTS = f"WITH {_COS} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM knn WHERE knn.rank <= 20 AND label <> query_label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"


def passage_search(spark, sf_dir):
    """The ten nearest passages by distance (to two digits), then the newer (larger label), then the id: the order holds before the cut."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = R.dense_topk(v, asked, 10, late="label", digits=2)
    return near.select("query_id", "vec_id", rounded(1 - F.col("score"), 2).alias("distance"), F.col("rank").alias("place"))


PASSAGES = f"""WITH {_COS}, d AS (SELECT query_id, vec_id, label, round(1 - round(score, 2), 2)::DOUBLE AS distance FROM cs)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, label DESC, vec_id) AS place FROM d QUALIFY place <= 10"""


def _candidate_lists(spark, sf_dir, k=30):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _dense(spark, sf_dir, k).select("query_id", F.col("vec_id").alias("id"), "score").join(v, "id")


def mmr_select(spark, sf_dir):
    """Ten of each asked vector's thirty nearest by maximal marginal relevance."""
    return S.mmr(_candidate_lists(spark, sf_dir), "query_id", 10).select("query_id", "id", "place")


def greedy_similarity_dedup(spark, sf_dir):
    """Of each asked vector's thirty nearest those with a cosine of at most 0.3 to all that are kept before them."""
    return S.greedy_distinct(_candidate_lists(spark, sf_dir), "query_id", 0.3).select("query_id", "id", "place")


_LISTS = """
c AS (SELECT query_id, vec_id AS id, rank FROM knn WHERE rank <= 30),
p AS (SELECT a.query_id, a.rank AS i, b.rank AS j, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))), 9) AS s
 FROM c AS a JOIN c AS b ON a.query_id = b.query_id AND b.rank < a.rank JOIN embeddings AS x ON x.vec_id = a.id JOIN embeddings AS y ON y.vec_id = b.id)"""
GREEDY = f"""
WITH RECURSIVE {_COS}, {_LISTS},
r AS (SELECT query_id, CAST(1 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS kept FROM c WHERE rank = 1 UNION ALL
 SELECT r.query_id, r.i + 1, CASE WHEN coalesce((SELECT max(s) FROM p WHERE p.query_id = r.query_id AND p.i = r.i + 1 AND list_contains(r.kept, p.j)), -1) <= 0.3 THEN list_append(r.kept, r.i + 1) ELSE r.kept END FROM r WHERE r.i < 30),
k AS (SELECT query_id, unnest(kept) AS rank, generate_subscripts(kept, 1) AS place FROM r WHERE i = 30) SELECT k.query_id, c.id, place FROM k JOIN c ON c.query_id = k.query_id AND c.rank = k.rank"""


def incremental_clusters(spark, sf_dir):
    """Vectors of each label in the order of ids, one each six hours, in clusters of a cosine of 0.3 within three days."""
    v = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), (F.col("vec_id") * 21_600_000_000).alias("at"), F.col("embedding").alias("vector"))
    return S.incremental_clusters(v, "label", 0.3, 3.0)


def edge_materialisation(spark, sf_dir):
    """Links between customers that exist, without loops, once each way, with how often they come."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 31 % 1009).alias("dst"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dst"))
    return o.where("src <> dst").join(c, "dst", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("weight"))


EDGES = "SELECT o_custkey AS src, o_orderkey * 31 % 1009 AS dst, count(*) AS weight FROM orders WHERE o_custkey <> o_orderkey * 31 % 1009 AND o_orderkey * 31 % 1009 IN (SELECT c_custkey FROM customer) GROUP BY ALL"


def facts_by_section(spark, sf_dir):
    """Of each user five facts, five keys and its days, each section in its own order, with the range of time in which a fact holds."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k"))
    facts = e.groupBy("user_id", F.concat_ws(" ", "event_type", "k").alias("what")).agg(F.min(F.unix_seconds("ts")).alias("since"), F.max(F.unix_seconds("ts")).alias("until"))
    keys = e.groupBy("user_id", F.col("k").alias("what")).agg(F.min(F.unix_seconds("ts")).alias("since"), F.max(F.unix_seconds("ts")).alias("until"))
    days = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("what")).agg(F.min(F.unix_seconds("ts")).alias("since"), F.max(F.unix_seconds("ts")).alias("until"))
    every = [x.withColumn("section", F.lit(n)) for n, x in (("facts", facts), ("keys", keys), ("days", days))]
    w = Window.partitionBy("section", "user_id").orderBy("since", "what")
    return every[0].unionByName(every[1]).unionByName(every[2]).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5")


SECTIONS = """
WITH e AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, strftime(ts, '%Y-%m-%d') AS d FROM events),
x AS (SELECT 'facts' AS section, user_id, event_type || ' ' || k AS what, min(s) AS since, max(s) AS until FROM e GROUP BY ALL UNION ALL SELECT 'keys', user_id, k, min(s), max(s) FROM e GROUP BY ALL UNION ALL SELECT 'days', user_id, d, min(s), max(s) FROM e GROUP BY ALL)
SELECT user_id, what, since, until, section, row_number() OVER (PARTITION BY section, user_id ORDER BY since, what) AS place FROM x QUALIFY place <= 5"""

def combined_text_similarity(spark, sf_dir):
    """Parts against the part before in their brand: words, characters and character pairs together where the cosine of both vectors, those of the parts' numbers, is over 0.1; 0 where one has no vector."""
    p = table(spark, sf_dir, "part").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding"), "p_partkey", "left")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a"), F.lag(F.concat_ws(" ", "p_name", "p_type")).over(w).alias("b"), rounded(V.cosine(F.col("embedding"), F.lag("embedding").over(w))).alias("near")).where("b is not null")
    words = lambda c: F.array_distinct(T.word_tokens(F.col(c)))
    dice, bigram = C.dice(words("a"), words("b")), T.set_jaccard(C.ngrams(T.ascii_lower(F.col("a"))), C.ngrams(T.ascii_lower(F.col("b"))))
    tfidf = C.char_tfidf_cosine(F.col("a"), F.col("b"))
    return pairs.select("p_partkey", rounded(tfidf).alias("tfidf"), S.combined_similarity(dice, tfidf, bigram, F.col("near"), 0.1).alias("score"))


_G2 = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_WORDSET = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda w: w <> ''))"
_CHARS = "list_transform(range(1, length({0}) + 1), lambda i: substr({0}, i, 1))"
_SQUARES = "(list_sum(list_transform(list_distinct({0}), lambda c: CASE WHEN list_contains({1}, c) THEN 1.0 ELSE 2.25 END * len(list_filter({0}, lambda z: z = c)) * len(list_filter({0}, lambda z: z = c)))))"
COMBINED = f"""
WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS a, lag(p_name || ' ' || p_type) OVER w AS b, coalesce(round(list_dot_product(x, lag(x) OVER w) / greatest(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(lag(x) OVER w, lag(x) OVER w)), 1e-12::DOUBLE), 6) > 0.1, false) AS same
  FROM (SELECT part.*, CAST(embedding AS DOUBLE[]) AS x FROM part LEFT JOIN embeddings ON vec_id = p_partkey) WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
g AS (SELECT p_partkey, same, {_WORDSET.format('a')} AS u, {_WORDSET.format('b')} AS v, {_G2.format('lower(a)')} AS m, {_G2.format('lower(b)')} AS n, {_CHARS.format('a')} AS x, {_CHARS.format('b')} AS y FROM p WHERE b IS NOT NULL),
s AS (SELECT p_partkey, same, 2 * len(list_intersect(u, v)) / (len(u) + len(v)) AS dice, len(list_intersect(m, n)) / (len(m) + len(n) - len(list_intersect(m, n))) AS bigram,
  coalesce(list_sum(list_transform(list_distinct(list_intersect(x, y)), lambda c: len(list_filter(x, lambda z: z = c)) * len(list_filter(y, lambda z: z = c)))), 0) / sqrt({_SQUARES.format('x', 'y')} * {_SQUARES.format('y', 'x')}) AS tfidf FROM g)
SELECT p_partkey, round(tfidf, 6)::DOUBLE AS tfidf, CASE WHEN same THEN round(dice * 0.40 + tfidf * 0.35 + bigram * 0.25, 6)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM s"""


def temporal_retrieval(spark, sf_dir):
    """Documents whose number is an event of two days, by the value of that event; interval_search has the fallback for empty intervals."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    inside = e.where((F.col("ts") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-05").cast("timestamp"))).select(F.col("event_id").alias("doc_id"), "value")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    found = d.join(inside, "doc_id")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("value"), "doc_id")).cast("long")).where("place <= 5").select("doc_id", "lang", "place")


TEMPORAL = "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY value DESC, doc_id) AS place FROM documents JOIN events ON event_id = doc_id WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05' QUALIFY place <= 5"


def short_to_mid_tier(spark, sf_dir):
    """A user's short tier holds its ten latest events; what was pushed out is the mid tier, in pages of seven with links to the page before."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    early = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    out = e.select("user_id", "event_id", late.alias("late"), early.alias("early")).where("late > 10")
    pages = out.groupBy("user_id", F.floor((F.col("early") - 1) / 7).cast("long").alias("page")).agg(F.count("*").alias("n"), F.min_by("event_id", "early").alias("first_event"))
    return pages.withColumn("before", F.lag("first_event").over(Window.partitionBy("user_id").orderBy("page")))


TIERS = """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS late, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS early FROM events),
p AS (SELECT user_id, (early - 1) // 7 AS page, count(*) AS n, min_by(event_id, early) AS first_event FROM r WHERE late > 10 GROUP BY ALL) SELECT user_id, page, n, first_event, lag(first_event) OVER (PARTITION BY user_id ORDER BY page) AS before FROM p"""

QUERIES = {
    "combined_text_similarity": (combined_text_similarity, COMBINED), "temporal_retrieval": (temporal_retrieval, TEMPORAL), "short_to_mid_tier": (short_to_mid_tier, TIERS),
    "bm25_tfidf_rerank": (bm25_tfidf_rerank, RERANK), "lightweight_hybrid": (lightweight_hybrid, LIGHT), "relation_bm25": (relation_bm25, RELATIONS),
    "synonymy_edges": (synonymy_edges, SYNONYMS), "conflict_candidates": (conflict_candidates, CONFLICTS), "passage_search": (passage_search, PASSAGES),
    "mmr_select": (mmr_select, None), "greedy_similarity_dedup": (greedy_similarity_dedup, GREEDY),
    "incremental_clusters": (incremental_clusters, None), "edge_materialisation": (edge_materialisation, EDGES), "facts_by_section": (facts_by_section, SECTIONS),
}
