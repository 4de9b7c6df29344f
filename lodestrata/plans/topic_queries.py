"""The fallback of topics: every topic is a candidate, by vectors and by words, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import retrieval as R
from lodestrata.session import table


def topic_fallback(spark, sf_dir):
    """Parts as topics, with the vectors of their numbers: of every twentieth the three best of all others, 0.8 by cosine and 0.2 by the words of their names."""
    p = table(spark, sf_dir, "part").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), F.col("embedding").alias("vector")), "p_partkey")
    rows = p.select(F.col("p_partkey").alias("id"), "vector", T.word_tokens(F.concat_ws(" ", "p_name", "p_type"), 3).alias("words"))
    return R.topic_matches(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 3)


_W3 = "list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9_]+'), lambda w: length(w) >= 3))"
TOPIC = f"""
WITH p AS (SELECT p_partkey AS id, CAST(embedding AS DOUBLE[]) AS v, {_W3} AS ws FROM part JOIN embeddings ON vec_id = p_partkey),
s AS (SELECT a.id AS query_id, b.id, round(0.8 * list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) + 0.2 * len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), len(b.ws), 1), 6)::DOUBLE AS score
  FROM p AS a JOIN p AS b ON a.id % 20 = 0 AND a.id <> b.id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3"""

QUERIES = {"topic_fallback": (topic_fallback, TOPIC)}
