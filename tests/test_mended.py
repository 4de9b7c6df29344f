from pyspark.sql import functions as F

from lodestrata.functions import cleanup
from lodestrata.operators import retrieval
from lodestrata.plans import retrieval_queries as Q


def test_updates_are_judged_on_whole_texts(spark):
    same = "abcdefghij " * 12  # the texts differ after their first 60 characters only
    rows = [(same + "xyz", same), (same, same), ("a" * 30, "b" * 30), (same * 20 + "xyzuvw", same * 20), ("", ""), (None, None), ("", "abc"), ("你好吗", "你好")]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, new string, old string")
    got = [r.k for r in df.select("n", cleanup.keep_update(F.col("new"), F.col("old")).alias("k")).orderBy("n").collect()]
    assert got == [True, False, False, False, False, False, False, True]
    sizes = df.select("n", cleanup.estimated_tokens(F.col("old")).alias("t")).orderBy("n").collect()
    assert [r.t for r in sizes][4:] == [0, 0, 2, 3] and sizes[2].t == int(1.33 + 15)
    assert [r[0] for r in df.orderBy("n").select(cleanup.long_enough(F.col("old"))).collect()] == [True, True, True, True, False, False, False, False]


def test_ties_go_to_the_later_row_before_the_cut(spark):
    v = spark.createDataFrame([(k, [1.0, 0.0], k % 5) for k in range(40)] + [(100, [0.0, 1.0], 9), (101, [1.0, 0.0], None)], "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(3, [2.0, 0.0])], "query_id long, query array<double>")
    got = [r.vec_id for r in retrieval.dense_topk(v, q, 9, late="label", rows_a_task=7).orderBy("rank").collect()]
    assert got == [4, 9, 14, 19, 24, 29, 34, 39, 8]
    assert 3 in [r.vec_id for r in retrieval.dense_topk(v, q, 50, skip_self=False).collect()]


def test_hashed_neighbours_are_looked_for_among_all_documents(spark, sf_dir):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple pie crust"), (3, None), (4, ""), (5, "zebra")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "apple pie"), (2, "")], "query_id long, text string")
    got = [(r.query_id, r.doc_id) for r in retrieval.hashed_topk(docs, asked, 2).orderBy("rank").collect()]
    assert got == [(1, 1), (1, 2)]
    lexical = {(r.query_id, r.doc_id) for r in Q._lexical(spark, sf_dir, 50).collect()}
    fused = {(r.query_id, r.id) for r in Q._hashed(spark, sf_dir, 20).collect()}
    assert fused - lexical  # documents that BM25's list lacks


def test_cosines_are_rounded_to_six_digits_and_then_to_two_halves_up(spark):
    cosines = [0.3449996, 0.345, 0.3449994, 0.125, -0.125, -0.3449996]  # numpy's even halves give 0.34, 0.34, 0.34, 0.12, -0.12, -0.34
    v = spark.createDataFrame([(k, [c, (1 - c * c) ** 0.5]) for k, c in enumerate(cosines)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<double>")
    got = {r.vec_id: r.score for r in retrieval.dense_topk(v, q, 9, digits=2).collect()}
    assert got == {0: 0.35, 1: 0.35, 2: 0.34, 3: 0.13, 4: -0.13, 5: -0.35}


def test_first_documents_of_a_query_equal_those_of_all_scores(spark, sf_dir):
    """Best of each batch by products of matrices; scores of all pairs of documents and queries are not shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the of"), (-4, "ab ab")], "doc_id long, text string"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ab ab the")], "query_id long, text string"))
    few = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a")], "doc_id long, text string")  # a term that all have, and a mean below 0
    for d, q in ((docs, asked), (few, spark.createDataFrame([(1, "a b z"), (2, "z")], "query_id long, text string"))):
        for got, scored in ((retrieval.bm25_topk(d, q, 7, block=11), retrieval.bm25(d, q)), (retrieval.jaccard_topk(d, q, 7, block=11), retrieval.jaccard(d, q))):
            want = retrieval.ranked(scored, "query_id", "score", "doc_id", 7)
            assert "mapInArrow" in (plan := got._jdf.queryExecution().toString()) or "MapInArrow" in plan
            rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in df.collect())
            assert rows(got) == rows(want)


def test_hashed_neighbours_equal_embeddings_that_are_compared_one_by_one(spark, sf_dir):
    """Texts are embedded where they are met: only the best of a task are shuffled, not every word and pair of words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(5)
    got = retrieval.hashed_topk(docs, asked, 6)
    assert "MapInArrow" in (plan := got._jdf.queryExecution().toString()) and "posexplode" not in plan and "md5" not in plan
    pairs = docs.crossJoin(asked.select("query_id")).where("size(filter(split(text, '[ \n]'), w -> w <> '')) > 0").select("query_id", "doc_id")
    want = retrieval.ranked(retrieval.hashed_cosine(pairs, docs, asked), "query_id", "score", "doc_id", 6)
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in df.collect())
    assert rows(got) == rows(want)
