import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import filters, text, vector
from lodestrata.operators import chunks, graph, memory, retrieval
from lodestrata.plans import retrieval_queries, table_queries
from lodestrata.sources import conversations as C
from lodestrata.sources import store
from lodestrata.streaming import events as S


def test_answers(spark):
    df = spark.createDataFrame([("The  Cat, sat!", "cat sat"), (None, ""), ("a b", "c")], "p string, g string")
    got = df.select(text.exact_match(F.col("p"), F.col("g")).alias("e"), text.substring_match(F.col("p"), F.col("g")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (1.0, 1.0), (0.0, 0.0)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "x", {"k": "1"}), (2, "y", {}), (3, None, None)], "id long, s string, m map<string,string>")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(filters.condition({})) == [1, 2, 3]
    assert ids(filters.condition({"or": [{"s": "x"}, {"id": {"gte": 3}}]})) == [1, 3]
    assert ids(filters.payload_matches(F.col("m"), {"k": [1, 2]})) == [1]
    with pytest.raises(ValueError):
        filters.condition({"id": {"near": 3}})
    assert filters.wanted_values(" a, ,b ") == ["a", "b"] and filters.wanted_values("") is None


def test_vectors_and_ranks(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0]
    found = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, id long, rank long")
    gold = spark.createDataFrame([(1, 6), (1, 6), (2, 9)], "query_id long, id long")
    got = {r.query_id: r for r in retrieval.strict_recall(found, gold).collect()}
    assert got[1].recall_at_1 == 0.0 and got[1].recall_at_5 == 1.0 and got[2].recall_at_10 == 0.0


def test_hybrid_of_a_constant_list(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], "query_id long, id long, score double")
    b = spark.createDataFrame([(1, 2, 0.0)], "query_id long, id long, score double")
    assert {r.id: r.score for r in retrieval.hybrid(a, b).collect()} == {1: 0.5, 2: 0.5}


def test_packing_and_windows(spark):
    turns = spark.createDataFrame([(1, t, s) for t, s in enumerate((5, 5, 20, 1))], "c long, t long, s long")
    got = sorted(tuple(r) for r in chunks.pack_turns(turns, "c", "t", F.col("s"), 10).collect())
    assert got == [(1, 0, 0, 1, 2, 10), (1, 1, 2, 2, 1, 20), (1, 2, 3, 3, 1, 1)]
    windows = sorted(tuple(r) for r in chunks.sliding(turns, "c", "t", 3, 1).collect())
    assert windows == [(1, 0, 0, 2, 3), (1, 1, 2, 3, 2)]


def test_change_log(spark):
    log = spark.createDataFrame([(1, 1, "add"), (1, 2, "delete"), (2, 1, "add")], "id long, n long, op string")
    assert [r.id for r in memory.alive(log, ["id"], ["n"], F.col("op") == "delete").collect()] == [2]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hop for r in graph.hops(edges, start, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.node: r.degree for r in graph.degrees(edges).collect()} == {"a": 1, "b": 2, "c": 3}


def test_sources(spark, tmp_path):
    sample = [{"sample_id": "s", "conversation": {"session_2": [{"dia_id": "D2:1", "speaker": "A", "text": "x"}], "session_1": [{"dia_id": "D1:1", "speaker": "B", "text": "y", "blip_caption": "z"}], "session_1_date_time": "noon"},
               "qa": [{"question": "q", "answer": "a", "adversarial_answer": "b", "category": 5, "evidence": ["D1:1"]}]}]
    (tmp_path / "s.json").write_text(json.dumps(sample))
    turns = C.session_samples(spark, str(tmp_path / "s.json")).orderBy("session").collect()
    assert [(r.source_id, r.text, r.session_time) for r in turns] == [("D1:1", "y [image: z]", "noon"), ("D2:1", "x", None)]
    assert C.session_questions(spark, str(tmp_path / "s.json")).first().answer == "b"
    (tmp_path / "t.json").write_text(json.dumps({"b": [{"tid": "1", "message_list": [{"user": "u", "agent": "v"}, {"message": "m"}]}]}))
    assert [r.text for r in C.trajectory_steps(spark, str(tmp_path / "t.json")).orderBy("step").collect()] == ["user: u\nassistant: v", "m"]
    (tmp_path / "query_3_context_4.json").write_text(json.dumps({"retrieval_context": ["p", "q"]}))
    assert [tuple(r) for r in C.retrieval_debug(spark, str(tmp_path / "query_*.json")).collect()] == [(3, 4, 1, "p"), (3, 4, 2, "q")]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "content string")
    new = store.missing(spark, path, texts)
    assert new.count() == 2
    store.add(spark, path, new.withColumn("embedding", F.array(F.lit(1.0))))
    assert store.missing(spark, path, texts).count() == 0 and store.load(spark, path).count() == 2


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    batch.repartition(3).write.parquet(folder)
    q = S.running_totals(S.read_events(spark, folder)).writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: r.n for r in spark.table("totals").groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    assert got == {r.user_id: r["count"] for r in batch.groupBy("user_id").count().collect()}
    q = S.hourly_counts(S.read_events(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, S.hourly_counts(batch).collect()))


def test_containment_is_of_substrings(spark, tmp_path):
    items = [(1, "see the longestword"), (2, "longestword we see"), (3, "  "), (4, "two words"), (5, ""), (6, None), (7, "a Middle b"), (8, "word")]
    docs = [(1, "x see the longestword.&&&"), (2, "(longestword we seek"), (3, "a middle b\n\x0btwo wordsy  "), (4, "sa Middle bx"), (5, None), (6, ""), (7, "sa Middle bx "),
            (7, "other two words"), (7, "two words"), (None, "two words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in retrieval_queries.containment_join(spark, str(tmp_path)).collect()]
    want = [(i, d) for i, item in items for d, text in docs if item is not None and text is not None and item in text]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_small_ranks_stay(spark, tmp_path):
    # supplier 0 - customers 0-39; customer 0 - suppliers 1-40; supplier 1 - customers 100-139; customer 100 - suppliers 100-139
    trade = [(c, 0) for c in range(40)] + [(0, s) for s in range(1, 41)] + [(c, 1) for c in range(100, 140)] + [(100, s) for s in range(100, 140)]
    tables = {"orders": ("o_orderkey long, o_custkey long", [(n, c) for n, (c, _) in enumerate(trade)]), "lineitem": ("l_orderkey long, l_suppkey long", [(n, s) for n, (_, s) in enumerate(trade)]),
              "supplier": ("s_suppkey long, s_nationkey long", [(s, int(s > 0)) for s in range(140)])}
    for name, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.node: float(r.score) for r in table_queries.personal_rank_fixed_rounds(spark, str(tmp_path)).collect()}
    links = {}
    for c, s in trade:
        links.setdefault(f"c{c}", []).append(f"s{s}")
        links.setdefault(f"s{s}", []).append(f"c{c}")
    x = {"s0": 1.0}
    for _ in range(20):
        after = {"s0": 0.5}
        for node, score in x.items():
            for other in links[node]:
                after[other] = after.get(other, 0.0) + 0.5 * score / len(links[node])
        x = after
    assert set(got) == set(x) == set(links)
    assert all(abs(got[n] - x[n]) <= 1e-5 * x[n] for n in x)


def test_places_with_more_columns(spark):
    rows = spark.range(0, 50_000).select((F.col("id") * 7919 % 50_021).alias("k"), F.rand(3).alias("x"), F.col("id").cast("string").alias("s")).repartition(7)
    got = memory.global_places(rows, "k").select("k", "place", "s").collect()
    keys = sorted(r.k for r in got)
    assert len(got) == 50_000 and {r.k: r.place for r in got} == {k: i for i, k in enumerate(keys)}


def test_frequent_terms_keep_a_positive_weight(spark):
    import math

    docs = [(0, "a a b"), (1, "a c"), (2, "a d d"), (3, None)]
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, "a a d")], "query_id long, text string")).collect()}
    df, n, avg = {"a": 3, "b": 1, "c": 1, "d": 1}, 4, 8 / 4
    idf = {t: math.log((n - x + 0.5) / (x + 0.5)) for t, x in df.items()}
    floor = 0.25 * sum(idf.values()) / 4
    weight = lambda t, tf, size: (floor if idf[t] < 0 else idf[t]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avg))
    want = {(9, 0): 2 * weight("a", 2, 3), (9, 1): 2 * weight("a", 1, 2), (9, 2): 2 * weight("a", 1, 3) + weight("d", 2, 3)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert retrieval.bm25(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(9, "a")], "query_id long, text string")).collect() == []


def test_dense_topk_in_blocks_and_slices(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    x[7], x[8] = 0, x[9]
    v = spark.createDataFrame([(i, [float(c) for c in r], i % 3) for i, r in enumerate(x)] + [(900, None, 1), (901, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    asked = v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id").withColumnRenamed("embedding", "query")
    for within in (None, "label"):
        got = retrieval.dense_topk(v, asked, 4, within, block=7, rows_a_task=50).collect()
        for q in range(0, 300, 10):
            score = np.round(x @ x[q] / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]), 1e-12), 6)
            ids = [i for i in range(300) if i != q and (within is None or i % 3 == q % 3)]
            want = sorted(ids, key=lambda i: (-score[i], i))[:4]
            assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_personal_rank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", -1.0)], "src string, dst string, weight double")
    reset = spark.createDataFrame([("a", 1.0), ("z", 3.0), ("y", -2.0)], "node string, r double")
    got = {r.node: r.score for r in graph.personal_rank(edges, reset, 0.5, 8).collect()}
    x, r = {"a": 0.25, "z": 0.75}, {"a": 0.25, "z": 0.75}
    links = {"a": {"b": 1.0}, "b": {"a": 1 / 3, "c": 2 / 3}, "c": {"b": 1.0}}
    for _ in range(8):
        after = {n: r[n] * (0.5 + 0.5 * x["z"]) for n in r}
        for n, s in x.items():
            for m, share in links.get(n, {}).items():
                after[m] = after.get(m, 0.0) + 0.5 * share * s
        x = after
    assert set(got) == set(x) and all(abs(got[n] - x[n]) < 1e-12 for n in x) and abs(sum(got.values()) - 1) < 1e-12


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 3), (3, 7), (1, 7)], "src long, dst long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4}
    pairs = spark.createDataFrame([(1, 3), (1, 5), (1, 1), (2, 7)], "start long, goal long")
    assert {(r.start, r.goal): r.path for r in graph.paths(edges, pairs, 3).select("start", "goal", F.expr("transform(path, x -> int(x))").alias("path")).collect()} == {(1, 3): [1, 2, 3], (1, 5): [], (1, 1): [1], (2, 7): [2, 3, 7]}


def test_greedy_selections(spark):
    import numpy as np

    from lodestrata.operators import selection

    rng = np.random.default_rng(2)
    lists = {g: [(g, i, float(np.round(rng.random(), 3)), [float(c) for c in rng.normal(size=3)]) for i in range(40)] for g in (1, 2)}
    df = spark.createDataFrame([r for rows in lists.values() for r in rows], "q long, id long, score double, vector array<double>")
    near, taken = {}, {}
    for g, rows in lists.items():
        rows = sorted(rows, key=lambda r: (-r[2], r[1]))
        unit = [np.array(r[3]) / np.linalg.norm(r[3]) for r in rows]
        kept = []
        for i in range(40):
            if all(unit[i] @ unit[j] <= 0.8 for j in kept):
                kept.append(i)
        near[g] = [rows[i][1] for i in kept]
        pick = list(range(5))
        while len(pick) < 12:
            def gain(i):
                s = max(unit[i] @ unit[j] for j in pick)
                return round(0.8 * rows[i][2] - 0.2 * (s * np.exp(10 * (s - 0.9)) if s > 0.9 else s), 9)

            pick.append(max((i for i in range(40) if i not in pick), key=lambda i: (gain(i), -i)))
        taken[g] = [rows[i][1] for i in sorted(pick)]
    order = lambda found: {g: [r.id for r in sorted(found, key=lambda r: r.place) if r.q == g] for g in (1, 2)}
    assert order(selection.greedy_distinct(df, "q", 0.8).collect()) == near
    assert order(selection.mmr(df, "q", 12).collect()) == taken


def test_incremental_clusters(spark):
    from lodestrata.operators import selection

    day = 86_400_000_000
    rows = [(1, 1, 0, [1.0, 0.0]), (1, 2, day, [0.9, 0.1]), (1, 3, 2 * day, [0.0, 1.0]), (1, 4, 20 * day, [1.0, 0.0]), (2, 5, 0, [1.0, 1.0])]
    got = selection.incremental_clusters(spark.createDataFrame(rows, "g long, id long, at long, vector array<double>"), "g").collect()
    assert {r.id: r.cluster for r in got} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0}


def test_upserts_and_fallbacks(spark):
    from lodestrata.operators import lists

    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (4, None, 4)], "id long, v string, made long")
    new = spark.createDataFrame([(2, None, 9), (3, "d", 9), (3, "d", 9)], "id long, v string, made long")
    assert sorted(map(tuple, memory.inserted_if_absent(old, new, ["id"]).collect()))[2] == (3, "d", 9)
    assert sorted(map(tuple, memory.upserted(old, new.distinct(), ["id"], ("made",)).collect())) == [(1, "a", 1), (2, None, 2), (3, "d", 9), (4, None, 4)]
    gold = spark.createDataFrame([(1, "x", "g1"), (5, "y", "g5"), (6, "z", "g6"), (7, "z", "g7")], "id long, key string, gold string")
    rows = spark.createDataFrame([(1, "y"), (None, "y"), (None, "z"), (8, "x")], "id long, key string")
    assert sorted(((r.way, r.gold) for r in lists.fallback_join(rows, gold, ["id", "key"], "gold").collect()), key=repr) == [("id", "g1"), ("key", "g1"), ("key", "g5"), (None, None)]


def test_chunks_by_plain_packing(spark):
    def plain(sizes, budget, between, empty_first):
        out, n, used, first = [], 0, 0, True
        for s in sizes:
            if (used and used + between + s > budget) or (empty_first and first and s > budget):
                n, used = n + 1, s
            else:
                used += s + (between if used else 0)
            out.append(n)
            first = False
        return out

    sizes = [[5, 5, 20, 1], [30], [], None, [1] * 12, [11, 1, 9]]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, s array<long>")
    for how in ((10, 0, False), (10, 1, False), (10, 2, True)):
        got = {r.id: r.n for r in df.select("id", chunks.packed(F.col("s"), *how).alias("n")).collect()}
        assert got == {i: plain(s or [], *how) for i, s in enumerate(sizes)}
    windows = chunks.token_windows(spark.createDataFrame([(1, list("abcdefg")), (2, [])], "id long, ws array<string>"), "id", F.col("ws"), 4, 1).orderBy("window").collect()
    assert [(r.first, r.text) for r in windows] == [(0, "a b c d"), (3, "d e f g")]


def test_arrow_files_and_paths(spark, tmp_path):
    import pyarrow as pa

    from lodestrata.sources import files

    table = pa.table({"id": [1, 2, 3], "text": ["a", None, "c"], "more": [0.5, 0.5, 0.5]})
    with pa.ipc.new_stream(str(tmp_path / "a.arrow"), table.schema) as w:
        w.write_table(table)
    with pa.ipc.new_file(str(tmp_path / "b.arrow"), table.schema) as w:
        w.write_table(table.slice(1))
    got = files.arrow_rows(spark, str(tmp_path / "*.arrow"), "id long, text string, other int").collect()
    assert sorted((r.id, r.text, r.other) for r in got if r.text) == [(1, "a", None), (3, "c", None), (3, "c", None)] and len(got) == 5
    assert [p.rsplit("/", 1)[1] for p in files.paths(spark, [str(tmp_path / "b*"), str(tmp_path / "*.arrow"), str(tmp_path / "none*")])] == ["a.arrow", "b.arrow"]
    assert files.resolved("d", "first", None, "some_high") == ["d/first/high.json"] and files.exists(spark, str(tmp_path)) and not files.exists(spark, str(tmp_path / "x"))


def test_sessions_and_merged_upserts(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    S.upsert_latest(S.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    want = memory.last_wins(batch, ["user_id", "event_type"], ["ts", "event_id"])
    got = S.latest_version(spark, str(tmp_path / "out"))
    assert sorted((r.user_id, r.event_type, r.event_id) for r in got.collect()) == sorted((r.user_id, r.event_type, r.event_id) for r in want.collect())
    # a batch that comes again changes nothing
    S.upsert_latest(S.read_events(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert S.latest_version(spark, str(tmp_path / "out")).count() == got.count()
    s = S.sessions(batch, "6 hours").collect()
    assert sum(r.n for r in s) == batch.count()


def test_vectors_that_have_no_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vector.cosine_or_null(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 1) < 1e-12 and got[1:] == [None, None, None]
    mean = spark.createDataFrame([([1.0, 3.0], 1, [3.0, 5.0])], "m array<double>, n int, x array<double>").select(vector.running_mean(F.col("m"), F.col("n"), F.col("x"))).first()[0]
    assert mean == [2.0, 4.0]
