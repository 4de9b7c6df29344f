"""Queries that write small fixtures of the given tables in a source's format, read them back, and stream over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.sources import conversations as C
from lodestrata.sources import files, store
from lodestrata.session import rounded, shared_folder, table
from lodestrata.streaming import events as S


def _lines(df, name):
    """One JSON object a line in a new folder."""
    path = shared_folder(df.sparkSession, name)
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


def _dialogues(spark, sf_dir):
    """Conversations as samples of two sessions with questions."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    turn = F.struct(F.concat_ws(":", F.concat(F.lit("D"), F.when(F.col("turn") < 5, 1).otherwise(2)), "turn").alias("dia_id"), F.col("role").alias("speaker"), "text")
    session = lambda first: F.transform(F.array_sort(F.collect_list(F.when((F.col("turn") < 5) == first, F.struct("turn", turn.alias("t"))))), lambda x: x["t"])
    asked = F.struct(F.concat(F.lit("what of "), F.col("conv_id")).alias("question"), F.lit("this").alias("answer"), F.lit("that").alias("adversarial_answer"), (F.col("conv_id") % 5 + 1).cast("int").alias("category"))
    rows = c.groupBy("conv_id").agg(session(True).alias("s1"), session(False).alias("s2"))
    whole = F.create_map(F.lit("session_1"), F.to_json("s1"), F.lit("session_2"), F.to_json("s2"), F.lit("session_1_date_time"), F.lit("noon"))
    return _lines(rows.select(F.concat(F.lit("c"), "conv_id").alias("sample_id"), whole.alias("conversation"), F.array(asked, asked).alias("qa")), "dialogues")


def session_samples_scan(spark, sf_dir):
    found = C.session_samples(spark, _dialogues(spark, sf_dir), True)
    return found.select("sample_id", F.col("session").cast("long").alias("session"), F.col("turn").cast("long").alias("turn"), "source_id", "speaker", F.md5("text").alias("text_md5"), "session_time")


SAMPLES = """
SELECT 'c' || conv_id AS sample_id, CAST(CASE WHEN turn < 5 THEN 1 ELSE 2 END AS BIGINT) AS session, row_number() OVER (PARTITION BY conv_id, turn < 5 ORDER BY turn) - 1 AS turn, 'D' || CASE WHEN turn < 5 THEN 1 ELSE 2 END || ':' || turn AS source_id,
  role AS speaker, md5(text) AS text_md5, CASE WHEN turn < 5 THEN 'noon' END AS session_time FROM conversations WHERE text IS NOT NULL"""


def session_questions_scan(spark, sf_dir):
    """Questions of included categories but the excluded one; the fifth takes the adversarial answer."""
    found = C.session_questions(spark, _dialogues(spark, sf_dir), True, " 1, 3,5 ,", "3")
    return found.select("sample_id", "question_id", "question", "answer", F.col("category").cast("long").alias("category"))


QUESTIONS = """
SELECT 'c' || conv_id AS sample_id, 'c' || conv_id || '_' || n AS question_id, 'what of ' || conv_id AS question, CASE WHEN conv_id % 5 = 4 THEN 'that' ELSE 'this' END AS answer, CAST(conv_id % 5 + 1 AS BIGINT) AS category
FROM (SELECT DISTINCT conv_id FROM conversations WHERE text IS NOT NULL), range(1, 3) AS t(n) WHERE conv_id % 5 IN (0, 4)"""


def trajectory_scan(spark, sf_dir):
    """Users' events as trajectories with a question each: its scenario and variant by place, and how many steps it has."""
    e = table(spark, sf_dir, "events").withColumn("branch", F.concat(F.lit("b"), F.col("user_id") % 2))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.struct(F.concat(F.lit("I "), "event_type").alias("user"), F.lit("noted").alias("agent")).alias("m")))), lambda x: x["m"])
    qa = F.struct(F.concat(F.lit("q"), "user_id").alias("qid"), F.lit("which").alias("question"), F.lit("b").alias("ground_truth"), F.struct(F.lit("x").alias("A"), F.lit("y").alias("B")).alias("choices"))
    one = e.groupBy("branch", "user_id").agg(steps.alias("message_list")).select("branch", "user_id", F.struct(F.col("user_id").cast("string").alias("tid"), "message_list", qa.alias("QA")).alias("r"))
    rows = one.groupBy("branch").agg(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "r"))), lambda x: x["r"]).alias("rows"))
    path = shared_folder(spark, "trajectories")
    rows.select(F.to_json(F.create_map("branch", "rows")).alias("value")).write.text(path)
    asked = C.trajectory_questions(spark, path, True)
    steps = C.trajectory_steps(spark, path, True).groupBy("branch", "tid").agg(F.count("*").alias("n_steps"), F.min("text").alias("first_text"))
    return asked.join(steps, ["branch", "tid"]).select("branch", "tid", "scenario", "variant", "qid", "answer", "n_steps", "first_text")


TRAJECTORIES = """
WITH u AS (SELECT 'b' || user_id % 2 AS branch, user_id, count(*) AS n_steps, min('user: I ' || event_type || chr(10) || 'assistant: noted') AS first_text FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY user_id) - 1 AS n FROM u)
SELECT branch, CAST(user_id AS VARCHAR) AS tid, n // 3 AS scenario, n % 3 AS variant, 'q' || user_id AS qid, 'B' AS answer, n_steps, first_text FROM p"""


def gold_sessions_scan(spark, sf_dir):
    """Conversations as haystacks of one session: how many turns of each role a question has."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), (x["turn"] == 1).alias("has_answer")))
    rows = c.groupBy("conv_id").agg(turns.alias("t")).select(F.concat(F.lit("q"), "conv_id").alias("question_id"), F.lit("which").alias("question"), F.lit("a").alias("answer"), F.lit("single").alias("question_type"), F.array(F.concat(F.lit("s"), "conv_id")).alias("haystack_session_ids"), F.array("t").alias("haystack_sessions"))
    found = C.gold_sessions(spark, _lines(rows, "gold"), True)
    return found.groupBy("question_id", "session_id", "role").agg(F.count("*").alias("n"), F.count_if("has_answer").alias("n_answers"))


GOLD = "SELECT 'q' || conv_id AS question_id, 's' || conv_id AS session_id, role, count(*) AS n, count(*) FILTER (turn = 1) AS n_answers FROM conversations WHERE text IS NOT NULL GROUP BY ALL"


def result_resume(spark, sf_dir):
    """Labels as result rows, every seventh failed: what a resumed run asks again, with failed ones tried again, by language."""
    d = table(spark, sf_dir, "labels")
    row = F.struct(F.col("doc_id").alias("query_id"), F.lit("x").alias("output"), F.when(F.col("doc_id") % 7 == 0, "failed").alias("status"), F.col("quality").cast("double").alias("f1"))
    path = shared_folder(spark, "results")
    d.groupBy((F.col("doc_id") % 8).alias("part")).agg(F.collect_list(row).alias("data")).select("part", F.to_json(F.struct("data")).alias("value")).repartition(8, "part").write.partitionBy("part").text(path)
    results = C.result_rows(spark, f"{path}/part=*")
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "lang")
    again = C.open_queries(asked, results, True).groupBy("lang").agg(F.count("*").alias("n_open"))
    kept = results.where("status <> 'failed'").join(asked, "query_id").groupBy("lang").agg(F.count("*").alias("n_done"), rounded(F.avg("f1")).alias("f1"))
    return again.join(kept, "lang", "full")


RESUME = """
WITH r AS (SELECT lang, quality, doc_id % 7 = 0 AS failed FROM labels JOIN documents USING (doc_id)),
o AS (SELECT lang, count(*) AS n_open FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 7 > 0) GROUP BY lang), k AS (SELECT lang, count(*) AS n_done, round(avg(quality), 6)::DOUBLE AS f1 FROM r WHERE NOT failed GROUP BY lang)
SELECT lang, n_open, n_done, f1 FROM o FULL JOIN k USING (lang)"""


def csv_roundtrip(spark, sf_dir):
    """Turns through CSV with quotes and new lines in them."""
    path = shared_folder(spark, "csv")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit('"q", '), F.coalesce("text", F.lit("")), F.lit("\nend")).alias("text"))
    C.write_rows(c.withColumn("text", F.replace("text", F.lit("\r"), F.lit(""))), path, "csv")
    found = files.csv_rows(spark, path, "conv_id long, turn long, text string")
    return found.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


CSV = "SELECT conv_id, count(*) AS n, CAST(sum(length('\"q\", ' || replace(coalesce(text, ''), chr(13), '') || chr(10) || 'end')) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id"


def ingest_by_hash(spark, sf_dir):
    """Documents that a dataset gains when those with even ids are in it already, counted by source."""
    d = table(spark, sf_dir, "documents")
    none = spark.createDataFrame([], "dataset string, hash_id string, text string")
    old = files.ingest(none, d.where("doc_id % 2 = 0").select("text"), "main")
    new = files.ingest(old, d.select("text"), "main")
    return new.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


INGEST = "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0))"


def store_upsert(spark, sf_dir):
    """An embedding store that gains the benchmark's texts twice and then the turns: what it holds."""
    path = shared_folder(spark, "store")
    for name in ("benchmark", "benchmark", "conversations"):
        texts = table(spark, sf_dir, name).where("text is not null").select(F.col("text").alias("content"))
        store.add(spark, path, store.missing(spark, path, texts).withColumn("embedding", F.array(F.length("content").cast("float"))))
    return store.load(spark, path).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"), F.sum(F.get("embedding", F.lit(0)).cast("long")).alias("total"))


STORE = "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(length(text)) AS BIGINT) AS total FROM (SELECT text FROM benchmark WHERE text IS NOT NULL UNION SELECT text FROM conversations WHERE text IS NOT NULL)"


def _event_stream(spark, sf_dir):
    """Events in the order of their times as three files, read one at a time."""
    path = shared_folder(spark, "events")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    return S.read_events(spark, path)


def _run(rows, spark, key, order, mode="append"):
    folder, checkpoint = shared_folder(spark, "table"), shared_folder(spark, "checkpoint")
    S.upsert_rows(rows, key, order, folder, checkpoint, mode).awaitTermination()
    return S.latest_version(spark, folder)


def stream_upsert_latest(spark, sf_dir):
    found = _run(_event_stream(spark, sf_dir), spark, ["user_id", "event_type"], ["ts", "event_id"])
    return found.select("user_id", "event_type", "event_id", rounded(F.col("value")).alias("value"))


STREAM_LAST = "SELECT user_id, event_type, event_id, round(value, 6)::DOUBLE AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def stream_running_totals(spark, sf_dir):
    """A user's running state after the last micro-batch: how many events, which sum and which is the last id."""
    found = _run(S.running_totals(_event_stream(spark, sf_dir)), spark, ["user_id"], ["n"], "update")
    return found.select("user_id", "n", rounded(F.col("total"), 4).alias("total"), "last_event")


STREAM_TOTALS = "SELECT user_id, count(*) AS n, round(sum(value), 4)::DOUBLE AS total, max(event_id) AS last_event FROM events GROUP BY user_id"


def stream_hourly_counts(spark, sf_dir):
    return _run(S.hourly_counts(_event_stream(spark, sf_dir), "1000 days"), spark, ["window_start", "event_type"], ["n"], "update")


STREAM_HOURS = "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def stream_distinct_events(spark, sf_dir):
    """Events without the repeats that come when the files are read twice."""
    path = shared_folder(spark, "events")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.union(e).repartition(4).write.parquet(path)
    found = _run(S.distinct_events(S.read_events(spark, path, 10), "1000 days"), spark, ["event_id"], ["ts"])
    return found.groupBy("event_type").agg(F.count("*").alias("n"))


STREAM_DISTINCT = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"

QUERIES = {
    "session_samples_scan": (session_samples_scan, SAMPLES), "session_questions_scan": (session_questions_scan, QUESTIONS), "trajectory_scan": (trajectory_scan, TRAJECTORIES),
    "gold_sessions_scan": (gold_sessions_scan, GOLD), "result_resume": (result_resume, RESUME), "csv_roundtrip": (csv_roundtrip, CSV), "ingest_by_hash": (ingest_by_hash, INGEST),
    "store_upsert": (store_upsert, STORE), "stream_upsert_latest": (stream_upsert_latest, STREAM_LAST), "stream_running_totals": (stream_running_totals, STREAM_TOTALS),
    "stream_hourly_counts": (stream_hourly_counts, STREAM_HOURS), "stream_distinct_events": (stream_distinct_events, STREAM_DISTINCT),
}
