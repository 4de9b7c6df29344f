"""Readers of nested conversation, trajectory and result files into three tables: contexts, chunks and questions.

Schemas are stated, so nothing is inferred; files of one JSON array or object are read as whole documents,
and large corpora as one JSON object a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.filters import wanted_values

TURN = "struct<dia_id: string, speaker: string, text: string, blip_caption: string>"
SESSIONS = (
    "struct<sample_id: string, conversation: map<string, string>, qa: array<struct<question: string, answer: string, "
    "adversarial_answer: string, category: int, evidence: array<string>, question_id: string>>>"
)
GOLD = (
    "struct<question_id: string, question: string, answer: string, question_type: string, haystack_session_ids: array<string>, "
    "haystack_sessions: array<array<struct<role: string, content: string, has_answer: boolean>>>>"
)
STEP = "struct<user_message: string, user: string, assistant_message: string, assistant: string, agent: string, message: string, time: string, place: string>"
TRAJECTORY = (
    f"struct<tid: string, message_list: array<{STEP}>, QA: struct<qid: string, question: string, answer: string, ground_truth: string, "
    "choices: map<string, string>, time: string, target_step_id: array<int>>>"
)


def json_array(spark: SparkSession, path: str, element: str, lines: bool = False) -> DataFrame:
    """The elements of files that hold one JSON array each, with their place; a file that is no such array gives no rows.

    Such a file is one row of one task. Large corpora come with one object a line instead (lines), which Spark splits; their place is 0.
    """
    if lines:
        parsed = spark.read.text(path).select(F.from_json("value", element).alias("row")).where("row is not null")
        return parsed.select(F.lit(0).alias("place"), "row.*")
    files = spark.read.text(path, wholetext=True)
    parsed = files.select(F.from_json("value", f"array<{element}>").alias("rows"))
    return parsed.select(F.posexplode("rows").alias("place", "row")).select("place", "row.*")


def session_samples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """sample_id, session, turn, source_id, speaker, text, session_time: dialogues of numbered sessions, in the order of the numbers."""
    rows = json_array(spark, path, SESSIONS, lines)
    number = F.regexp_extract("key", r"^session_(\d+)$", 1)
    parts = rows.select("sample_id", "conversation", F.explode("conversation").alias("key", "value")).where(number != "")
    turns = parts.select(
        "sample_id", number.cast("int").alias("session"), F.from_json("value", f"array<{TURN}>").alias("turns"),
        F.try_element_at("conversation", F.concat(F.col("key"), F.lit("_date_time"))).alias("session_time"),
    )
    return turns.select("sample_id", "session", "session_time", F.posexplode("turns").alias("turn", "t")).select(
        "sample_id", "session", "turn", F.col("t.dia_id").alias("source_id"), F.col("t.speaker").alias("speaker"),
        F.when(F.col("t.blip_caption").isNotNull(), F.concat_ws(" ", "t.text", F.concat(F.lit("[image: "), "t.blip_caption", F.lit("]"))))
        .otherwise(F.col("t.text")).alias("text"), "session_time",
    )


def session_questions(spark: SparkSession, path: str, lines: bool = False, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """sample_id, question_id, question, answer, category, evidence; category 5 takes the adversarial answer where there is one.

    include and exclude name categories as a list or comma string; none named means no filter, and what is excluded goes even if it is included.
    """
    rows = json_array(spark, path, SESSIONS, lines).select("sample_id", F.posexplode("qa").alias("n", "q"))
    category = F.col("q.category").cast("string")
    if wanted := wanted_values(include):
        rows = rows.where(category.isin(*wanted))
    if unwanted := wanted_values(exclude):
        rows = rows.where(~F.coalesce(category.isin(*unwanted), F.lit(False)))
    answer = F.when(F.col("q.category") == 5, F.coalesce("q.adversarial_answer", "q.answer")).otherwise(F.col("q.answer"))
    default = F.concat_ws("_", "sample_id", (F.col("n") + 1).cast("string"))
    return rows.select(
        "sample_id", F.coalesce("q.question_id", default).alias("question_id"), F.col("q.question").alias("question"),
        answer.alias("answer"), F.col("q.category").alias("category"), F.col("q.evidence").alias("evidence"),
    )


def trajectory_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """branch, tid, scenario (three trajectories each, by place), variant (place within it), qid, question, answer (upper-case ground truth where there are choices), choices, target_steps."""
    files = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", f"map<string, array<{TRAJECTORY}>>")).alias("branch", "rows"))
    one = files.select("branch", F.posexplode("rows").alias("at", "r"))
    answer = F.when(F.size("r.QA.choices") > 0, F.upper(F.coalesce("r.QA.ground_truth", "r.QA.answer"))).otherwise(F.coalesce("r.QA.answer", "r.QA.ground_truth"))
    return one.where("r.QA is not null").select(
        "branch", "r.tid", F.floor(F.col("at") / 3).cast("long").alias("scenario"), (F.col("at") % 3).cast("long").alias("variant"), F.col("r.QA.qid").alias("qid"),
        F.col("r.QA.question").alias("question"), answer.alias("answer"), F.col("r.QA.choices").alias("choices"), F.col("r.QA.target_step_id").alias("target_steps"),
    )


def trajectory_steps(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """branch, tid, step, text, time: the messages of trajectories, which files hold by branch."""
    files = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", f"map<string, array<{TRAJECTORY}>>")).alias("branch", "rows"))
    one = files.select("branch", F.explode("rows").alias("r")).select("branch", "r.tid", F.posexplode("r.message_list").alias("step", "m"))
    user, agent = F.coalesce("m.user_message", "m.user"), F.coalesce("m.assistant_message", "m.assistant", "m.agent")
    both = F.concat_ws("\n", F.concat(F.lit("user: "), user), F.concat(F.lit("assistant: "), agent))
    return one.select("branch", "tid", "step", F.when(both != "", both).otherwise(F.col("m.message")).alias("text"), F.col("m.time").alias("time"))


def gold_sessions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """question_id, question, answer, question_type, session_id, turn, role, content, has_answer; duplicate question ids raise when run."""
    rows = json_array(spark, path, GOLD, lines)
    counted = rows.groupBy("question_id").agg(F.count("*").alias("n"), F.first(F.struct(*[c for c in rows.columns if c != "question_id"])).alias("r"))
    checked = counted.select(
        F.when(F.col("n") == 1, F.col("question_id")).otherwise(F.raise_error(F.concat(F.lit("duplicate question_id "), "question_id")).cast("string")).alias("question_id"), "r.*"
    )
    sessions = checked.select(
        "question_id", "question", "answer", "question_type", F.posexplode("haystack_sessions").alias("s", "session"), "haystack_session_ids"
    )
    turns = sessions.select("question_id", "question", "answer", "question_type", F.get("haystack_session_ids", F.col("s")).alias("session_id"), F.posexplode("session").alias("turn", "t"))
    return turns.select("question_id", "question", "answer", "question_type", "session_id", "turn", "t.role", "t.content", "t.has_answer")


def open_queries(asked: DataFrame, results: DataFrame, retry_failed: bool = False) -> DataFrame:
    """What a resumed run still has to ask: queries (query_id, ...) without a result; failed results count as one unless they are to be tried again."""
    done = results.where("status <> 'failed'") if retry_failed else results
    return asked.join(done.select("query_id").distinct(), "query_id", "left_anti")


def result_rows(spark: SparkSession, path: str, metrics: tuple[str, ...] = ("exact_match", "f1")) -> DataFrame:
    """Rows of result documents with stated metric columns; failed rows stay and are marked by their status."""
    kinds = ", ".join(f"{m}: double" for m in metrics)
    row = f"struct<query_id: long, qa_pair_id: string, output: string, answer: string, status: string, {kinds}>"
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", f"data array<{row}>").alias("d"))
    return files.select(F.explode("d.data").alias("r")).select("r.*").withColumn("status", F.coalesce("status", F.lit("completed")))


def retrieval_debug(spark: SparkSession, path: str) -> DataFrame:
    """query_id, context_id, rank, paragraph of files named query_<q>_context_<c>.json; a null or missing list gives no rows."""
    files = spark.read.format("text").option("wholetext", True).load(path).select("value", F.input_file_name().alias("file"))
    ids = [F.regexp_extract("file", r"query_(\d+)_context_(\d+)\.json$", i).try_cast("long") for i in (1, 2)]
    found = F.coalesce(*(F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>") for k in ("retrieved_context_paragraphs", "retrieval_context")))
    return files.select(ids[0].alias("query_id"), ids[1].alias("context_id"), F.posexplode(found).alias("rank", "paragraph")).withColumn("rank", F.col("rank") + 1)


def write_rows(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Writes a table as parquet, json, orc or csv, replacing what is there; partitioned by stated columns."""
    if kind not in ("parquet", "json", "orc", "csv"):
        raise ValueError(f"unknown kind {kind!r}")
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*by) if by else writer).save(path)
