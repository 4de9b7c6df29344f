"""Queries that project, look up and match rows of conversations and their results, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import cleanup as C
from lodestrata.functions import filters, scoring
from lodestrata.functions import text as T
from lodestrata.operators import retrieval as R
from lodestrata.plans.retrieval_queries import _COS, _dense
from lodestrata.plans.table_queries import _events
from lodestrata.session import rounded, table


def sample_projection(spark, sf_dir):
    """Conversations as wide rows: arrays of questions, of answers padded to as many, and an id for each question that falls back to its place."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    side = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.md5("text").alias("m"))))), lambda x: x["m"])
    wide = c.groupBy("conv_id").agg(side("user").alias("q"), side("assistant").alias("a"))
    n = F.greatest(F.size("q"), F.size("a"))
    padded = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.coalesce(F.get("q", i), F.lit("")).alias("q"), F.coalesce(F.get("a", i), F.lit("")).alias("a"), F.concat_ws("_", F.col("conv_id").cast("string"), (i + 1).cast("string")).alias("id")))
    rows = wide.where(n > 0).select("conv_id", F.explode(padded).alias("x"))
    return rows.select("conv_id", F.col("x.id").alias("qa_id"), F.col("x.q").alias("question_md5"), F.col("x.a").alias("answer_md5"))


PROJECTION = """
WITH w AS (SELECT conv_id, coalesce(list(md5(text) ORDER BY turn) FILTER (role = 'user'), []) AS q, coalesce(list(md5(text) ORDER BY turn) FILTER (role = 'assistant'), []) AS a FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT conv_id, conv_id || '_' || i AS qa_id, coalesce(q[i], '') AS question_md5, coalesce(a[i], '') AS answer_md5 FROM (SELECT *, unnest(range(1, greatest(len(q), len(a)) + 1)) AS i FROM w)"""


def debug_query_join(spark, sf_dir):
    """Debug rows (turn, conversation) joined to queries by both numbers, else by a query number that only one query has; others find none."""
    q = table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select(F.col("turn").alias("query_id"), F.col("conv_id").alias("context_id"))
    d = table(spark, sf_dir, "conversations").select(F.col("turn").alias("query_id"), F.col("conv_id").alias("context_id"))
    only = q.groupBy("query_id").agg(F.count("*").alias("n"), F.min("context_id").alias("only_context")).where("n = 1")
    exact = d.join(q.withColumn("exact", F.lit(True)), ["query_id", "context_id"], "left").join(only, "query_id", "left")
    way = F.when(F.col("exact"), "both").when(F.col("only_context").isNotNull(), "query").otherwise("none")
    return exact.groupBy(way.alias("way")).agg(F.count("*").alias("n"))


DEBUG = """
WITH q AS (SELECT turn AS query_id, conv_id AS context_id FROM conversations WHERE conv_id % 2 = 0), o AS (SELECT query_id FROM q GROUP BY query_id HAVING count(*) = 1)
SELECT CASE WHEN q.query_id IS NOT NULL THEN 'both' WHEN o.query_id IS NOT NULL THEN 'query' ELSE 'none' END AS way, count(*) AS n
FROM conversations AS d LEFT JOIN q ON q.query_id = d.turn AND q.context_id = d.conv_id LEFT JOIN o ON o.query_id = d.turn GROUP BY 1"""


def provenance_lookup(spark, sf_dir):
    """Sources of stored texts: by memory id where one is known, else from the header, else by the normalised text."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    n = (F.col("conv_id") + F.col("turn")) % 3
    header = T.provenance_header(F.col("conv_id"), F.col("turn"))
    stored = c.select("conv_id", "turn", F.when(n == 0, F.concat_ws("-", "conv_id", "turn")).alias("memory_id"), F.when(n == 1, F.concat(header, F.lit("\n"), "text")).otherwise(F.concat(F.lit("  "), F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("stored"))
    known = c.where(n == 0).select(F.concat_ws("-", "conv_id", "turn").alias("memory_id"), F.concat_ws(":", "conv_id", "turn").alias("by_id"))
    key = F.md5(C.matching_form(F.col("text")))
    texts = c.groupBy(key.alias("key")).agg(F.min(F.concat_ws(":", "conv_id", "turn")).alias("by_text"))
    found = stored.join(known, "memory_id", "left").withColumn("key", F.md5(C.matching_form(F.col("stored")))).join(texts, "key", "left")
    return found.select("conv_id", "turn", F.coalesce("by_id", T.header_id(F.col("stored")), "by_text").alias("source_id"))


PROVENANCE = r"""
WITH c AS (SELECT *, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g'), '[\x20]+([,.;:!?])', '\1', 'g')) AS k FROM conversations WHERE text IS NOT NULL), t AS (SELECT k, min(conv_id || ':' || turn) AS by_text FROM c GROUP BY k)
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 < 2 THEN conv_id || ':' || turn ELSE by_text END AS source_id FROM c JOIN t USING (k)"""


def reverse_candidates(spark, sf_dir):
    """For each vector the asked ones that hold it among their ten nearest with a cosine of 0.35 at least."""
    near = _dense(spark, sf_dir, 10).where("score >= 0.35")
    return near.groupBy("vec_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("query_id")), lambda x: x.cast("string")), ",").alias("held_by"))


REVERSE = f"WITH {_COS} SELECT vec_id, count(*) AS n, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS held_by FROM knn WHERE rank <= 10 AND score >= 0.35 GROUP BY vec_id"


def key_or_two_tags(spark, sf_dir):
    """Users with key 7 in any event, or at least two of three kinds of events with a value above 120."""
    e = _events(spark, sf_dir)
    k = F.get_json_object("props", "$.k") == "7"
    tags = F.countDistinct(F.when(F.col("event_type").isin("signup", "error", "view") & (F.col("value") > 120), F.col("event_type")))
    return e.groupBy("user_id").agg(F.max(F.coalesce(k, F.lit(False))).alias("has_key"), tags.alias("n_tags")).where("has_key or n_tags >= 2")


TWO_TAGS = """SELECT user_id, bool_or(coalesce(json_extract_string(props, '$.k') = '7', false)) AS has_key, count(DISTINCT event_type) FILTER (event_type IN ('signup', 'error', 'view') AND value > 120) AS n_tags FROM events GROUP BY user_id HAVING has_key OR n_tags >= 2"""


def message_filters(spark, sf_dir):
    """Messages of two roles that hold a phrase in any case, after a cursor in each conversation, oldest first, five of each."""
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant") & (F.col("turn") > 1) & F.contains(T.ascii_lower(F.col("text")), F.lit(" the")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("conv_id", "turn", "place")


MESSAGES = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role IN ('user', 'assistant') AND turn > 1 AND contains(lower(text), ' the') QUALIFY place <= 5"


def label_candidates(spark, sf_dir):
    """What of an output may name its label: its last five lines from the end, their first sentences, the first line, and the whole if it is short; each once."""
    t = F.col("text")
    lines = T.lines(t)
    last = F.reverse(F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), 5))
    whole = F.when(F.length(t) <= 80, F.array(t)).otherwise(F.array().cast("array<string>"))
    every = F.concat(last, F.transform(last, scoring.first_sentence), F.slice(lines, 1, 1), whole)
    found = F.array_distinct(F.filter(every, lambda x: x != ""))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "|")).alias("candidates_md5"))


_SENT = r"regexp_replace(string_split(regexp_replace(x, '([.!?。！？])[\x20\x09-\x0D]+|\n+', '\1' || chr(1), 'g'), chr(1))[1], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
CANDIDATES = r"""
WITH l AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS ls FROM conversations WHERE text IS NOT NULL),
r AS (SELECT conv_id, turn, text, ls, list_reverse(list_slice(ls, greatest(len(ls) - 4, 1), len(ls))) AS la FROM l),
e AS (SELECT conv_id, turn, list_filter(list_concat(list_concat(la, list_transform(la, lambda x: """ + _SENT + r""")), list_concat(list_slice(ls, 1, 1), CASE WHEN length(text) <= 80 THEN [text] ELSE [] END)), lambda x: x <> '') AS xs FROM r),
d AS (SELECT conv_id, turn, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS xs FROM e) SELECT conv_id, turn, CAST(len(xs) AS BIGINT) AS n, md5(array_to_string(xs, '|')) AS candidates_md5 FROM d"""


def corpus_ids(spark, sf_dir):
    """Ids of sessions and turns in a corpus: "answer" becomes "noans" in a session none of whose user turns has one, and in turns without one; the type of a question by its id."""
    c = table(spark, sf_dir, "conversations").withColumn("has", (F.col("role") == "user") & (F.col("turn") % 4 == 0) & (F.col("conv_id") % 3 > 0))
    raw = F.concat(F.lit("answer_"), "conv_id")
    session = F.when(F.max("has").over(Window.partitionBy("conv_id")), raw).otherwise(F.replace(raw, F.lit("answer"), F.lit("noans")))
    turn = F.concat_ws("_", F.when(F.col("has"), raw).otherwise(F.replace(raw, F.lit("answer"), F.lit("noans"))), F.col("turn").cast("string"))
    asked = F.concat(F.lit("q"), "conv_id", F.when(F.col("conv_id") % 5 == 0, "_abs").otherwise(""))
    return c.select("conv_id", "turn", session.alias("session_id"), turn.alias("turn_id"), F.when(asked.endswith("_abs"), "abstention").otherwise("single-session").alias("kind"))


CORPUS = """
WITH c AS (SELECT conv_id, turn, role = 'user' AND turn % 4 = 0 AND conv_id % 3 > 0 AS has FROM conversations)
SELECT conv_id, turn, CASE WHEN bool_or(has) OVER (PARTITION BY conv_id) THEN 'answer_' ELSE 'noans_' END || conv_id AS session_id, CASE WHEN has THEN 'answer_' ELSE 'noans_' END || conv_id || '_' || turn AS turn_id,
  CASE WHEN conv_id % 5 = 0 THEN 'abstention' ELSE 'single-session' END AS kind FROM c"""


def query_extraction(spark, sf_dir):
    """What of a message is asked: after the question cue, else after the conversation cue, else all of it."""
    n = F.col("turn") % 3
    message = F.when(n == 0, F.concat(F.lit("Intro\nNow Answer the Question: "), "text")).when(n == 1, F.concat(F.lit("Here is the conversation:\n"), "text")).otherwise(F.col("text"))
    asked = F.coalesce(scoring.found(message, r"(?s)Now Answer the Question:(.*)$"), scoring.found(message, r"(?s)Here is the conversation:(.*)$"), message)
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.md5(scoring.trimmed(asked)).alias("asked_md5"))


ASKED = r"SELECT conv_id, turn, md5(regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS asked_md5 FROM conversations WHERE text IS NOT NULL"


def question_index(spark, sf_dir):
    """Records by question id: blank ids are skipped, and of repeated ids the last record counts."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("q"), F.col("doc_id") % 37)).otherwise(" ").alias("question_id"), "doc_id", "lang")
    return d.where(F.trim("question_id") != "").groupBy("question_id").agg(F.max_by(F.struct("doc_id", "lang"), "doc_id").alias("x")).select("question_id", "x.doc_id", "x.lang")


INDEX = "SELECT 'q' || doc_id % 37 AS question_id, doc_id, lang FROM documents WHERE doc_id % 4 > 0 QUALIFY row_number() OVER (PARTITION BY doc_id % 37 ORDER BY doc_id DESC) = 1"


def agents_matching_tags(spark, sf_dir):
    """Users that have all of two kinds of events and any of two more, each with how often it has those of the second group."""
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("tags"), F.count_if(F.col("event_type").isin("error", "signup")).alias("n"))
    return e.where(filters.tags_all(F.col("tags"), ["click", "view"]) & filters.tags_any(F.col("tags"), ["error", "signup"])).select("user_id", "n")


AGENTS = "SELECT user_id, count(*) FILTER (event_type IN ('error', 'signup')) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) = 2 AND n > 0"


def pooled_recall(spark, sf_dir):
    """Mean recall of the ten nearest over all asked vectors whose gold is the vectors of their label among the first hundred ids; empty gold counts as 0."""
    v = table(spark, sf_dir, "embeddings").where("vec_id < 100").select(F.col("vec_id").alias("id"), "label")
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = asked.join(v, "label").where("id <> query_id").select("query_id", "id")
    found = _dense(spark, sf_dir, 10).select("query_id", F.col("vec_id").alias("id"), "rank")
    per = R.strict_recall(found, gold)
    return asked.join(per, "query_id", "left").agg(F.count("*").alias("n"), *(rounded(F.avg(F.coalesce(f"recall_at_{k}", F.lit(0.0))), 4).alias(f"recall_at_{k}") for k in (1, 5, 10)))


_HIT = "round(avg(coalesce((SELECT avg(CASE WHEN knn.rank <= {0} THEN 1.0 ELSE 0.0 END) FROM g LEFT JOIN knn ON knn.query_id = g.query_id AND knn.vec_id = g.id AND knn.rank <= 10 WHERE g.query_id = a.query_id), 0)), 4)::DOUBLE AS recall_at_{0}"
POOLED = f"""WITH {_COS}, a AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 50 = 0), g AS (SELECT a.query_id, v.vec_id AS id FROM a JOIN embeddings AS v ON v.label = a.label AND v.vec_id < 100 AND v.vec_id <> a.query_id)
SELECT count(*) AS n, {_HIT.format(1)}, {_HIT.format(5)}, {_HIT.format(10)} FROM a"""

QUERIES = {
    "sample_projection": (sample_projection, PROJECTION), "debug_query_join": (debug_query_join, DEBUG), "provenance_lookup": (provenance_lookup, PROVENANCE),
    "reverse_candidates": (reverse_candidates, REVERSE), "key_or_two_tags": (key_or_two_tags, TWO_TAGS), "message_filters": (message_filters, MESSAGES),
    "label_candidates": (label_candidates, CANDIDATES), "corpus_ids": (corpus_ids, CORPUS), "query_extraction": (query_extraction, ASKED), "question_index": (question_index, INDEX),
    "agents_matching_tags": (agents_matching_tags, AGENTS), "pooled_recall": (pooled_recall, POOLED),
}
