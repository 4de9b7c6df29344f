"""Queries of joins, sets, windows and ranked lists, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import lists as L
from lodestrata.operators import retrieval as R
from lodestrata.plans.table_queries import _events
from lodestrata.plans.text_queries import _LOWER, _STOP, _TOKENS, _WORDS
from lodestrata.session import rounded, small, table


def question_numbering(spark, sf_dir):
    """Conversations as contexts and turns as their questions: a running id over all, and each context's offset."""
    return L.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


NUMBERING = """
WITH n AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS number FROM conversations)
SELECT conv_id, turn, CAST(number AS BIGINT) AS number, CAST(min(number) OVER (PARTITION BY conv_id) AS BIGINT) AS first_number FROM n"""


def recency_flags(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(w) <= 3).alias("recent"))


RECENCY = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 AS recent FROM conversations"


def linked_page_chain(spark, sf_dir):
    """Pages of a source in order with the pages before and after each, and how long the run of one language is that each page is in."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    w = Window.partitionBy("source").orderBy("doc_id")
    opens = (~F.col("lang").eqNullSafe(F.lag("lang").over(w))).cast("long")
    linked = d.withColumn("prev", F.lag("doc_id").over(w)).withColumn("next", F.lead("doc_id").over(w)).withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    return linked.withColumn("run_length", F.count("*").over(Window.partitionBy("source", "run"))).select("doc_id", "prev", "next", "run_length")


CHAIN = """
WITH l AS (SELECT source, doc_id, lag(doc_id) OVER w AS prev, lead(doc_id) OVER w AS next, CASE WHEN lang IS NOT DISTINCT FROM lag(lang) OVER w AND lag(doc_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS opens
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM l)
SELECT doc_id, prev, next, count(*) OVER (PARTITION BY source, run) AS run_length FROM r"""


def message_page(spark, sf_dir):
    """Of each conversation the second page of three user messages, newest first, before turn 20."""
    c = table(spark, sf_dir, "conversations").where("role = 'user' and turn < 20")
    return L.page(c, "conv_id", "turn", 3, 3, True).select("conv_id", "turn", "place")


MESSAGE_PAGE = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations WHERE role = 'user' AND turn < 20 QUALIFY place BETWEEN 4 AND 6"


def adjacent_cosine_breaks(spark, sf_dir):
    """Where the cosine of adjacent vectors falls below 0.2, and at which threshold up to 0.5 (by 0.05) each label's sequence has a break first."""
    return L.adjacent_breaks(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


BREAKS = """
WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS a, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
s AS (SELECT label, vec_id, round(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-12), 6)::DOUBLE AS score FROM v WHERE b IS NOT NULL)
SELECT label, vec_id, score, score < 0.2 AS breaks, (SELECT min(20 + 5 * i) FROM range(7) AS t(i) WHERE score < (20 + 5 * i) / 100) AS first_percent FROM s"""


def checkpoint_truncate(spark, sf_dir):
    """A user's events as checkpoints: those after the last error go, and the next number follows the one that stays last."""
    e = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = e.withColumn("number", F.row_number().over(w).cast("long"))
    cut = n.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("number"))).alias("cut"), F.max("number").alias("last"))
    return cut.select("user_id", (F.coalesce("cut", "last") + 1).alias("next_number"), (F.col("last") - F.coalesce("cut", "last")).alias("n_dropped"))


TRUNCATE = """
WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events),
c AS (SELECT user_id, max(number) FILTER (event_type = 'error') AS cut, max(number) AS last FROM n GROUP BY user_id) SELECT user_id, coalesce(cut, last) + 1 AS next_number, last - coalesce(cut, last) AS n_dropped FROM c"""


def min_max_plain(spark, sf_dir):
    """Values within the range of their type: a constant type has no number."""
    w = Window.partitionBy("event_type")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return _events(spark, sf_dir).select("event_id", rounded(F.when(high > low, (F.col("value") - low) / (high - low))).alias("scaled"))


MIN_MAX = """
SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6)::DOUBLE AS scaled FROM events WINDOW w AS (PARTITION BY event_type)"""


def _three_lists(spark, sf_dir):
    """Three rankings of documents for each source: by length, by id scrambled, by language and length."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars", "lang")
    orders = ([F.desc("n_chars"), F.col("id")], [F.col("id") * 7919 % 1009, F.col("id")], [F.col("lang"), F.col("n_chars"), F.col("id")])
    return [d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*o)).cast("long")).where("rank <= 15").select("query_id", "id", "rank", "n_chars") for o in orders]


_THREE = """
l0 AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, n_chars FROM documents QUALIFY rank <= 15),
l1 AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1009, doc_id) AS rank, n_chars FROM documents QUALIFY rank <= 15),
l2 AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY lang, n_chars, doc_id) AS rank, n_chars FROM documents QUALIFY rank <= 15),
u AS (SELECT 0 AS list, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2)"""


def rrf_three_lists(spark, sf_dir):
    return R.ranked(R.reciprocal_ranks(*_three_lists(spark, sf_dir)), "query_id", "score", "id", 10).select("query_id", "id", "score", "rank")


RRF3 = f"""WITH {_THREE}, f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 6)::DOUBLE AS score FROM u GROUP BY ALL) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10"""


def round_robin_merge(spark, sf_dir):
    return L.round_robin(*_three_lists(spark, sf_dir), k=12)


ROBIN = f"""WITH {_THREE}, f AS (SELECT query_id, id, rank AS turn, list FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY rank, list) = 1)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY turn, list, id) AS place FROM f QUALIFY place <= 12"""


def order_preserving_merge(spark, sf_dir):
    merged = R.priority_merge(*_three_lists(spark, sf_dir))
    return merged.select("query_id", "id", "rank")


MERGE = f"""WITH {_THREE}, f AS (SELECT query_id, id, list, rank AS list_rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY list, rank) = 1)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY list, list_rank, id) AS rank FROM f"""


def keep_max_union(spark, sf_dir):
    """Union of lists in which the highest score of an id stays, and the last list that names it."""
    return L.best_scores(*(x.withColumn("score", F.col("n_chars") / F.col("rank")) for x in _three_lists(spark, sf_dir)))


KEEP_MAX = f"""WITH {_THREE} SELECT query_id, id, round(max(n_chars / rank), 6)::DOUBLE AS score, CAST(max(list) AS BIGINT) AS last_list FROM u GROUP BY query_id, id"""


def keyword_then_vector(spark, sf_dir):
    """Keyword hits in their order, then vector hits not seen yet; cut at ten."""
    a, b, _ = _three_lists(spark, sf_dir)
    return R.priority_merge(a.where("rank <= 4"), b).where("rank <= 10").select("query_id", "id", "list", "rank")


KEYWORD_VECTOR = f"""WITH {_THREE}, f AS (SELECT query_id, id, list, rank AS list_rank FROM u WHERE (list = 0 AND rank <= 4) OR list = 1 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY list, rank) = 1)
SELECT query_id, id, CAST(list AS BIGINT) AS list, row_number() OVER (PARTITION BY query_id ORDER BY list, list_rank, id) AS rank FROM f QUALIFY rank <= 10"""


def quota_merge_top_k(spark, sf_dir):
    """Of ten places, seven tenths go to documents with a label and the rest to others; either side fills what the other leaves."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return L.quota_merge(d.select("source", "doc_id", "n_chars", F.coalesce("known", F.lit(False)).alias("known")), "source", "known", [F.desc("n_chars"), F.col("doc_id")], 10, 0.7)


QUOTA_MERGE = """
WITH d AS (SELECT source, doc_id, n_chars, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source, known ORDER BY n_chars DESC, doc_id) AS n, count(*) FILTER (known) OVER (PARTITION BY source) AS a, count(*) FILTER (NOT known) OVER (PARTITION BY source) AS b FROM d)
SELECT source, doc_id, known FROM r WHERE n <= CASE WHEN known THEN greatest(7, 10 - b) ELSE greatest(3, 10 - a) END"""


def threshold_then_top_n(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return _events(spark, sf_dir).where("value >= 60").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 8").select("event_type", "event_id", "place")


THRESHOLD = "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events WHERE value >= 60 QUALIFY place <= 8"


def best_response(spark, sf_dir):
    """Of each user's events the best: purchases before all others, then the highest value, then the first."""
    best = F.max_by("event_id", F.struct((F.col("event_type") == "purchase").alias("a"), "value", (-F.col("event_id")).alias("b")))
    return _events(spark, sf_dir).groupBy("user_id").agg(best.alias("event_id"))


BEST = "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, value DESC, event_id) = 1"


def ordered_distinct(spark, sf_dir):
    """Distinct first lines of each role's turns, trimmed, blank ones left out, in the order in which they come first."""
    first = F.regexp_replace(F.substring_index("text", " ", 2), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    c = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", first.alias("value")).where("value <> ''")
    seen = c.groupBy("role", "value").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    return seen.select("role", "value", F.row_number().over(Window.partitionBy("role").orderBy("at", "value")).cast("long").alias("place"))


DISTINCT = r"""
WITH c AS (SELECT role, conv_id, turn, regexp_replace(array_to_string(list_slice(string_split(text, ' '), 1, 2), ' '), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS value FROM conversations),
s AS (SELECT role, value, min((conv_id, turn)) AS pos FROM c WHERE value <> '' GROUP BY ALL) SELECT role, value, row_number() OVER (PARTITION BY role ORDER BY pos, value) AS place FROM s"""


def union_padded(spark, sf_dir):
    """Documents and turns as one table of passages, with nulls where a side has no such column."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang"), F.length("text").cast("long").alias("n"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("agent_id"), F.length("text").cast("long").alias("n"))
    both = d.unionByName(c, allowMissingColumns=True)
    return both.groupBy("lang", F.col("agent_id").isNull().alias("is_source")).agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


PADDED = """
SELECT lang, agent_id IS NULL AS is_source, count(*) AS rows, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, doc_id AS source_id, NULL AS agent_id, length(text) AS n FROM documents
UNION ALL SELECT NULL, NULL, conv_id, length(text) FROM conversations) GROUP BY ALL"""


def unique_facts(spark, sf_dir):
    f = _events(spark, sf_dir).select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k")).distinct()
    return f.groupBy("event_type").agg(F.count("*").alias("n_facts"))


UNIQUE = "SELECT event_type, count(*) AS n_facts FROM (SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1"


def entropy_top_fraction(spark, sf_dir):
    """Of each turn the three tenths of words that are rarest over all turns, in the turn's order."""
    return L.rarest_words(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], T.tokens(F.col("text")), 0.3)


ENTROPY = f"""
WITH w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM (SELECT conv_id, turn, {_TOKENS.format("coalesce(text, '')")} AS ws FROM conversations)),
c AS (SELECT word, count(*) AS uses FROM w GROUP BY word),
k AS (SELECT conv_id, turn, word, pos FROM w JOIN c USING (word) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY uses, pos) <= greatest(1, CAST(floor(n * 3 / 10) AS BIGINT)))
SELECT conv_id, turn, string_agg(word, ' ' ORDER BY pos) AS kept FROM k GROUP BY conv_id, turn"""


def fulltext_any_term(spark, sf_dir):
    """Turns that hold any of three terms, with how many of their words they are; capped per role by that count."""
    terms = ["thion", "and", "the"]
    hits = F.size(F.filter(T.word_tokens(F.col("text")), lambda w: w.isin(*terms)))
    w = Window.partitionBy("role").orderBy(F.desc("hits"), "conv_id", "turn")
    return table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", hits.cast("long").alias("hits")).where("hits > 0").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 20")


FULLTEXT = f"""
SELECT role, conv_id, turn, hits, row_number() OVER (PARTITION BY role ORDER BY hits DESC, conv_id, turn) AS place
FROM (SELECT role, conv_id, turn, CAST(len(list_filter({_WORDS.format("coalesce(text, '')", 1)}, lambda x: x IN ('thion', 'and', 'the'))) AS BIGINT) AS hits FROM conversations) WHERE hits > 0 QUALIFY place <= 20"""


def naive_text_search(spark, sf_dir):
    """Documents that hold a phrase in any case, by how often."""
    low = T.ascii_lower(F.col("text"))
    n = (F.length(low) - F.length(F.replace(low, F.lit("heit "), F.lit("")))) / 5
    return table(spark, sf_dir, "documents").where(F.contains(low, F.lit("heit "))).select("doc_id", n.cast("long").alias("n"))


NAIVE = f"SELECT doc_id, CAST((length(t) - length(replace(t, 'heit ', ''))) / 5 AS BIGINT) AS n FROM (SELECT doc_id, {_LOWER.format('text')} AS t FROM documents) WHERE contains(t, 'heit ')"


def level_weighted_rerank(spark, sf_dir):
    """Candidates by score times the weight of their level; a level without one counts half."""
    weight = F.create_map(*(F.lit(x) for x in ("signup", 1.2, "purchase", 1.0, "click", 0.8)))
    score = F.col("value") * F.coalesce(F.try_element_at(weight, F.col("event_type")), F.lit(0.5))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id")
    return _events(spark, sf_dir).select("user_id", "event_id", rounded(score).alias("score")).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 4")


RERANK = """
SELECT user_id, event_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS place
FROM (SELECT user_id, event_id, round(value * CASE event_type WHEN 'signup' THEN 1.2 WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.8 ELSE 0.5 END, 6)::DOUBLE AS score FROM events) QUALIFY place <= 4"""


def context_question_zip(spark, sf_dir):
    """Questions and answers of a context joined by their place: pairs only where both sides have more than one, else the first question with all answers."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when((F.col("role") == "user") & (F.col("turn") < F.col("conv_id") % 7), F.struct("turn", "text")))).alias("q"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("a"),
    )
    return L.zipped(c, "conv_id", F.transform("q", lambda x: F.md5(x["text"])), F.transform("a", lambda x: F.md5(x["text"])))


ZIP = """
WITH c AS (SELECT conv_id, coalesce(list(md5(text) ORDER BY turn) FILTER (role = 'user' AND turn < conv_id % 7), []) AS q, coalesce(list(md5(text) ORDER BY turn) FILTER (role = 'assistant'), []) AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(i - 1 AS BIGINT) AS place, q[i] AS question, a[i] AS answers FROM (SELECT *, unnest(range(1, least(len(q), len(a)) + 1)) AS i FROM c WHERE len(q) > 1 AND len(a) > 1)
UNION ALL SELECT conv_id, 0, q[1], array_to_string(a, ',') FROM c WHERE len(q) > 0 AND (len(q) <= 1 OR len(a) <= 1)"""


def gold_fallback_join(spark, sf_dir):
    """Results joined to their gold by id, else by text, with how many rows each way found and how many none."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("id"), F.md5("text").alias("key"))
    gold = table(spark, sf_dir, "documents").where("doc_id % 5 > 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("key"), F.col("lang").alias("gold"))
    found = L.fallback_join(d, gold, ["id", "key"], "gold")
    return found.groupBy("way", "gold").agg(F.count("*").alias("n"))


FALLBACK = """
WITH d AS (SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id END AS id, md5(text) AS key FROM documents), g AS (SELECT doc_id AS id, md5(text) AS key, lang AS gold FROM documents WHERE doc_id % 5 > 0),
k AS (SELECT key, min(gold) AS gold FROM g GROUP BY key HAVING count(*) = 1)
SELECT CASE WHEN g.id IS NOT NULL THEN 'id' WHEN k.key IS NOT NULL THEN 'key' END AS way, CASE WHEN g.id IS NOT NULL THEN g.gold ELSE k.gold END AS gold, count(*) AS n
FROM d LEFT JOIN g ON g.id = d.id LEFT JOIN k ON k.key = d.key GROUP BY 1, 2"""


def pending_judge_rows(spark, sf_dir):
    """Documents in a supported language that no complete label judges yet."""
    d = table(spark, sf_dir, "documents").where("lang in ('en', 'de')").select("doc_id", "lang")
    done = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id")
    return d.join(done, "doc_id", "left_anti")


PENDING = "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


def tags_group_having(spark, sf_dir):
    """Users that have all of three kinds of events, by the count of the kinds that each matches, and any of two more."""
    wanted, some = ["click", "view", "purchase"], ["signup", "error"]
    e = _events(spark, sf_dir).select("user_id", "event_type").distinct()
    counted = e.groupBy("user_id").agg(F.count(F.when(F.col("event_type").isin(*wanted), 1)).alias("n_all"), F.count(F.when(F.col("event_type").isin(*some), 1)).alias("n_some"))
    return counted.where(f"n_all = {len(wanted)} and n_some > 0").select("user_id", "n_some")


HAVING = """
SELECT user_id, count(*) FILTER (event_type IN ('signup', 'error')) AS n_some FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id
HAVING count(*) FILTER (event_type IN ('click', 'view', 'purchase')) = 3 AND n_some > 0"""


def exists_in_array(spark, sf_dir):
    """Turns of which any sentence holds a phrase, with the place of the first that does."""
    s = T.sentences(F.col("text"))
    at = F.filter(F.transform(s, lambda x, i: F.when(F.contains(x, F.lit("the ")), i)), lambda i: i.isNotNull())
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(at, F.lit(0)).cast("long").alias("place")).where("place is not null")


EXISTS = r"""
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS s FROM conversations)
SELECT conv_id, turn, CAST(list_position(list_transform(s, lambda x: contains(x, 'the ')), true) - 1 AS BIGINT) AS place FROM s WHERE list_contains(list_transform(s, lambda x: contains(x, 'the ')), true)"""


def bridge_table_join(spark, sf_dir):
    """Parts and the nations of the suppliers that lines link them to."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = small(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"))
    return lines.join(s, "l_suppkey").groupBy("l_partkey").agg(F.countDistinct("s_nationkey").alias("n_nations"), F.count("*").alias("n_suppliers"))


BRIDGE = "SELECT l_partkey, count(DISTINCT s_nationkey) AS n_nations, count(*) AS n_suppliers FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey"


def temporal_knn_prior(spark, sf_dir):
    """For each event the five nearest in value among the user's twenty before it."""
    return L.nearest_before(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_id", "value", 20, 5)


TEMPORAL = """
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.event_id, b.event_id AS other, row_number() OVER (PARTITION BY a.event_id ORDER BY round(abs(a.value - b.value), 6), b.event_id) AS rank
FROM e AS a JOIN e AS b ON a.user_id = b.user_id AND b.n < a.n AND b.n >= a.n - 20 QUALIFY rank <= 5"""


def same_timestamp_expansion(spark, sf_dir):
    """Seed orders of the highest price, and all others of their days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    seeds = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    return o.join(F.broadcast(seeds.select("o_orderdate").distinct()), "o_orderdate", "left_semi").join(F.broadcast(seeds.select("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_orderdate")


SAME_TIME = """
WITH s AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IN (SELECT o_orderdate FROM s) AND o_orderkey NOT IN (SELECT o_orderkey FROM s)"""


def scored_left_join(spark, sf_dir):
    """Documents with the place of their label's score; those without come last."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("s")), "doc_id", "left")
    w = Window.partitionBy("source").orderBy(F.coalesce("s", F.lit(float("inf"))), "doc_id")
    return d.select("doc_id", F.row_number().over(w).cast("long").alias("place"))


SCORED = "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(CAST(quality AS DOUBLE), 'inf'::DOUBLE), doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)"


def keyword_extraction(spark, sf_dir):
    """The three most frequent words of each turn (three letters at least, no stop words); ties to the one that comes first."""
    words = F.filter(T.word_tokens(F.col("text"), 3), lambda w: ~w.isin(*T.STOPWORDS))
    at = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words).alias("at", "word"))
    counts = at.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("n"), "first")).cast("long")
    return counts.withColumn("place", place).where("place <= 3").select("conv_id", "turn", "word", "n", "place")


KEYWORDS = f"""
WITH w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, turn, list_filter({_WORDS.format("coalesce(text, '')", 3)}, lambda x: x NOT IN ({_STOP})) AS ws FROM conversations)),
c AS (SELECT conv_id, turn, word, count(*) AS n, min(pos) AS first FROM w GROUP BY ALL)
SELECT conv_id, turn, word, n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first) AS place FROM c QUALIFY place <= 3"""

QUERIES = {
    "question_numbering": (question_numbering, NUMBERING), "recency_flags": (recency_flags, RECENCY), "linked_page_chain": (linked_page_chain, CHAIN),
    "message_page": (message_page, MESSAGE_PAGE), "adjacent_cosine_breaks": (adjacent_cosine_breaks, BREAKS), "checkpoint_truncate": (checkpoint_truncate, TRUNCATE),
    "min_max_plain": (min_max_plain, MIN_MAX), "rrf_three_lists": (rrf_three_lists, RRF3), "round_robin_merge": (round_robin_merge, ROBIN),
    "order_preserving_merge": (order_preserving_merge, MERGE), "keep_max_union": (keep_max_union, KEEP_MAX), "keyword_then_vector": (keyword_then_vector, KEYWORD_VECTOR),
    "quota_merge_top_k": (quota_merge_top_k, QUOTA_MERGE), "threshold_then_top_n": (threshold_then_top_n, THRESHOLD), "best_response": (best_response, BEST),
    "ordered_distinct": (ordered_distinct, DISTINCT), "union_padded": (union_padded, PADDED), "unique_facts": (unique_facts, UNIQUE),
    "entropy_top_fraction": (entropy_top_fraction, ENTROPY), "fulltext_any_term": (fulltext_any_term, FULLTEXT), "naive_text_search": (naive_text_search, NAIVE),
    "level_weighted_rerank": (level_weighted_rerank, RERANK), "context_question_zip": (context_question_zip, ZIP), "gold_fallback_join": (gold_fallback_join, FALLBACK),
    "pending_judge_rows": (pending_judge_rows, PENDING), "tags_group_having": (tags_group_having, HAVING), "exists_in_array": (exists_in_array, EXISTS),
    "bridge_table_join": (bridge_table_join, BRIDGE), "temporal_knn_prior": (temporal_knn_prior, TEMPORAL), "same_timestamp_expansion": (same_timestamp_expansion, SAME_TIME),
    "scored_left_join": (scored_left_join, SCORED), "keyword_extraction": (keyword_extraction, KEYWORDS),
}
