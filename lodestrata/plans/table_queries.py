"""Queries over events, results and graphs, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import filters
from lodestrata.operators import graph as G
from lodestrata.operators import memory as M
from lodestrata.session import rounded, table


def _events(spark, sf_dir):
    """Events with instants; the tables hold times without a zone, which are UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def changelog_last_wins(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value")
    return M.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", rounded(F.col("value")).alias("value"))


LAST = """SELECT user_id, event_type, event_id, round(value, 6)::DOUBLE AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


def soft_delete_view(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    return M.alive(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


ALIVE = """SELECT user_id, event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'"""


def retention_keep_latest_n(spark, sf_dir):
    return M.keep_latest(_events(spark, sf_dir), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id", "place")


RETAIN = """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 5"""


def ema_feedback_fold(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "ts", "event_id", (1 + F.col("event_id") % 5).cast("double").alias("score"))
    scores = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "score"))).alias("s"))
    return scores.select("user_id", "day", F.size("s").cast("long").alias("n"), M.feedback(F.transform("s", lambda x: x["score"])).alias("weight"))


EMA = """
WITH RECURSIVE e AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(1 + event_id % 5 AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, day, n, floor(greatest(0, least(1, 0.5::DOUBLE + 0.1::DOUBLE * ((score - 1) / 4 - 0.5::DOUBLE))) * 1000000::DOUBLE + 0.5000001::DOUBLE) / 1000000::DOUBLE AS weight FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.day, e.n, floor(greatest(0, least(1, r.weight + 0.1::DOUBLE * ((e.score - 1) / 4 - r.weight))) * 1000000::DOUBLE + 0.5000001::DOUBLE) / 1000000::DOUBLE
  FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day AND e.n = r.n + 1)
SELECT user_id, day, n, weight FROM r QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC) = 1"""


def time_decay_heat(spark, sf_dir):
    e = _events(spark, sf_dir)
    age = F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp("ts")
    found = e.groupBy("user_id").agg(F.count("*").alias("visits"), F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"), F.min(age).alias("age"))
    return found.select("user_id", rounded(M.heat(F.col("visits"), F.col("clicks"), M.decayed(F.col("age"), 86400.0))).alias("heat"))


HEAT = """
SELECT user_id, round(count(*) * 0.8 + count(*) FILTER (event_type = 'click') * 0.8
  + exp(-min(CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) / 86400.0) * 0.0001, 6)::DOUBLE AS heat FROM events GROUP BY user_id"""


def filter_dsl_and_or(spark, sf_dir):
    spec = {"or": [{"event_type": ["click", "view"], "value": {"gte": 50.0}}, {"and": [{"event_type": "purchase"}, {"ts": {"lt": "2024-01-10"}}]}]}
    return _events(spark, sf_dir).where(filters.condition(spec)).select("event_id", "event_type")


DSL = """SELECT event_id, event_type FROM events WHERE (event_type IN ('click', 'view') AND value >= 50.0) OR (event_type = 'purchase' AND ts < TIMESTAMP '2024-01-10')"""


def payload_filter(spark, sf_dir):
    payload = F.from_json("props", "map<string,string>")
    return _events(spark, sf_dir).where(filters.payload_matches(payload, {"k": [7, 21, 42]})).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


PAYLOAD = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IN ('7', '21', '42')"""


def tags_any_all(spark, sf_dir):
    tags = _events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return tags.select("user_id", filters.tags_any(F.col("tags"), ["signup", "error"]).alias("has_any"), filters.tags_all(F.col("tags"), ["signup", "error", "purchase"]).alias("has_all"))


TAGS = """SELECT user_id, bool_or(event_type IN ('signup', 'error')) AS has_any, count(DISTINCT event_type) FILTER (event_type IN ('signup', 'error', 'purchase')) = 3 AS has_all FROM events GROUP BY user_id"""


def json_props_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _events(spark, sf_dir).groupBy(F.coalesce(k % 10, F.lit(-1).cast("long")).alias("bucket")).agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))


PROPS = """SELECT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 10, -1) AS bucket, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1"""


def evenly_spaced_sample(spark, sf_dir):
    return M.evenly_spaced(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey", "place")


SPACED = """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(place AS BIGINT) AS place FROM o WHERE n <= 100 OR place IN (SELECT CAST(floor(i * n / 100) AS BIGINT) FROM range(100) AS r(i), (SELECT count(*) AS n FROM orders))"""


def stride_sample(spark, sf_dir):
    return M.global_places(table(spark, sf_dir, "orders"), "o_orderkey").where("place % 50 = 0").select("o_orderkey", "place")


STRIDE = """SELECT o_orderkey, CAST(place AS BIGINT) AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place % 50 = 0"""


def keyset_page(spark, sf_dir):
    """The page of 25 orders after the first of the busiest day, by date and key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    day = o.groupBy("o_orderdate").count().orderBy(F.desc("count"), "o_orderdate").limit(1)
    cursor = o.join(F.broadcast(day), "o_orderdate").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("c"))
    after = o.join(F.broadcast(cursor), F.struct("o_orderdate", "o_orderkey") > F.col("c"))
    return after.orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


PAGE = """
WITH d AS (SELECT o_orderdate FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_orderdate LIMIT 1),
c AS (SELECT o_orderdate AS cd, min(o_orderkey) AS ck FROM orders WHERE o_orderdate IN (SELECT o_orderdate FROM d) GROUP BY 1)
SELECT o_orderkey, o_orderdate FROM orders, c WHERE o_orderdate > cd OR (o_orderdate = cd AND o_orderkey > ck) ORDER BY o_orderdate, o_orderkey LIMIT 25"""


def metric_rollup_three_levels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return M.rollup_means(d.join(table(spark, sf_dir, "labels"), "doc_id"), ["lang", "source"], ["quality", "toxic"])


ROLLUP = """
SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS n_rows, round(avg(quality), 4)::DOUBLE AS mean_quality, round(avg(toxic), 4)::DOUBLE AS mean_toxic
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)"""


def category_mean_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(F.coalesce("source", F.lit("unknown")).alias("category")).agg(F.count("quality").alias("n"), rounded(F.avg("quality") * 100, 2).alias("mean"))


CATEGORY = """SELECT coalesce(source, 'unknown') AS category, count(quality) AS n, round(avg(quality) * 100, 2)::DOUBLE AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""


def first_per_context_sum(spark, sf_dir):
    firsts = M.first_of_context(_events(spark, sf_dir), "user_id", "event_id", "value")
    return firsts.agg(rounded(F.sum("first_value"), 4).alias("writes"), F.sum("n_rows").alias("reads"), rounded(F.sum("first_value") / F.count("*"), 4).alias("per_context"))


FIRSTS = """
SELECT round(sum(v), 4)::DOUBLE AS writes, CAST(sum(n) AS BIGINT) AS reads, round(sum(v) / count(*), 4)::DOUBLE AS per_context
FROM (SELECT user_id, min_by(value, event_id) AS v, count(*) AS n FROM events GROUP BY user_id)"""


def macro_average_missing_zero(spark, sf_dir):
    """Mean value of each event type over all users; a user without the type counts as 0."""
    e = _events(spark, sf_dir)
    users = e.agg(F.countDistinct("user_id").alias("users"))
    means = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("m")).groupBy("event_type").agg(F.sum("m").alias("total"))
    joined = means.withColumn("one", F.lit(1)).join(F.broadcast(users.withColumn("one", F.lit(1))), "one")
    return joined.select("event_type", rounded(F.col("total") / F.col("users"), 4).alias("macro_mean"))


MACRO = """
SELECT event_type, round(sum(m) / (SELECT count(DISTINCT user_id) FROM events), 4)::DOUBLE AS macro_mean
FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type"""


def judge_summary_std(spark, sf_dir):
    """Labels as five runs of a judge: accuracy by run, its mean and population deviation by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    runs = d.groupBy("lang", (F.col("doc_id") % 5).alias("run")).agg(F.avg("quality").alias("accuracy"))
    return runs.groupBy("lang").agg(F.count("*").alias("n_runs"), rounded(F.avg("accuracy"), 4).alias("mean_accuracy"), rounded(F.stddev_pop("accuracy"), 4).alias("std_accuracy"))


JUDGE = """
SELECT lang, count(*) AS n_runs, round(avg(a), 4)::DOUBLE AS mean_accuracy, round(stddev_pop(a), 4)::DOUBLE AS std_accuracy
FROM (SELECT lang, doc_id % 5 AS run, avg(quality) AS a FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY lang"""


def event_sessionize(spark, sf_dir):
    e = _events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    numbered = e.withColumn("opens", F.coalesce((gap > 6 * 3600 * 1_000_000).cast("long"), F.lit(0))).withColumn("session", F.sum("opens").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_event"))


SESSIONS = """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 4)::DOUBLE AS total, min(event_id) AS first_event FROM s GROUP BY user_id, session"""


def tumbling_counts(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "event_type", "n")


TUMBLING = """SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"""


def trailing_rate(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return _events(spark, sf_dir).select("event_id", F.count("*").over(w).alias("in_last_hour"))


TRAILING = """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_last_hour FROM events"""


def time_gap_buckets(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    label = F.when(gap.isNull(), "first").when(gap < 3_600_000_000, "hour").when(gap < 86_400_000_000, "day").otherwise("longer")
    return _events(spark, sf_dir).select(label.alias("gap")).groupBy("gap").agg(F.count("*").alias("n"))


GAPS = """
SELECT CASE WHEN g IS NULL THEN 'first' WHEN g < 3600000000 THEN 'hour' WHEN g < 86400000000 THEN 'day' ELSE 'longer' END AS gap, count(*) AS n
FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) GROUP BY 1"""


def sequence_local_maxima(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = _events(spark, sf_dir).select("user_id", "event_id", "value", F.lag("value").over(w).alias("b"), F.lead("value").over(w).alias("a"))
    return v.where("value > b and value > a").select("user_id", "event_id")


MAXIMA = """SELECT user_id, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY value > lag(value) OVER w AND value > lead(value) OVER w"""


def session_offset_timestamps(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.lit(1_704_067_200_000) + F.col("conv_id") * 86_400_000 + n * 500).cast("long").alias("at_ms"))


OFFSETS = """SELECT conv_id, turn, CAST(1704067200000 + conv_id * 86400000 + (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 500 AS BIGINT) AS at_ms FROM conversations"""


def quota_top_k(spark, sf_dir):
    """Of each source its two longest documents per language."""
    w = Window.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 2").select("source", "lang", "doc_id", "place")


QUOTA = """SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 2"""


def _trade(spark, sf_dir):
    """Customers linked to the suppliers of what they ordered."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return lines.join(o, "o_orderkey").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


_TRADE = "WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def graph_degrees(spark, sf_dir):
    return G.degrees(_trade(spark, sf_dir))


DEGREES = f"""{_TRADE} SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, count(*) AS degree
FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node"""


def graph_metrics(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node")).union(
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    )
    return G.metrics(_trade(spark, sf_dir), nodes)


METRICS = f"""{_TRADE}, v AS (SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier),
a AS (SELECT count(*) AS n, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM e WHERE src = dst) AS loops,
  count(*) FILTER (node NOT IN (SELECT src FROM e UNION SELECT dst FROM e)) AS alone FROM v)
SELECT n AS n_nodes, m AS n_edges, round(2 * m / n, 6)::DOUBLE AS mean_degree, round(m / (n * (n - 1)), 6)::DOUBLE AS density, loops AS n_loops, alone AS n_isolated FROM a"""


def graph_k_hop(spark, sf_dir):
    """Nations, customers and regions within two steps of the first region."""
    n = table(spark, sf_dir, "nation")
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")).union(
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"))
    )
    return G.hops(edges, spark.createDataFrame([("r0",)], "node string"), 3)


HOPS = """
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT 'r0' AS node, CAST(0 AS BIGINT) AS hop UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.node WHERE r.hop < 3)
SELECT node, min(hop) AS hop FROM r GROUP BY node"""


def tree_rollup(spark, sf_dir):
    """Customers and balances of each region and nation of the tree, from the leaves up."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).join(c, "n_nationkey", "left")
    return n.rollup("r_name", "n_name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_customers"), rounded(F.sum(F.coalesce("total", F.lit(0.0))), 2).alias("balance"))


TREE = """
SELECT r_name, n_name, CAST(count(c_custkey) AS BIGINT) AS n_customers, round(coalesce(sum(c_acctbal), 0), 2)::DOUBLE AS balance
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)"""


def left_join_isolated(spark, sf_dir):
    """Customers that no urgent order of the last years links to anything."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate >= '1997-01-01'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


ISOLATED = """SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1997-01-01') ON o_custkey = c_custkey WHERE o_custkey IS NULL"""


def personal_rank_fixed_rounds(spark, sf_dir):
    """Ranks of customers and suppliers from a reset on the suppliers of the first nation: all nodes reached in twenty rounds.

    Scores have six significant digits, as they sum to 1 and so grow smaller with the graph.
    """
    trade = _trade(spark, sf_dir).withColumn("weight", F.lit(1.0))
    reset = table(spark, sf_dir, "supplier").where("s_nationkey = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(1.0).alias("r"))
    return G.personal_rank(trade, reset, 0.5, 20).select("node", F.format_string("%.5e", F.col("score")).alias("score"))


_ROUND = """x{1} AS (SELECT coalesce(r.node, m.dst) AS node, coalesce(r, 0) * 0.5 + coalesce(s, 0) * 0.5 AS score FROM r FULL JOIN
 (SELECT dst, sum(share * score) AS s FROM l JOIN x{0} ON l.src = x{0}.node GROUP BY dst) AS m ON r.node = m.dst)"""
RANK = f"""{_TRADE}, w AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
l AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM w),
r AS (SELECT 's' || s_suppkey AS node, 1.0::DOUBLE / count(*) OVER () AS r FROM supplier WHERE s_nationkey = 0),
x0 AS (SELECT node, r AS score FROM r), {', '.join(_ROUND.format(i, i + 1).replace(' AS (', ' AS MATERIALIZED (', 1) for i in range(20))}
SELECT node, format('{{:.5e}}', score) AS score FROM x20"""

QUERIES = {
    "changelog_last_wins": (changelog_last_wins, LAST), "soft_delete_view": (soft_delete_view, ALIVE), "retention_keep_latest_n": (retention_keep_latest_n, RETAIN),
    "ema_feedback_fold": (ema_feedback_fold, EMA), "time_decay_heat": (time_decay_heat, HEAT), "filter_dsl_and_or": (filter_dsl_and_or, DSL),
    "payload_filter": (payload_filter, PAYLOAD), "tags_any_all": (tags_any_all, TAGS), "json_props_extract": (json_props_extract, PROPS),
    "evenly_spaced_sample": (evenly_spaced_sample, SPACED), "stride_sample": (stride_sample, STRIDE), "keyset_page": (keyset_page, PAGE),
    "metric_rollup_three_levels": (metric_rollup_three_levels, ROLLUP), "category_mean_count": (category_mean_count, CATEGORY),
    "first_per_context_sum": (first_per_context_sum, FIRSTS), "macro_average_missing_zero": (macro_average_missing_zero, MACRO),
    "judge_summary_std": (judge_summary_std, JUDGE), "event_sessionize": (event_sessionize, SESSIONS), "tumbling_counts": (tumbling_counts, TUMBLING),
    "trailing_rate": (trailing_rate, TRAILING), "time_gap_buckets": (time_gap_buckets, GAPS), "sequence_local_maxima": (sequence_local_maxima, MAXIMA),
    "session_offset_timestamps": (session_offset_timestamps, OFFSETS), "quota_top_k": (quota_top_k, QUOTA), "graph_degrees": (graph_degrees, DEGREES),
    "graph_metrics": (graph_metrics, METRICS), "graph_k_hop": (graph_k_hop, HOPS), "tree_rollup": (tree_rollup, TREE),
    "left_join_isolated": (left_join_isolated, ISOLATED), "personal_rank_fixed_rounds": (personal_rank_fixed_rounds, RANK),
}
