"""Queries of time expressions, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import time_words as W
from lodestrata.session import table, written

#: What is asked of each event in turn, and the same in SQL at the day d.
ASKED = (
    ("yesterday", "d - 1"), ("3 days ago", "d - 3"), ("last week", "d - 7"), ("two weeks ago", "d - 14"), ("2 months ago", "CAST(d - INTERVAL 2 MONTH AS DATE)"),
    ("next year", "CAST(d + INTERVAL 1 YEAR AS DATE)"), ("March 5, 2023", "DATE '2023-03-05'"), ("soon", "CAST(NULL AS DATE)"), ("2024-01-15", "DATE '2024-01-15'"),
    ("last friday", "d - CAST(CASE WHEN isodow(d) > 5 THEN isodow(d) - 5 ELSE isodow(d) + 2 END AS INTEGER)"),
    ("December 24", "CASE WHEN month(d) = 12 AND day(d) >= 24 THEN make_date(year(d), 12, 24) ELSE make_date(year(d) - 1, 12, 24) END"),
)


def time_expressions(spark, sf_dir):
    """Which events lie in the range that an expression means at the time of each user's last event, counted for each user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("now"))
    asked = F.explode(F.array(*(F.lit(x) for x, _ in ASKED))).alias("expression")
    ranges = last.select("user_id", "now", asked).select("user_id", "expression", W.time_range(F.col("expression"), F.col("now")).alias("r")).select("user_id", "expression", "r.start", "r.end")
    ranges = written(ranges, "ranges")
    met = ranges.join(e, (ranges.user_id == e.user_id) & e.ts.between(F.col("start"), F.col("end")), "left")
    found = met.groupBy(ranges.user_id, "expression", "start", "end").agg(F.count("event_id").alias("n"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("user_id", "expression", text("start"), text("end"), "n")


EXPRESSIONS = f"""
WITH u AS (SELECT user_id, CAST(max(ts) AS DATE) AS d FROM events GROUP BY user_id),
a AS ({' UNION ALL '.join(f"SELECT user_id, '{x}' AS expression, {sql} AS day FROM u" for x, sql in ASKED)}),
r AS (SELECT user_id, expression, CAST(day - CASE WHEN contains(expression, 'week') THEN 7 ELSE 0 END AS TIMESTAMP) AS s, CAST(day + CASE WHEN contains(expression, 'week') THEN 8 ELSE 1 END AS TIMESTAMP) - INTERVAL 1 SECOND AS t FROM a)
SELECT r.user_id, expression, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(t, '%Y-%m-%d %H:%M:%S') AS "end", count(e.event_id) AS n
FROM r LEFT JOIN events AS e ON e.user_id = r.user_id AND e.ts BETWEEN s AND t GROUP BY r.user_id, expression, s, t"""

QUERIES = {"time_expressions": (time_expressions, EXPRESSIONS)}
