"""Queries of message buffers, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.session import table
from lodestrata.streaming import buffers as B

LIMITS = B.Limits(max_messages=12, max_tokens=400, gap=6 * 3600)


def buffer_cells(spark, sf_dir):
    """Each user's events in cells of at most 12, of 400 tokens (the whole part of half the value) and without gaps of over six hours."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.abs("value") / 2).cast("long").alias("tokens"))
    return B.message_cells(e, LIMITS)


CELLS = """
WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS u, CAST(floor(abs(coalesce(value, 0)) / 2) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
f AS (SELECT key, k, u AS start, u AS last_u, CAST(1 AS BIGINT) AS n, t AS tokens, id AS first_id FROM e WHERE k = 1 UNION ALL
  SELECT e.key, e.k, CASE WHEN f.n >= 12 OR f.tokens + t > 400 OR u - f.last_u > 21600000000 THEN u ELSE f.start END, u, CASE WHEN f.n >= 12 OR f.tokens + t > 400 OR u - f.last_u > 21600000000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n >= 12 OR f.tokens + t > 400 OR u - f.last_u > 21600000000 THEN t ELSE f.tokens + t END, CASE WHEN f.n >= 12 OR f.tokens + t > 400 OR u - f.last_u > 21600000000 THEN id ELSE f.first_id END
  FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1)
SELECT key, max_by(start, n) AS start, max(last_u) AS "end", max(n) AS n, max_by(tokens, n) AS tokens, first_id FROM f GROUP BY key, first_id"""

QUERIES = {"buffer_cells": (buffer_cells, CELLS)}
