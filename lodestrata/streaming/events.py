"""Streaming forms of the event operators: the same functions as in batch, with watermarks where state must end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.operators.memory import last_wins
from lodestrata.sources.files import paths

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n; rows later than the watermark are dropped by design in a stream, never in batch."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, n, total of runs of events without a longer gap."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.unix_seconds(F.col("w.start")).alias("session_start"), "n", "total")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without repeats of an id that come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total, last = state.get if state.exists else (0, 0.0, -1)
    for batch in batches:
        n, total = n + len(batch), total + float(batch.value.sum())
        last = max(last, int(batch.event_id.max()))
    state.update((n, total, last))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "last_event": [last]})


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total, last_event after each micro-batch; a user's state is three numbers."""
    return events.groupBy("user_id").applyInPandasWithState(
        _add, "user_id long, n long, total double, last_event long", "n long, total double, last_event long", "update", GroupStateTimeout.NoTimeout
    )


def latest_version(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The table as the last micro-batch (before a number) left it; None where there is none."""
    numbers = sorted(int(p.rsplit("=", 1)[1]) for p in paths(spark, [f"{folder}/version=*"]))
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{folder}/version={numbers[-1]}") if numbers else None


def upsert_rows(rows: DataFrame, key: list[str], order: list[str], folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Keeps a table of the last row of each key: each micro-batch merges into the version before it and writes the next one.

    A batch that is repeated after a failure merges into the same version again and replaces its own, so every row counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        old = latest_version(batch.sparkSession, folder, number)
        merged = last_wins(batch if old is None else old.unionByName(batch), key, order)
        merged.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_latest(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The last event of each (user_id, event_type)."""
    return upsert_rows(events, ["user_id", "event_type"], ["ts", "event_id"], folder, checkpoint)
