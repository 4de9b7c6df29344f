"""Memory tables: change logs, retention, soft deletes, decay and feedback; all as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import rounded, written


def last_wins(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, found by a partial aggregate rather than a sort; all columns stay."""
    rest = [c for c in log.columns if c not in key]
    ordered = F.struct(*order, *(c for c in rest if c not in order))
    return log.groupBy(*key).agg(F.max(ordered).alias("last")).select(*key, *(F.col(f"last.{c}").alias(c) for c in rest))


def alive(log: DataFrame, key: list[str], order: list[str], is_delete: Column) -> DataFrame:
    """What a change log leaves: the last row of each key unless that row is a delete."""
    return last_wins(log, key, order).where(~F.coalesce(is_delete, F.lit(False)))


def keep_latest(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The latest n rows of each group; the limit is taken in each task before the shuffle."""
    w = Window.partitionBy(group).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def decayed(age_seconds: Column, half: float = 3600.0) -> Column:
    return F.exp(-age_seconds / half)


def heat(visits: Column, interactions: Column, recency: Column) -> Column:
    """Fixed weights of the segment heat."""
    return visits * 0.8 + interactions * 0.8 + recency * 0.0001


def feedback(scores: Column, start: float = 0.5, rate: float = 0.1) -> Column:
    """A weight after an array of scores 1 to 5 in order: each moves it towards (score - 1) / 4, within 0 and 1, rounded each step."""

    def step(weight: Column, score: Column) -> Column:
        moved = weight + rate * ((score - 1) / 4 - weight)
        # ties are common here, so rounding is spelled out instead of left to the engine
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)) * 1e6 + 0.5000001) / 1e6

    return F.aggregate(scores, F.lit(start), step)


def first_of_context(rows: DataFrame, context: str, order: str, value: str) -> DataFrame:
    """context, its first value that is not null, and how many rows it has."""
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return rows.groupBy(context).agg(first.alias("first_value"), F.count("*").alias("n_rows"))


def rollup_means(rows: DataFrame, levels: list[str], metrics: list[str]) -> DataFrame:
    """Counts and means of metrics for all rows, and for each prefix of the levels; absent levels are null."""
    means = [rounded(F.avg(F.col(m).cast("double")), 4).alias(f"mean_{m}") for m in metrics]
    return rows.rollup(*levels).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_rows"), *means)


def evenly_spaced(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The rows at places int(i * count / n), i from 0; all rows if there are no more than n.

    Places come from counts per range of the order and ranks within a range, so no task sorts all rows.
    """
    total = rows.count()
    placed = global_places(rows, order)
    i = F.floor(F.col("place") * n / total)
    hit = (F.floor(i * total / n) == F.col("place")) | (F.floor((i + 1) * total / n) == F.col("place"))
    return placed if total <= n else placed.where(hit & (F.col("place") < total))


def global_places(rows: DataFrame, order: str) -> DataFrame:
    """rows with their place (from 0) in the order of a column without nulls or ties, computed range by range.

    The ranges are written before use: their bounds come from a sample, so a second run of the same plan may cut them elsewhere.
    """
    ranges = written(rows.repartitionByRange(F.col(order)).withColumn("part", F.spark_partition_id()), "ranges")
    starts = ranges.groupBy("part").agg(F.count("*").alias("n"), F.min(order).alias("least"))
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "start")
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranges.withColumn("within", within).join(F.broadcast(starts), "part").withColumn(
        "place", (F.col("start") + F.col("within")).cast("long")
    ).drop("part", "within", "start")


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new inserted or, by key, put in place; columns in `keep` stay as they were first. One full join, nothing is updated in place."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("__old"))
    b = new.select(*key, F.struct(*rest).alias("__new"))
    value = lambda c: F.coalesce(f"__old.{c}", f"__new.{c}") if c in keep else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return a.join(b, key, "full").select(*key, *(value(c).alias(c) for c in rest))


def inserted_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks, each key once."""
    first = new.select(old.columns).dropDuplicates(key)
    return old.unionByName(first.join(old.select(*key), key, "left_anti").select(old.columns))
