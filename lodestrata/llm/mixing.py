"""Mixing sources to target weights.

Documents get hash-random keys. Within each source they are range-sorted by key (equal key
ranges hold equal shares, as the keys are uniform), prefix sums of the sizes are computed from
the sums of the ranges and within each range, and each source is cut at its exact budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import stored, word_count

#: Bits of a mixing key: 15 hexadecimal digits of an MD5.
KEY_BITS = 60


def source_targets(
    sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), max_epochs: int = 2
) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, have the weights in turn. They share `share` of all words by
    weight; a target stops at max_epochs times its source's size and what is over is shared again
    by weight, until none is above. With sources in the order of size / weight, those that stop are
    the first ones; the level of the others follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (turn + 1).cast("int")).cast("long")
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(max_epochs))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    capped = F.col("source_size") * F.lit(float(max_epochs))
    # The first source in this order that doesn't stop sets the level of all later ones.
    return (
        sizes.withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("open", F.col("level") * F.col("weight") <= capped)
        .withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(everything))
        .withColumn("target", F.coalesce(F.least(capped, F.col("final") * F.col("weight")), capped))
        .select("source", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[int, ...] = (3, 1, 2),
    max_epochs: int = 2,
    docs_per_range: int = 20_000,
) -> DataFrame:
    """How many words the mix takes of each document, repeats counted.

    docs has doc_id, source and text; other columns are ignored. Returns one row per input row:
    doc_id, source, size, source_size, target, taken. A source is repeated whole as often as its target
    allows; of the last round, documents are taken by key up to the exact budget, the one at the
    cut in part. A null or empty text has size 0 and takes 0; null sources form a source of their
    own, last; a null doc_id has a key like any other; repeated rows are taken one after the other;
    no rows give no rows. The number of sources must fit one task (their totals are ranked).
    """
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "sizes")
    bits = max(0, (sized.count() // docs_per_range).bit_length())
    sized = sized.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(upto), F.lit(0))).alias("s")
    targets = source_targets(
        ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), share, weights, max_epochs
    ).alias("t")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("d")
    joined = placed.join(
        starts, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range"))
    ).join(targets, F.col("d.source").eqNullSafe(F.col("t.source")))
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - rounds * F.col("source_size") - F.col("start") - F.col("ahead")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.select(
        "d.doc_id", "d.source", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT source, source_size, w,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
          - CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 2.0)
         / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lvl
  FROM sources),
final AS (
  SELECT source, source_size,
         coalesce(least(source_size * 2.0::DOUBLE, w * (SELECT lvl FROM levels WHERE lvl * w <= source_size * 2.0 ORDER BY source_size / w, source NULLS LAST LIMIT 1)), source_size * 2.0::DOUBLE) AS target
  FROM levels),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized),
budgets AS (
  SELECT source, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS rounds
  FROM final)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(size, budget - rounds * source_size - ahead)) AS BIGINT) AS taken
FROM placed JOIN budgets ON placed.source IS NOT DISTINCT FROM budgets.source
"""
