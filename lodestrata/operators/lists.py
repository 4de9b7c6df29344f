"""Operators over ordered rows and ranked lists: numbering, pages, merges, quotas, fallbacks, neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import vector as V
from lodestrata.session import rounded


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, order, number, first_number: a running number (from 0) over groups and then their rows, and each group's first.

    Sums of group sizes give the offsets; only one row for each group is ordered in one place.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(group, F.coalesce(before, F.lit(0)).cast("long").alias("first_number"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.select(group, order, place.alias("place")).join(offsets, group).select(group, order, (F.col("first_number") + F.col("place")).cast("long").alias("number"), "first_number")


def page(rows: DataFrame, group: str, order: str, offset: int, limit: int, descending: bool = False) -> DataFrame:
    """The rows of each group at places offset + 1 to offset + limit, with their place."""
    w = Window.partitionBy(group).orderBy(F.desc(order) if descending else F.asc(order))
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place").between(offset + 1, offset + limit))


def adjacent_breaks(rows: DataFrame, group: str, order: str, vector: str, low: int = 20, high: int = 50, step: int = 5) -> DataFrame:
    """group, order, score, breaks, first_percent: the cosine with the row before, whether it is below `low` percent, and the first threshold it is below."""
    before = F.lag(vector).over(Window.partitionBy(group).orderBy(order))
    scored = rows.select(group, order, vector, before.alias("before")).where("before is not null").select(group, order, rounded(V.cosine(F.col(vector), F.col("before"))).alias("score"))
    passed = F.filter(F.array(*(F.lit(p).cast("long") for p in range(low, high + 1, step))), lambda p: F.col("score") < p / 100)
    return scored.select(group, order, "score", (F.col("score") < low / 100).alias("breaks"), F.get(passed, F.lit(0)).alias("first_percent"))


def _union(lists: tuple[DataFrame, ...], *columns: str) -> DataFrame:
    union = None
    for n, one in enumerate(lists):
        one = one.select("query_id", "id", *columns, F.lit(n).cast("long").alias("list"))
        union = one if union is None else union.unionByName(one)
    return union


def round_robin(*lists: DataFrame, k: int) -> DataFrame:
    """Lists of (query_id, id, rank) to query_id, id, place: the first of each list, then the second of each, each id once, cut at k."""
    first = _union(lists, "rank").groupBy("query_id", "id").agg(F.min(F.struct("rank", "list")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "id")).cast("long")
    return first.select("query_id", "id", place.alias("place")).where(F.col("place") <= k)


def best_scores(*lists: DataFrame) -> DataFrame:
    """Lists of (query_id, id, score) to the highest score of each id and the last list that names it."""
    return _union(lists, "score").groupBy("query_id", "id").agg(rounded(F.max("score")).alias("score"), F.max("list").alias("last_list"))


def quota_merge(rows: DataFrame, group: str, flag: str, order: list[Column], k: int, share: float) -> DataFrame:
    """Of each group k rows: a share of the places for flagged rows and the rest for others; places that one side leaves go to the other."""
    own = round(k * share)
    n = F.row_number().over(Window.partitionBy(group, flag).orderBy(*order))
    room = F.when(F.col(flag), F.greatest(F.lit(own), k - F.col("b"))).otherwise(F.greatest(F.lit(k - own), k - F.col("a")))
    placed = rows.withColumn("n", n).where(F.col("n") <= k)
    counts = rows.groupBy(group).agg(F.sum(F.col(flag).cast("long")).alias("a"), F.sum((~F.col(flag)).cast("long")).alias("b"))
    keys = [x for x in rows.columns if x not in (group, flag)][:1]
    return placed.alias("p").join(counts, F.col(f"p.{group}").eqNullSafe(counts[group])).where(F.col("n") <= room).select(F.col(f"p.{group}").alias(group), *keys, flag)


def rarest_words(rows: DataFrame, key: list[str], words: Column, fraction: float) -> DataFrame:
    """key, kept: the rarest words of each row by their count over all rows, at least one, in the row's order; rows without words are left out."""
    at = rows.select(*key, words.alias("ws")).select(*key, F.size("ws").alias("n"), F.posexplode("ws").alias("at", "word"))
    uses = at.groupBy("word").agg(F.count("*").alias("uses"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("uses", "at"))
    kept = at.join(uses, "word").withColumn("place", place).where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(round(fraction * 10)) / 10)))
    ordered = F.array_sort(F.collect_list(F.struct("at", "word")))
    return kept.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("kept"))


def zipped(rows: DataFrame, key: str, questions: Column, answers: Column) -> DataFrame:
    """key, place, question, answers: by place where both arrays have more than one element, else the first question with all answers; no question, no row."""
    both = rows.select(key, questions.alias("q"), answers.alias("a"))
    many = (F.size("q") > 1) & (F.size("a") > 1)
    n = F.least(F.size("q"), F.size("a"))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("place"), F.get("q", i).alias("question"), F.get("a", i).alias("answers")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.get("q", F.lit(0)).alias("question"), F.array_join("a", ",").alias("answers")))
    return both.where(F.size("q") > 0).select(key, F.explode(F.when(many, pairs).otherwise(whole)).alias("x")).select(key, "x.place", "x.question", "x.answers")


def fallback_join(rows: DataFrame, gold: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with the gold value found by the first key, else by the next, and the way that found it; keys that several gold rows share after the first find nothing."""
    out = rows
    for n, key in enumerate(keys):
        one = gold.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(f"__v{n}")).where(F.lit(n == 0) | (F.col("n") == 1))
        out = out.join(one.select(key, f"__v{n}", F.lit(True).alias(f"__f{n}")), key, "left")
    way, found = F.lit(None).cast("string"), F.lit(None).cast(gold.schema[value].dataType)
    for n in reversed(range(len(keys))):
        way, found = F.when(F.col(f"__f{n}"), keys[n]).otherwise(way), F.when(F.col(f"__f{n}"), F.col(f"__v{n}")).otherwise(found)
    return out.select(*rows.columns, way.alias("way"), found.alias(value))


def nearest_before(rows: DataFrame, group: str, order: list[str], key: str, value: str, reach: int, k: int) -> DataFrame:
    """key, other, rank: of the `reach` rows before each in its group the k with the nearest value, ties to the smaller key.

    The candidates are a sliding window, so a group of any size is a sorted stream.
    """
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(-reach, -1)
    prior = F.collect_list(F.struct(F.col(value), F.col(key))).over(before)
    near = F.array_sort(F.transform("prior", lambda x: F.struct(rounded(F.abs(x[value] - F.col(value))).alias("d"), x[key].alias("other"))))
    found = rows.select(group, key, value, prior.alias("prior")).select(key, F.posexplode(F.slice(near, 1, k)).alias("rank", "x"))
    return found.select(key, "x.other", (F.col("rank") + 1).cast("long").alias("rank"))


def keyset_slice(rows: DataFrame, order: list[str], limit: int, after: DataFrame | None = None, before: DataFrame | None = None, ascending: bool = True) -> DataFrame:
    """At most `limit` rows in the order of the columns `order`, of which the last is unique, that come after and before cursors.

    A cursor is a table of one row with these columns; rows equal to it are left out, and so are all where it has no row. With both cursors the first 2 * limit rows between them are read, and if they are
    more than limit, the middle ones stay: those from place len / 2 - limit / 2 on. Later and earlier are meant by value, also where ascending is false.
    """
    here = F.struct(*order)
    for cursor, later in ((after, True), (before, False)):
        if cursor is not None:
            held = F.broadcast(cursor.select(F.struct(*order).alias("__cursor")).limit(1))
            rows = rows.join(held, here > F.col("__cursor") if later else here < F.col("__cursor"), "left_semi")
    by = [F.asc(c) if ascending else F.desc(c) for c in order]
    if after is None or before is None:
        return rows.orderBy(*by).limit(limit)
    page = rows.orderBy(*by).limit(2 * limit).withColumn("__n", F.row_number().over(Window.orderBy(*by)) - 1).withColumn("__all", F.count("*").over(Window.partitionBy(F.lit(1))))
    start = F.when(F.col("__all") > limit, F.greatest(F.lit(0), F.floor(F.col("__all") / 2) - limit // 2)).otherwise(0)
    return page.where((F.col("__n") >= start) & (F.col("__n") < start + limit)).drop("__n", "__all")
