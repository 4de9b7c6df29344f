import pytest
from pyspark.sql import functions as F

from lodestrata.functions import time_words as W

NOW = "2024-03-13 10:30:00"  # a Wednesday
WANT = {
    "today": "2024-03-13", "Yesterday": "2024-03-12", " tomorrow ": "2024-03-14", "the day before yesterday": "2024-03-11", "3 days ago": "2024-03-10", "a month ago": "2024-02-13",
    "twelve years ago": "2012-03-13", "in 2 days": "2024-03-15", "5 days from now": "2024-03-18", "last month": "2024-02-13", "next year": "2025-03-13", "this month": "2024-03-13",
    "Monday": "2024-03-11", "last wednesday": "2024-03-06", "next wednesday": "2024-03-20", "next thu": "2024-03-14", "Sunday": "2024-03-10",
    "March 13": "2024-03-13", "March 14": "2023-03-14", "Nov. 15th": "2023-11-15", "15 November 2022": "2022-11-15", "2nd of may": "2023-05-02", "May 5, 2025": "2025-05-05",
    "November": "2023-11-13", "february": "2024-02-13", "february 2021": "2021-02-01", "February 29": "2024-02-29", "2023/5/7": "2023-05-07", "2023-05-20 00:44": "2023-05-20",
    "soon": None, "february 30": None, "2023-13-01": None, "": None, None: None, "the 5th element": None, "99999 days ago": None,
}


def test_expressions(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(WANT)], "k int, x string")
    got = rows.select("k", W.anchor_day(F.col("x"), F.lit(NOW).cast("timestamp")).cast("string").alias("d")).orderBy("k").collect()
    assert dict(zip(WANT, (r.d for r in got), strict=True)) == WANT


@pytest.mark.parametrize("expression, start, end", [
    ("last week", "2024-02-28 00:00:00", "2024-03-13 23:59:59"), ("2 weeks ago", "2024-02-21 00:00:00", "2024-03-06 23:59:59"),
    ("yesterday", "2024-03-12 00:00:00", "2024-03-12 23:59:59"), ("some week", None, None),
])
def test_ranges(spark, expression, start, end):
    r = spark.range(1).select(W.time_range(F.lit(expression), F.lit(NOW).cast("timestamp")).cast("struct<start: string, end: string>").alias("r")).first().r
    assert (r and (r.start, r.end)) == (start and (start, end))


def test_a_leap_day_is_looked_for_in_earlier_years(spark):
    day = W.anchor_day(F.lit("February 29"), F.lit("2023-06-01").cast("timestamp")).cast("string")
    assert spark.range(1).select(day).first()[0] == "2020-02-29"
