"""Times as columns: several formats, epochs in seconds or milliseconds, windows of ids that hold times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The formats that are tried in order before ISO.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")


def session_time(text: Column) -> Column:
    """`2023/05/20 (Sat) 00:44`, with seconds or without, as a timestamp; else an ISO time; null for anything else."""
    plain = F.regexp_replace(text, r"[\x20]*\([A-Za-z]+\)[\x20]*", " ")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm")), text.try_cast("timestamp"))


def any_time(text: Column, formats: Sequence[str] = FORMATS) -> Column:
    """The first format that fits the whole text, then ISO; null where none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats), text.try_cast("timestamp"))


def epoch_seconds(value: Column) -> Column:
    """Numbers above 1e10 are milliseconds, others seconds."""
    return F.when(value > 1e10, value / 1000).otherwise(value.cast("double"))


def iso_seconds(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
