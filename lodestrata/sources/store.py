"""An embedding store of (hash_id, content, embedding) in Parquet: new texts are added by id, ids already stored stay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import stored_id
from lodestrata.sources.files import exists

SCHEMA = "hash_id string, content string, embedding array<float>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; an absent store has none. Of an id added twice one row counts."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path).dropDuplicates(["hash_id"])


def missing(spark: SparkSession, path: str, texts: DataFrame, prefix: str = "chunk") -> DataFrame:
    """hash_id, content of the distinct texts (column content) whose id is not stored."""
    asked = texts.select(stored_id(prefix, F.col("content")).alias("hash_id"), "content").dropDuplicates(["hash_id"])
    return asked.join(load(spark, path).select("hash_id"), "hash_id", "left_anti")


def add(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Appends rows as files of their own; nothing that is stored is rewritten."""
    rows.select("hash_id", "content", F.col("embedding").cast("array<float>")).write.mode("append").option("compression", "zstd").parquet(path)


def delete(spark: SparkSession, path: str, ids: DataFrame) -> str:
    """Writes the store without some ids to a new folder beside it, whose path is returned for the caller to switch to."""
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    load(spark, path).join(ids.select("hash_id").distinct(), "hash_id", "left_anti").write.parquet(target)
    return target
