"""Sessions, tables and small helpers that the engine's operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to this many rows are broadcast where a hint helps; larger ones are shuffled.
MAX_BROADCAST_ROWS = 100_000


def build_session(name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings come from the caller or spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a task has one core: products of matrices in its Python worker keep to it, unless the session says otherwise
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small, else as it is."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's spark.checkpoint.dir; on one machine without one, a temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: it is computed once, its lineage ends there, and its shuffle files go."""
    path, conf = shared_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column.cast("double"), digits)
