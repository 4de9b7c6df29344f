"""What the corpus operators share: stored intermediates, arrays in the shared folder, ASCII lower case, words."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import ascii_lower  # noqa: F401

#: Fixed pattern of the query contracts: ASCII white space divides words.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, with its scheme: the session's spark.checkpoint.dir.

    Where a session on one machine (tests) names none, a new temporary folder is set; on a cluster
    that is an error, as a local folder would be another one on each machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.getCheckpointDir():
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than reading the files again.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _local(uri: str) -> str | None:
    """The path of a file: URI; None for stores that are not mounted."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def put_array(uri: str, array: np.ndarray) -> None:
    """Writes an array; a repeated task replaces the file by an equal one."""
    path = _local(uri)
    if path is None:
        from pyarrow.fs import FileSystem

        store, inside = FileSystem.from_uri(uri)
        data = io.BytesIO()
        np.save(data, array)
        with store.open_output_stream(inside) as f:
            f.write(data.getbuffer())
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{os.getpid()}.tmp.npy"
    np.save(draft, array)
    os.replace(draft, path)


@lru_cache(maxsize=4096)
def mapped_array(uri: str) -> np.ndarray:
    """A written array, mapped into memory; from stores that are not mounted by way of an unnamed local copy."""
    path = _local(uri)
    if path is not None:
        return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)
    from pyarrow.fs import FileSystem

    store, inside = FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy:
        with store.open_input_stream(inside) as f:
            copy.write(f.read())
        copy.flush()
        return np.load(copy.name, mmap_mode="r")  # the mapping outlives the name


def small_enough(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it holds at most max_rows rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.greatest(F.size(F.array_remove(F.split(text, BETWEEN_WORDS, -1), "")), F.lit(0)).cast("long")
