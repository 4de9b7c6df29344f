"""Files by pattern, Arrow and CSV files, and ingestion of texts by content hash."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import stored_id


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def paths(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Paths and glob patterns of any store that Spark reads, each once, sorted; a pattern without a match gives none."""
    found = set()
    for pattern in patterns:
        p, fs = _file_system(spark, pattern)
        found |= {s.getPath().toString() for s in (fs.globStatus(p) or [])}
    return sorted(found)


def resolved(folder: str, view: str, slice_name: str | None, dataset: str, explicit: Sequence[str] = ()) -> list[str]:
    """Test files that are named, else `{folder}/{view}/{slice}.json`, where the slice is named or is the dataset's name after its first underscore."""
    return list(explicit) or [f"{folder}/{view}/{slice_name or dataset.split('_', 1)[-1]}.json"]


def arrow_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of Arrow IPC files: read as a stream first, as a file where that fails. A file is read by one task; columns that it lacks are null."""
    want = spark.createDataFrame([], schema).schema
    names = want.names
    kinds = pa.schema(spark.createDataFrame([], schema).toArrow().schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = pa.py_buffer(content.as_py())
                try:
                    reader = pa.ipc.open_stream(data)
                    found = reader.read_all()
                except pa.ArrowInvalid:
                    found = pa.ipc.open_file(data).read_all()
                columns = [found.column(c).cast(kinds.field(c).type) if c in found.column_names else pa.nulls(len(found), kinds.field(c).type) for c in names]
                yield from pa.table(columns, names=names).to_batches(max_chunksize=10_000)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, want)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header; quoted values may hold new lines, and a row that doesn't fit the schema has nulls."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def ingest(old: DataFrame, texts: DataFrame, dataset: str) -> DataFrame:
    """Rows (dataset, hash_id, text) that a dataset gains: each text that it doesn't hold yet once, by content hash."""
    asked = texts.where("text is not null").select(F.lit(dataset).alias("dataset"), stored_id("data", F.col("text")).alias("hash_id"), "text").dropDuplicates(["hash_id"])
    return asked.join(old.where(F.col("dataset") == dataset).select("hash_id"), "hash_id", "left_anti").select("dataset", "hash_id", "text")
