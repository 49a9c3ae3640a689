"""Digests, formats and chunks of files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from octetflow.functions import codecs, digests
from octetflow.operators.chunking import chunk_rows

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, modified, size, content) of files as they appear. A file is read once; ``files_per_batch`` bounds a batch. The source leaves out empty files."""
    found = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def digested(files: DataFrame) -> DataFrame:
    """Digests and format of each file."""
    c = F.col("content")
    return files.select("path", "modified", "size", digests.sha256(c).alias("sha256"), digests.fnv(c).alias("fnv"), codecs.detected(c).alias("format"))


def chunked(files: DataFrame) -> DataFrame:
    return chunk_rows(files.select("path", "content"))


def arrivals(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by time of modification and format; files later than ``late`` behind the newest are left out, and a window's row comes when it can no longer change."""
    kinds = files.select("modified", "size", codecs.detected(F.col("content")).alias("format")).withWatermark("modified", late)
    return kinds.groupBy(F.window("modified", window).alias("w"), "format").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).select("w.start", "w.end", "format", "files", "bytes")


def to_table(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends to Parquet; the checkpoint makes every row arrive once, restarts included."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
