"""Structured Streaming over a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliospark.sources.extract import extract

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, max_files: int = 1000, **options: object) -> DataFrame:
    """New files of a folder as ``path, content``."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", max_files).options(**options).load(path).select("path", "content")


def extract_to(files: DataFrame, out: str, checkpoint: str, once: bool = True, **options: object) -> StreamingQuery:
    """Documents of a stream of files, appended as Parquet; what has arrived, or for ever."""
    writer = extract(files, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
