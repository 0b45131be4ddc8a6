"""Sequence files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.sources.reader import parse_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_sequences(spark: SparkSession, folder: str, format: str | None = None) -> DataFrame:
    """New files in a folder, parsed as they come; files that can't be parsed give a row with their error."""
    return parse_files(spark.readStream.format("binaryFile").schema(FILES).load(folder), format, permissive=True)
