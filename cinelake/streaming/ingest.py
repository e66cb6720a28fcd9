"""Incremental file ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.sources.asf import asf_fragments
from cinelake.sources.avi import avi_packets

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(
    spark: SparkSession, path: str, glob: str | None = None, max_files_per_trigger: int | None = None
) -> DataFrame:
    """New media files as they appear: file_id, path, length, content."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).select(F.xxhash64("path").alias("file_id"), "path", "length", "content")


def stream_packets(spark: SparkSession, path: str, with_payload: bool = False, **options) -> DataFrame:
    """Packets of AVI files as they appear."""
    return avi_packets(stream_files(spark, path, **options), with_payload=with_payload)


def stream_fragments(spark: SparkSession, path: str, **options) -> DataFrame:
    """Fragments of ASF files as they appear."""
    return asf_fragments(stream_files(spark, path, **options))
