"""Many logical files packed into few: chunks of bounded size, in as many data files as their bytes need.

A folder per logical file makes as many files as there are names, and committers and readers list them all. Here a row is a
chunk of a logical file (path, chunk number, bytes); Spark sizes the data files by bytes, and the path's statistics in them
are the index by which a reader finds the chunks of one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a chunk.
CHUNK_BYTES = 1 << 20


def write_packed(files: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, mode: str = "error") -> None:
    """Write logical files (``path``, ``content`` as text or BINARY). Null contents are empty files."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    n = F.greatest(F.ceil(F.octet_length("c") / chunk_bytes), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("c"), k * chunk_bytes + 1, chunk_bytes))
    chunks = files.select("path", content.alias("c")).select("path", F.posexplode(cut).alias("chunk_no", "chunk"))
    # one exchange: data files of about the advisory size, each a stretch of paths
    chunks.hint("rebalance", F.col("path")).sortWithinPartitions("path", "chunk_no").write.mode(mode).parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The logical files: ``file_id``, ``path``, ``length`` and ``content``, as ``media_files`` gives them.

    ``content`` is put together only where it is used; a filter on ``path`` reaches the scan.
    """
    chunks = spark.read.schema("path string, chunk_no int, chunk binary").parquet(path)
    whole = chunks.groupBy("path").agg(
        F.sum(F.octet_length("chunk")).cast("bigint").alias("length"), F.count(F.lit(1)).alias("_n"), F.first("chunk").alias("_only"),
        F.collect_list(F.when(F.col("chunk_no") > 0, F.struct("chunk_no", "chunk"))).alias("_more"),
        F.first(F.when(F.col("chunk_no") == 0, F.col("chunk")), ignorenulls=True).alias("_first"))
    rest = F.unhex(F.array_join(F.transform(F.array_sort("_more"), lambda c: F.hex(c["chunk"])), ""))
    content = F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.concat(F.col("_first"), rest))
    return whole.select(F.xxhash64("path").alias("file_id"), "path", "length", content.alias("content"))
