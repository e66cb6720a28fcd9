"""Media files as a table, container sniffing, raw planes and record streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinelake.sources.walk import walk_records

# fixed value: GUID that opens an ASF file
ASF_HEADER_GUID = "3026B2758E66CF11A6D900AA0062CE6C"


def media_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under ``path``: file_id, path, length, content. ``content`` is not read unless used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.xxhash64("path").alias("file_id"), "path", "length", "content")


def container_of(content: Column, extra: dict[str, bytes] | None = None) -> Column:
    """``avi``, ``asf``, a label of ``extra`` (label -> leading bytes), or ``unknown``."""
    riff = (F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"AVI "))
    kind = F.when(riff, "avi").when(F.substring(content, 1, 16) == F.unhex(F.lit(ASF_HEADER_GUID)), "asf")
    for label, magic in (extra or {}).items():
        kind = kind.when(F.substring(content, 1, len(magic)) == F.lit(magic), label)
    return kind.otherwise("unknown")


def sniff(df: DataFrame, content: str = "content", extra: dict[str, bytes] | None = None) -> DataFrame:
    """Add ``container``."""
    return df.withColumn("container", F.coalesce(container_of(F.col(content), extra), F.lit("unknown")))


def length_prefixed(df: DataFrame, col: str = "content", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Records of a stream of little-endian 32-bit lengths, each followed by its bytes.

    An empty record, or one running past the end, has a null payload.
    """

    def walk(data: bytes):
        at, n = 0, 0
        while at + 4 <= len(data):
            size = int.from_bytes(data[at : at + 4], "little")
            at += 4
            whole = size > 0 and at + size <= len(data)
            yield n, at, size, data[at : at + size] if whole else None
            at += size
            n += 1

    schema = StructType.fromDDL("record_no bigint, byte_offset bigint, size bigint, payload binary")
    return walk_records(df, walk, schema, keep, col)


def i420_planes(
    files: DataFrame, width: int, height: int, clip: str = "file_id", content: str = "content"
) -> DataFrame:
    """Lines of raw 4:2:0 pictures stored one after another; a partial last picture is dropped.

    One pass over each file's bytes; lines leave it in small batches.
    """
    cw, ch = (width + 1) // 2, (height + 1) // 2
    planes = (("Y", width, height), ("Cb", cw, ch), ("Cr", cw, ch))
    frame_bytes = sum(w * h for _, w, h in planes)

    def walk(data: bytes):
        for frame in range(len(data) // frame_bytes):
            at = frame * frame_bytes
            for plane, w, h in planes:
                lines = np.frombuffer(data, np.uint8, w * h, at).reshape(h, w)
                at += w * h
                for row in range(h):
                    yield frame, plane, row, lines[row].tolist()

    schema = StructType.fromDDL("frame_no int, plane string, row int, samples array<smallint>")
    named = files.select(F.col(clip).cast("string").alias("clip_id"), F.col(content).alias("content"))
    return walk_records(named, walk, schema, ("clip_id",))
