"""Streaming queries: the tables are staged as files, read as a stream and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.operators.scan import Running, ordered_scan
from cinelake.plans.clips import _TRACKED, SPAN, packets
from cinelake.plans.containers import _REUSED, CONVERSATIONS_PER_FILE, reused_fragments
from cinelake.plans.registry import digest, query
from cinelake.session import saved, shared_dir
from cinelake.streaming.frames import track_batches
from cinelake.streaming.reassembly import stream_reassemble as assemble_stream
from cinelake.streaming.run import drain

STAGED_FILES = 4
FILES_PER_TRIGGER = 2
FILE_PACKETS = 64 * CONVERSATIONS_PER_FILE


def _stream_of(df: DataFrame, name: str, files_per_trigger: int | None) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    reader = df.sparkSession.readStream.schema(df.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@query(f"""WITH {_TRACKED},
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, seq) - 1 AS n,
  row_number() OVER (PARTITION BY file_id, gop ORDER BY ts, seq) - 1 AS k FROM g),
q AS (SELECT *, last_value(CASE WHEN ok THEN n END IGNORE NULLS) OVER b AS okn,
  last_value(rate IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS carried FROM r
  WINDOW b AS (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT file_id, n AS seq, CAST(gop AS BIGINT) AS gop_id, CASE WHEN gop > 0 THEN k END AS p_index, carried AS bit_rate,
  CASE WHEN NOT i AND coalesce(oki, 0) > 0 THEN okn END AS ref_seq,
  CASE WHEN NOT i AND coalesce(oki, 0) = 0 THEN 'no_reference' WHEN ok THEN 'ok' ELSE 'bad_qscale' END AS status FROM q""")
def stream_gops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are staged in hashed order, so that many arrive before the ones they follow."""
    dense = ordered_scan(packets(spark, sf_dir), ["file_id"], ["seq"], {"n": Running("sum_before", F.lit(1))}, chunk_rows=SPAN)
    frames = dense.select("file_id", F.col("n").cast("bigint").alias("seq"), "frame_type", "status", "bit_rate")
    stream = _stream_of(frames.repartition(STAGED_FILES, "file_id", "seq"), "frames", FILES_PER_TRIGGER)
    return track_batches(stream, "gops").select("file_id", "seq", "gop_id", "p_index", "bit_rate", "ref_seq", "status")


@query(f"WITH RECURSIVE {_REUSED}")
def stream_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments arrive in several runs of one query, along their packet numbers, so that many objects span two."""
    fragments = saved(reused_fragments(spark, sf_dir), "reused")
    last = fragments.agg(F.max(F.col("packet_no") % FILE_PACKETS)).first()[0] or 0
    part = F.call_function("div", F.col("packet_no") % FILE_PACKETS * STAGED_FILES, F.lit(last + 1))
    path, base = shared_dir(spark, "fragments"), shared_dir(spark, "objects")
    for number in range(STAGED_FILES):
        fragments.filter(part == number).write.mode("append").parquet(path)
        out = drain(assemble_stream(spark.readStream.schema(fragments.schema).parquet(path)), "objects", base)
    return out.select("file_id", "object_no", "episode", "size", "emit_packet", digest(F.col("payload")).alias("digest"))
