"""Frames of arriving files, and groups of pictures of arriving frames, as micro-batches of the batch operators.

A micro-batch is an ordinary table, so the scans of a long or busy stream spread over tasks as they do in batch: no task holds
a stream. What a stream carries from one micro-batch to the next is one row (``carry``); frames that have come before the
ones they follow wait in a table. Both are written per micro-batch, beside the frames, under the micro-batch's number: a
repeated micro-batch reads what the one before it left and overwrites what it wrote itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinelake.operators import frames as FR
from cinelake.operators.lookup import shuffled
from cinelake.operators.reassembly import object_packets
from cinelake.operators.scan import CHUNK_ROWS, Running, ordered_scan
from cinelake.session import saved, shared_dir
from cinelake.sources.records import media_records

CARRY = (StructType().add("file_id", "long").add("next_seq", "long").add("gop_id", "long").add("distance", "long")
         .add("bit_rate", "integer").add("ref_seq", "long").add("decoded", "boolean"))
WAITING = (StructType().add("file_id", "long").add("seq", "long").add("frame_type", "string").add("status", "string")
           .add("bit_rate", "integer"))
TRACKED = (StructType().add("file_id", "long").add("seq", "long").add("frame_type", "string").add("status", "string")
           .add("gop_id", "long").add("p_index", "long").add("no_rounding", "boolean").add("bit_rate", "integer").add("ref_seq", "long"))


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], base: str) -> None:
    """Give everything available to ``step``, one micro-batch after the other, with the checkpoint under ``base``."""
    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_frames(files: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """The frames (``frames_table``) of AVI and ASF files (file_id, content) as they arrive, each file whole in one micro-batch.

    Runs until everything available is taken; with the same ``base`` a later run goes on with the files that have come since.
    """
    spark = files.sparkSession
    base = base or shared_dir(spark, name)
    files = files.select("file_id", "content")
    shapes = []

    def step(batch: DataFrame, number: int) -> None:
        frames = FR.frames_table(*_sources(batch))
        shapes.append(frames.schema)
        frames.write.mode("overwrite").parquet(f"{base}/frames/batch={number}")

    run_batches(files, step, base)
    if not shapes:  # nothing new has come
        step(spark.createDataFrame([], files.schema), -1)
    return spark.read.schema(shapes[0]).parquet(f"{base}/frames")


def _sources(files: DataFrame) -> tuple[DataFrame, DataFrame, int, bool]:
    """Arguments of ``frames_table``."""
    walked = media_records(files)
    if walked.fragments.isEmpty():  # no ASF file: the packets are those of the written walk
        return walked.packets, walked.streams, CHUNK_ROWS, True
    columns = ["file_id", "seq", "byte_offset", "size", "head"]
    objects = object_packets(walked.fragments)
    return walked.packets.select(*columns).unionByName(objects.select(*columns)), walked.streams, CHUNK_ROWS, False


def track_batches(frames: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Groups of pictures, carried bit rates and references (``frames.track``) of frames as they arrive.

    ``seq`` counts each file's frames from 0. A frame that arrives early waits until the ones before it are there; a
    repeated one counts once, as it came first. Needs file_id, seq, frame_type, status and bit_rate.
    """
    spark = frames.sparkSession
    base = base or shared_dir(spark, name)

    def before(table: str, schema: StructType, number: int) -> DataFrame:
        if number == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{base}/{table}/batch={number - 1}")

    def step(batch: DataFrame, number: int) -> None:
        carry = before("carry", CARRY, number)
        fresh = batch.select(*[F.col(f.name).cast(f.dataType) for f in WAITING])
        pool = before("waiting", WAITING, number).withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        known = carry.select("file_id", *[F.col(f.name).alias("_carried" if f.name == "distance" else f"_{f.name}") for f in CARRY if f.name != "file_id"])
        once = pool.groupBy("file_id", "seq").agg(F.min(F.struct("_new", "frame_type", "status", "bit_rate")).alias("f"))
        pool = once.select("file_id", "seq", "f.frame_type", "f.status", "f.bit_rate").join(shuffled(known), "file_id", "left")
        pool = pool.filter(F.col("seq") >= F.coalesce("_next_seq", F.lit(0)))
        placed = saved(ordered_scan(pool, FR.FILE, ["seq"], {"_place": Running("sum_before", F.lit(1).cast("bigint"))}), "pool")
        ready = placed.filter(F.col("seq") == F.coalesce("_next_seq", F.lit(0)) + F.col("_place"))
        outputs = {**FR._gop_outputs(), **FR._reference_outputs(), **FR._rate_outputs()}
        scanned = ordered_scan(ready, FR.FILE, ["seq"], outputs)
        gop = F.col("gop_id")
        distance = F.col("_distance") + F.when(gop == 0, F.coalesce("_carried", F.lit(0))).otherwise(0)
        carried = scanned.withColumns({
            "_distance": distance, "_far": distance, "_raw": FR._ok(),
            "gop_id": gop + F.coalesce("_gop_id", F.lit(0)),
            "bit_rate": F.coalesce("bit_rate", "_bit_rate"),
            "_ok_before": F.coalesce("_ok_before", "_ref_seq"),
            "_ok_intra_before": F.col("_ok_intra_before") + F.coalesce(F.col("_decoded").cast("bigint"), F.lit(0)),
        })
        tracked = saved(FR._reference_columns(FR._gop_columns(carried)), "tracked")
        tracked.select(*TRACKED.names).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        moved = tracked.groupBy("file_id").agg(
            (F.max("seq") + 1).alias("next_seq"), F.max("gop_id").alias("gop_id"), F.max_by("_far", "seq").alias("distance"),
            F.max_by("bit_rate", "seq").alias("bit_rate"),
            F.coalesce(F.max(F.when(F.col("_raw"), F.col("seq"))), F.max("_ref_seq")).alias("ref_seq"),
            (F.max(F.coalesce("_decoded", F.lit(False))) | F.max(FR._intra() & F.col("_raw"))).alias("decoded"))
        kept = carry.join(shuffled(moved.select("file_id")), "file_id", "left_anti")
        moved.unionByName(kept).select(*CARRY.names).write.mode("overwrite").parquet(f"{base}/carry/batch={number}")
        late = placed.filter(F.col("seq") != F.coalesce("_next_seq", F.lit(0)) + F.col("_place"))
        late.select(*WAITING.names).write.mode("overwrite").parquet(f"{base}/waiting/batch={number}")

    run_batches(frames.select(*WAITING.names), step, base)
    return spark.read.schema(TRACKED).parquet(f"{base}/out")
