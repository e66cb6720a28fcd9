"""Decoded pictures against a trusted decoder's: errors per plane, block and clip.

Pictures are rows of lines (``samples``); errors are summed as integers and divided once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = ["clip_id", "frame_no", "plane", "row"]
PLANE = ["clip_id", "frame_no", "plane"]
PEAK_SQUARED = 255 * 255


def compare_planes(got: DataFrame, ref: DataFrame) -> DataFrame:
    """Pair lines by position; ``status`` is matched, missing_got, missing_ref or length_mismatch."""
    g = got.select(*LINE, F.col("samples").alias("got"))
    r = ref.select(*LINE, F.col("samples").alias("ref"))
    status = (
        F.when(F.col("got").isNull(), "missing_got")
        .when(F.col("ref").isNull(), "missing_ref")
        .when(F.size("got") != F.size("ref"), "length_mismatch")
        .otherwise("matched")
    )
    return g.join(r, LINE, "full_outer").withColumn("status", status)


def _squared_error(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("bigint") - y) * (x.cast("bigint") - y))
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda acc, d: acc + d)


def _absolute(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y))


def psnr(mse: Column) -> Column:
    """Peak signal-to-noise ratio in dB; identical planes give Infinity, an unknown error null."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(float(PEAK_SQUARED)) / mse))


def plane_error(cmp: DataFrame, by: Sequence[str] = PLANE) -> DataFrame:
    """Mean squared error, largest difference and PSNR per plane.

    A plane with any unpaired or differently long line has status ``mismatch`` and no figures.
    """
    ok = F.col("status") == "matched"
    sums = cmp.groupBy(*by).agg(
        F.sum(F.when(ok, F.size("got").cast("bigint"))).alias("samples"),
        F.sum(F.when(ok, _squared_error(F.col("got"), F.col("ref")))).alias("squared_error"),
        F.max(F.when(ok, F.array_max(_absolute(F.col("got"), F.col("ref"))))).alias("max_diff"),
        F.sum((~ok).cast("bigint")).alias("bad_lines"),
    )
    whole = F.col("bad_lines") == 0
    mse = F.when(whole, F.col("squared_error") / F.col("samples"))
    return sums.select(
        *by, "samples", F.when(whole, F.col("squared_error")).alias("squared_error"),
        F.when(whole, F.col("max_diff")).alias("max_diff"), mse.alias("mse"), psnr(mse).alias("psnr"),
        F.when(whole, "ok").otherwise("mismatch").alias("status"),
    )


def _spans(samples: Column, block: int) -> Column:
    """Block numbers that lie whole inside a line (an empty array for a shorter line)."""
    n = F.floor(F.size(samples) / block).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def block_error(cmp: DataFrame, block: int = 16, min_mse: float = 50.0) -> DataFrame:
    """Blocks whose mean squared error exceeds ``min_mse``; blocks cut off by the edge are left out."""
    per_span = F.transform(
        _spans(F.col("got"), block),
        lambda i: F.struct(
            i.alias("bx"),
            _squared_error(F.slice("got", i * block + 1, block), F.slice("ref", i * block + 1, block)).alias("se"),
        ),
    )
    spans = cmp.filter(F.col("status") == "matched").select(
        *PLANE, F.floor(F.col("row") / block).cast("int").alias("by"), F.explode(per_span).alias("s"))
    sums = spans.groupBy(*PLANE, "by", F.col("s.bx").alias("bx")).agg(
        F.sum("s.se").alias("squared_error"), F.count(F.lit(1)).alias("lines"))
    mse = F.col("squared_error") / (block * block)
    return sums.filter((F.col("lines") == block) & (mse > min_mse)).select(
        *PLANE, "bx", "by", "squared_error", mse.alias("mse"))


def block_stats(planes: DataFrame, block: int = 8, coded_above: float = 8.0) -> DataFrame:
    """Mean and (population) variance of each whole block; ``coded`` when the variance exceeds a bound."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    squares = lambda a: F.aggregate(
        a, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint") * x)
    per_span = F.transform(
        _spans(F.col("samples"), block),
        lambda i: F.struct(
            i.alias("bx"),
            total(F.slice("samples", i * block + 1, block)).alias("s"),
            squares(F.slice("samples", i * block + 1, block)).alias("q"),
        ),
    )
    spans = planes.select(*PLANE, F.floor(F.col("row") / block).cast("int").alias("by"), F.explode(per_span).alias("s"))
    sums = spans.groupBy(*PLANE, "by", F.col("s.bx").alias("bx")).agg(
        F.sum("s.s").alias("s"), F.sum("s.q").alias("q"), F.count(F.lit(1)).alias("lines"))
    n = block * block
    variance = (n * F.col("q") - F.col("s") * F.col("s")) / (n * n)
    return sums.filter(F.col("lines") == block).select(
        *PLANE, "bx", "by", (F.col("s") / n).alias("mean"), variance.alias("variance"),
        (variance > coded_above).alias("coded"))


def coded_pattern(
    blocks: DataFrame,
    keys: Sequence[str] = ("clip_id", "frame_no", "mbx", "mby"),
    luma_above: int = 80,
    chroma_above: int = 60,
) -> DataFrame:
    """Six-bit pattern per macroblock: which of its blocks (``blk`` 0..5: four luma, two chroma) differ
    from the reference by more than a summed absolute difference."""
    sad = F.aggregate(
        _absolute(F.col("samples"), F.col("ref_samples")), F.lit(0).cast("bigint"), lambda acc, d: acc + d)
    limit = F.when(F.col("blk") < 4, luma_above).otherwise(chroma_above)
    bit = F.call_function("shiftleft", F.lit(1), F.lit(5) - F.col("blk"))
    return blocks.groupBy(*keys).agg(
        F.sum(F.when(sad > limit, bit).otherwise(0)).cast("int").alias("cbp"), F.count(F.lit(1)).alias("blocks"))


def bit_exact_run(errors: DataFrame, min_psnr: float = 90.0) -> DataFrame:
    """Per clip: frames compared, first frame that fails (any plane under the mark, or not comparable)
    and the length of the exact run before it. Frame numbers are taken to be consecutive."""
    fails = (F.col("psnr") < min_psnr) | F.col("psnr").isNull()
    per = errors.groupBy("clip_id").agg(
        F.min("frame_no").alias("first_frame"),
        F.max("frame_no").alias("last_frame"),
        F.min(F.when(fails, F.col("frame_no"))).alias("first_failure"),
    )
    end = F.coalesce(F.col("first_failure"), F.col("last_frame") + 1)
    return per.select(
        "clip_id", (F.col("last_frame") - F.col("first_frame") + 1).alias("frames"), "first_failure",
        (end - F.col("first_frame")).alias("exact_run"))


def check_clips(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """Frame count and picture size per clip against expectations (clip_id, frames, width, height)."""
    seen = frames.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("got_frames"),
        F.min(F.struct("width", "height")).alias("lo"), F.max(F.struct("width", "height")).alias("hi"))
    want = expected.select("clip_id", "frames", F.struct("width", "height").alias("size"))
    verdict = (
        F.when(F.col("got_frames").isNull(), "missing")
        .when(F.col("frames").isNull(), "unexpected")
        .when(F.col("got_frames") != F.col("frames"), "frame_count")
        .when((F.col("lo") != F.col("size")) | (F.col("hi") != F.col("size")), "dimensions")
        .otherwise("ok")
    )
    return seen.join(want, "clip_id", "full_outer").select(
        "clip_id", "got_frames", F.col("frames").alias("want_frames"), verdict.alias("verdict"))
