"""Packet and frame tables: codec binding, groups of pictures, references, key frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions.codecs import (
    KEYFRAME_FLAG,
    frame_header,
    frame_status,
    frame_type,
    is_video,
    size_ok,
    version_of,
    wmv1_bit_rate,
)
from cinelake.operators.lookup import lookup_join, shuffled
from cinelake.operators.scan import CHUNK_ROWS, Running, ordered_scan
from cinelake.session import saved

FILE = ["file_id"]
CHUNK_HEADER = 8


def with_codec(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Give every packet its stream's FourCC, version, size and extradata.

    Packets whose file has no stream row keep nulls. ``streams`` has one row per file.
    """
    return lookup_join(packets, _codecs(streams), FILE, "left", computed=True)


def _codecs(streams: DataFrame) -> DataFrame:
    return streams.select(
        "file_id", "fourcc", version_of(F.col("fourcc")).alias("version"), "width", "height", "extradata"
    )


def with_config(frames: DataFrame, rl_chroma: int = 1, rl: int = 2, dc: int = 1) -> DataFrame:
    """Frames that use one combination of code tables."""
    h = F.col("header")
    return frames.filter((h["rl_chroma"] == rl_chroma) & (h["rl"] == rl) & (h["dc"] == dc))


def by_config(frames: DataFrame) -> DataFrame:
    """Frames in the order of their code tables, so that a written table's row groups each hold few combinations.

    ``with_config`` over such a table skips the others. A combination that holds many frames is split along their order.
    """
    order = [F.col("header")[n] for n in ("rl_chroma", "rl", "dc")] + [F.col(c) for c in ("file_id", "seq") if c in frames.columns]
    return frames.repartitionByRange(*order).sortWithinPartitions(*order)


def _intra() -> Column:
    return F.col("frame_type") == "I"


def _inter() -> Column:
    return F.col("frame_type") == "P"


def _ok() -> Column:
    """Usable as a reference: a header that could not be read to its end is no fault of the frame."""
    return F.col("status").isin("ok", "header_unread")


def _gop_outputs() -> dict[str, Running]:
    return {
        "gop_id": Running("sum", _intra().cast("bigint")),
        "_distance": Running("since", _inter().cast("bigint"), reset=_intra()),
    }


def _gop_columns(df: DataFrame) -> DataFrame:
    in_gop = (F.col("gop_id") > 0) & (F.col("frame_type") != "empty")
    index = F.when(in_gop, F.col("_distance"))
    return df.withColumns({"p_index": index, "no_rounding": index % 2 == 0}).drop("_distance")


def gops(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the groups of pictures of each file.

    ``gop_id`` counts I frames so far (0 = before the first), ``p_index`` is the distance in P frames
    from the group's I frame (null in group 0), ``no_rounding`` holds on even distances.
    """
    return _gop_columns(ordered_scan(frames, FILE, ["seq"], _gop_outputs(), chunk_rows=chunk_rows))


def _rate_outputs() -> dict[str, Running]:
    return {"bit_rate": Running("last", F.when(_intra(), F.col("bit_rate")))}


def carry_bit_rate(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Replace ``bit_rate`` by the rate of the latest I frame that states one."""
    return ordered_scan(frames, FILE, ["seq"], _rate_outputs(), chunk_rows=chunk_rows)


def _reference_outputs() -> dict[str, Running]:
    return {
        "_ok_intra_before": Running("sum_before", (_intra() & _ok()).cast("bigint")),
        "_ok_before": Running("last_before", F.when(_ok(), F.col("seq"))),
    }


def _reference_columns(df: DataFrame) -> DataFrame:
    # Once one I frame has decoded, every later good frame is a reference; before that none is.
    ref = F.when(_inter() & (F.col("_ok_intra_before") > 0), F.col("_ok_before"))
    status = F.when(_inter() & (F.col("_ok_intra_before") == 0), "no_reference").otherwise(F.col("status"))
    return df.withColumns({"ref_seq": ref, "status": status}).drop("_ok_intra_before", "_ok_before")


def attach_reference(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As-of join of each P frame to the latest usable frame before it (``ref_seq``).

    A frame is usable when its ``status`` is ``ok`` and, for P, a reference exists. P frames without
    one get status ``no_reference``.
    """
    scanned = ordered_scan(frames, FILE, ["seq"], _reference_outputs(), chunk_rows=chunk_rows)
    return _reference_columns(scanned)


def track(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Groups of pictures, carried bit rate and references in one scan of the frames."""
    outputs = {**_gop_outputs(), **_reference_outputs()}
    if "bit_rate" in frames.columns:
        outputs.update(_rate_outputs())
    return _reference_columns(_gop_columns(ordered_scan(frames, FILE, ["seq"], outputs, chunk_rows=chunk_rows)))


def frames_table(packets: DataFrame, streams: DataFrame, chunk_rows: int = CHUNK_ROWS, written: bool = False) -> DataFrame:
    """The frames of whole files, as far as headers tell: type, header fields, group, reference, status.

    A WMV1 P header depends on the bit rate of its I frame, and references depend on the header, so
    the packets are scanned twice if there is a WMV1 stream. The thin packet rows and the coded frames are each written
    once, so that no scan walks the files again; ``written`` packets are not written a second time.
    """
    thin = packets.select("file_id", "seq", "byte_offset", "size", "head")
    codecs = saved(_codecs(streams), "lookup")
    bound = lookup_join(thin if written else saved(thin, "packets"), codecs, FILE, "left")
    version, head = F.col("version"), F.col("head")
    typed = bound.withColumn("frame_type", frame_type(version, head))
    rated = typed.withColumn("bit_rate", F.when((version == "wmv1") & _intra(), wmv1_bit_rate(head)))
    if not codecs.filter(version == "wmv1").isEmpty():  # others state no rate
        rated = carry_bit_rate(rated, chunk_rows)
    coded = frame_header(rated, bit_rate="bit_rate", extradata="extradata")
    status = frame_status(version, F.col("frame_type"), F.col("header"))
    kept = ["file_id", "seq", "byte_offset", "size", "version", "width", "height", "frame_type", "bit_rate", "header"]
    return track(saved(coded.select(*kept, status.alias("status")), "frames"), chunk_rows)


def gop_profile(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per file: frames, groups of pictures, longest P run, frames without a reference.

    Built on a per-group aggregate (partial sums before the shuffle), then one row per file.
    """
    tracked = track(frames, chunk_rows)
    per_gop = tracked.groupBy("file_id", "gop_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_inter().cast("bigint")).alias("p"),
        F.sum((F.col("status") == "no_reference").cast("bigint")).alias("orphans"),
    )
    return per_gop.groupBy("file_id").agg(
        F.sum("n").alias("frames"),
        F.max("gop_id").alias("gops"),
        F.max(F.when(F.col("gop_id") > 0, F.col("p")).otherwise(0)).alias("longest_p_run"),
        F.sum("orphans").alias("no_reference"),
    )


def offsets(sizes: DataFrame, size: str = "size", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Byte position of each packet in the concatenation of its file's packets."""
    out = {"byte_offset": Running("sum_before", F.col(size).cast("bigint"))}
    return ordered_scan(sizes, FILE, ["seq"], out, chunk_rows=chunk_rows)


def keyframe_at(
    index: DataFrame, fraction: float = 0.10, chunk_rows: int = CHUNK_ROWS, max_size: int | None = None
) -> DataFrame:
    """Key entry at a fraction of each file's key entries: the ``int(n * fraction)``-th, clamped.

    When ``index`` has ``frame_type``, a first entry that is not intra rejects the index (no row), and
    a target that is not intra falls back to the first. Entries over ``max_size``, if given, do not
    count. Returns file_id, key_count, entry_no and byte_offset of the first and the picked entry.
    """
    keys = index.filter(
        is_video(F.col("chunk_id"))
        & (F.col("flags").bitwiseAND(KEYFRAME_FLAG) != 0)
        & size_ok(F.col("size"), 1, max_size)
    )
    ranked = ordered_scan(
        keys,
        FILE,
        ["entry_no"],
        {"_rank": Running("sum_before", F.lit(1)), "key_count": Running("total_sum", F.lit(1))},
        chunk_rows=chunk_rows,
    )
    n = F.col("key_count")
    wanted = F.greatest(F.lit(0), F.least(n - 1, (n * F.lit(fraction)).cast("bigint")))
    entry = ["entry_no", "byte_offset"]
    checked = "frame_type" in index.columns
    fields = F.struct(*entry, *(["frame_type"] if checked else []))
    picked = (
        ranked.filter((F.col("_rank") == 0) | (F.col("_rank") == wanted))
        .groupBy(*FILE)
        .agg(
            F.max("key_count").alias("key_count"),
            F.max(F.when(F.col("_rank") == 0, fields)).alias("first"),
            F.max(F.when(F.col("_rank") == wanted, fields)).alias("target"),
        )
    )
    if checked:
        picked = picked.filter(F.col("first.frame_type") == "I").withColumn(
            "target", F.when(F.col("target.frame_type") == "I", F.col("target")).otherwise(F.col("first"))
        )
    return picked.select(
        "file_id",
        "key_count",
        F.col("first.entry_no").alias("first_entry"),
        F.col("first.byte_offset").alias("first_offset"),
        F.col("target.entry_no").alias("entry_no"),
        F.col("target.byte_offset").alias("byte_offset"),
    )


def _whole(packets: DataFrame) -> DataFrame:
    """Packets that lie whole inside their file."""
    return packets.filter(~F.col("truncated")) if "truncated" in packets.columns else packets


def keyframe_from(
    packets: DataFrame, fraction: float = 0.10, max_size: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """First I packet whose chunk starts at or after a fraction of the media bytes.

    The media range is ``movi_start``..``file_length`` when the packets carry them, else the range
    the packets span. A chunk over ``max_size``, if given, ends the walk; a truncated packet is no candidate.
    """
    pos, size = F.col("byte_offset"), F.col("size")
    has_range = {"movi_start", "file_length"} <= set(packets.columns)
    outputs = {} if max_size is None else {"_stop": Running("total_min", F.when(size > max_size, pos))}
    if not has_range:
        outputs["movi_start"] = Running("total_min", pos)
        outputs["file_length"] = Running("total_max", pos + CHUNK_HEADER + size)
    ranged = ordered_scan(packets, FILE, ["seq"], outputs, chunk_rows=chunk_rows) if outputs else packets
    start = F.col("movi_start")
    target = start + ((F.col("file_length") - start) * F.lit(fraction)).cast("bigint")
    hit = _whole(ranged).filter(_intra() & (size > 0) & (pos >= target))
    if max_size is not None:
        hit = hit.filter(F.col("_stop").isNull() | (pos < F.col("_stop")))
    return _earliest(hit)


def first_keyframe(packets: DataFrame, window: int | None = None) -> DataFrame:
    """First I packet of each file, optionally only among packets inside the first ``window`` bytes."""
    hit = _whole(packets).filter(_intra() & (F.col("size") > 0))
    if window is not None:
        hit = hit.filter(F.col("byte_offset") + CHUNK_HEADER + F.col("size") <= window)
    return _earliest(hit)


def _earliest(hit: DataFrame) -> DataFrame:
    best = F.min(F.struct("byte_offset", "seq"))
    return hit.groupBy(*FILE).agg(best.alias("b")).select("file_id", "b.seq", "b.byte_offset")


def thumbnail_packet(
    packets: DataFrame,
    index: DataFrame | None = None,
    fraction: float = 0.10,
    window: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One packet per file to show: by index, else by byte fraction, else the first I packet.

    ``index`` entries carry the file offset of their chunk header in ``byte_offset``; only the two
    candidate entries of a file are looked up among the packets to learn their frame type.
    Returns file_id, byte_offset and which rule found it.
    """
    columns = ["file_id", "byte_offset", "rule"]
    walked = keyframe_from(packets, fraction, chunk_rows=chunk_rows).select(
        "file_id", "byte_offset", F.lit(2).alias("rank"), F.lit("fraction").alias("rule"))
    scanned = first_keyframe(packets, window).select(
        "file_id", "byte_offset", F.lit(3).alias("rank"), F.lit("first").alias("rule"))
    found = walked.unionByName(scanned)
    if index is not None:
        picks = keyframe_at(index, fraction, chunk_rows=chunk_rows)
        tried = picks.select(
            "file_id", F.explode(F.array(
                F.struct(F.lit(True).alias("is_first"), F.col("first_offset").alias("byte_offset")),
                F.struct(F.lit(False).alias("is_first"), F.col("byte_offset").alias("byte_offset")),
            )).alias("c"),
        ).select("file_id", "c.is_first", "c.byte_offset")
        known = _whole(packets).filter(_intra()).select("file_id", "byte_offset")
        seen = (
            tried.join(shuffled(known), ["file_id", "byte_offset"])
            .groupBy("file_id")
            .agg(
                F.max(F.when(F.col("is_first"), F.col("byte_offset"))).alias("first"),
                F.max(F.when(~F.col("is_first"), F.col("byte_offset"))).alias("target"),
            )
            .filter(F.col("first").isNotNull())
        )
        found = found.unionByName(
            seen.select("file_id", F.coalesce("target", "first").alias("byte_offset"),
                        F.lit(1).alias("rank"), F.lit("index").alias("rule")))
    best = F.min(F.struct("rank", "byte_offset", "rule"))
    return found.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.byte_offset", "b.rule").select(*columns)


def reconcile_index(index: DataFrame, packets: DataFrame) -> DataFrame:
    """Index entries against walked chunks by file offset; both sides' leftovers are reported."""
    i = index.select(
        "file_id", "byte_offset", "entry_no", F.col("chunk_id").alias("index_id"), F.col("size").alias("index_size"))
    p = packets.select(
        "file_id", "byte_offset", "seq", F.col("chunk_id").alias("packet_id"), F.col("size").alias("packet_size"))
    joined = i.join(p, ["file_id", "byte_offset"], "full_outer")
    kind = (
        F.when(F.col("seq").isNull(), "index_only")
        .when(F.col("entry_no").isNull(), "packet_only")
        .when(F.col("index_id") != F.col("packet_id"), "id_mismatch")
        .when(F.col("index_size") != F.col("packet_size"), "size_mismatch")
        .otherwise("match")
    )
    return joined.withColumn("class", kind)


def head_per_file(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """First ``n`` rows of each file; Spark limits each task's group before the shuffle."""
    w = Window.partitionBy(*FILE).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def config_histogram(frames: DataFrame, *columns: str | Column) -> DataFrame:
    """Frames per combination of the given columns (default: frame type)."""
    return frames.groupBy(*(columns or ("frame_type",))).agg(F.count(F.lit(1)).alias("frames"))
