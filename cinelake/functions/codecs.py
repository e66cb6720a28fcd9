"""Codec identity, packet predicates and picture headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions.bits import bits, word, word_bits, word_c3

# fixed values: FourCC aliases per bitstream version
FOURCC_ALIASES: dict[str, list[str]] = {
    "v1": ["MP41", "DIV1", "MPG4"],
    "v2": ["MP42", "DIV2"],
    "v3": ["DIV3", "MP43", "DIV4", "DIV5", "DIV6", "AP41", "COL1", "COL0", "MPG3", "DVX3", "3IV1", "3IVD"],
    "wmv1": ["WMV1", "WMV7"],
    "wmv2": ["WMV2", "WMV8"],
}

# fixed values: which of the three pattern tables a WMV2 P frame uses, by quantiser band and index
WMV2_PATTERN_TABLE = [[0, 2, 1], [1, 0, 2], [2, 1, 0]]

# a WMV1 stream faster than this carries one extra header bit
PER_MB_TABLE_BIT_RATE = 50 * 1024

KEYFRAME_FLAG = 0x10


def version_of(fourcc: Column) -> Column:
    """Bitstream version of a FourCC (trimmed, any case); null when unknown.

    Twenty-one aliases fit in the expression itself, so no join is needed.
    """
    code = F.upper(F.trim(fourcc))
    out = None
    for version, aliases in FOURCC_ALIASES.items():
        hit = code.isin(aliases)
        out = F.when(hit, version) if out is None else out.when(hit, version)
    return out


def fourcc_version(df: DataFrame, fourcc: str = "fourcc") -> DataFrame:
    """Add ``version`` and ``status`` (``ok`` or ``unknown_codec``)."""
    version = version_of(F.col(fourcc))
    return df.withColumns(
        {"version": version, "status": F.when(version.isNull(), "unknown_codec").otherwise("ok")}
    )


def is_video(chunk_id: Column, stream_no: int = 0) -> Column:
    """Compressed or uncompressed video chunk of one stream."""
    return chunk_id.isin(f"{stream_no:02d}dc", f"{stream_no:02d}db")


def size_ok(size: Column, lo: int = 1, hi: int | None = None) -> Column:
    """Whether a payload size is believed; without ``hi`` any size from ``lo`` is."""
    return size >= lo if hi is None else size.between(lo, hi)


def frame_type(version: Column, payload: Column) -> Column:
    """``I``, ``P`` or ``empty``; the coding-type field sits elsewhere in v1 and is one bit in wmv2."""
    intra = (
        F.when(version == "wmv2", bits(payload, 0, 1) == 0)
        .when(version == "v1", bits(payload, 37, 2) == 0)
        .otherwise(bits(payload, 0, 2) == 0)
    )
    return (
        F.when(payload.isNull() | (F.octet_length(payload) == 0), "empty")
        .when(intra, "I")
        .otherwise("P")
    )


def wmv1_bit_rate(payload: Column) -> Column:
    """Bit rate of a WMV1 I frame (bits per second)."""
    return (bits(payload, 17, 11) * 1024).cast("int")


def wmv2_flags(extradata: Column) -> Column:
    """Feature flags of a WMV2 stream; without four bytes of extradata the encoder's defaults hold."""
    present = F.coalesce(F.octet_length(extradata) >= 4, F.lit(False))

    def flag(pos: int, default: int) -> Column:
        return F.when(present, bits(extradata, pos, 1).cast("int")).otherwise(default)

    return F.struct(
        F.when(present, bits(extradata, 0, 5).cast("int")).alias("fps"),
        F.when(present, (bits(extradata, 5, 11) * 1024).cast("int")).alias("bit_rate"),
        flag(16, 1).alias("mspel"),
        flag(17, 0).alias("loop_filter"),
        flag(18, 1).alias("abt"),
        flag(19, 1).alias("j_type"),
        flag(20, 0).alias("top_left_mv"),
        flag(21, 1).alias("per_mb_rl"),
    )


HEADER_FIELDS = [
    "frame_no", "qscale", "slice_code", "bit_rate", "flipflop", "i7", "j_type", "skip_coded", "skip_type",
    "pattern_index", "pattern_table", "mspel", "per_mb_abt", "abt_type", "per_mb_rl",
    "rl_chroma", "rl", "dc", "mv", "header_bits",
]


def frame_header(
    frames: DataFrame,
    version: str = "version",
    ftype: str = "frame_type",
    payload: str = "head",
    bit_rate: str | None = None,
    extradata: str | None = None,
) -> DataFrame:
    """Add ``header``, a struct of picture-header fields; a field the version lacks is null.

    ``bit_rate`` names the carried rate for WMV1 P frames, ``extradata`` the WMV2 flags. Only the
    first seven bytes are read, so the packet table's ``head`` column serves. Fields at a fixed bit
    come from one projection; each variable-length field then gets a projection of its own, so that
    the running position is computed once per row instead of being nested in every later field.
    """
    v, t, w, pos = F.col(version), F.col(ftype), F.col("_w"), F.col("_pos")
    is_i, is_p = t == "I", t == "P"
    wmv2_i, wmv2_p = (v == "wmv2") & is_i, (v == "wmv2") & is_p

    def at(p: int, n: int, scale: int = 1) -> Column:
        return (word_bits(w, p, n) * scale).cast("int")

    fixed = {
        "frame_no": F.when(v == "v1", at(32, 5)),
        "qscale": F.when(v == "v1", at(39, 5)).when(wmv2_i, at(8, 5)).when(wmv2_p, at(1, 5)).when(
            v.isNotNull() & (is_i | is_p), at(2, 5)
        ),
        "slice_code": F.when((v == "v1") & is_i, at(44, 5)).when(v.isin("v2", "v3", "wmv1") & is_i, at(7, 5)),
        "bit_rate": F.when((v == "wmv1") & is_i, at(17, 11, 1024)),
        "flipflop": F.when((v == "wmv1") & is_i, at(28, 1)),
        "i7": F.when(wmv2_i, at(1, 7)),
        "skip_coded": F.when(v.isin("v2", "v3", "wmv1") & is_p, at(7, 1)),
        "skip_type": F.when(wmv2_p, at(6, 2)),
        # where the variable part starts, or where the header ends when there is none
        "header_bits": F.when(v == "v1", F.when(is_i, 49).otherwise(44))
        .when(v == "v2", F.when(is_i, 12).otherwise(8))
        .when(v == "v3", F.when(is_i, 12).otherwise(8))
        .when(v == "wmv1", F.when(is_i, 29).otherwise(8))
        .when(v == "wmv2", F.when(is_i, 13).otherwise(8)),
    }
    rate = F.col(bit_rate) if bit_rate else F.lit(None).cast("int")
    flags = wmv2_flags(F.col(extradata) if extradata else F.lit(None).cast("binary"))
    df = frames.withColumns({"_w": word(F.col(payload)), "_flags": flags})
    df = df.withColumns({f"_{n}": c for n, c in fixed.items()})
    df = df.withColumns(
        {
            # Past the skip type a WMV2 P header has a fixed place only when no skip map follows it.
            "_tail": v.isin("v3", "wmv1") | wmv2_i | (wmv2_p & (F.col("_skip_type") == 0)),
            "_fast": (F.when(is_i, F.col("_bit_rate")).otherwise(F.coalesce(rate, F.lit(0))) > PER_MB_TABLE_BIT_RATE)
            & (v == "wmv1"),
            "_pos": F.col("_header_bits"),
        }
    )
    flag = F.col("_flags")
    tail = F.col("_tail")
    tail_p2 = tail & wmv2_p

    def one_bit(df: DataFrame, name: str, read: Column, known: Column) -> DataFrame:
        """Next bit where ``read``; 0 where the field exists (``known``) but is not coded."""
        return df.withColumns(
            {
                f"_{name}": F.when(read, word_bits(w, pos, 1).cast("int")).when(known, 0),
                "_pos": pos + F.when(read, 1).otherwise(0),
            }
        )

    def three_valued(df: DataFrame, name: str, read: Column, known: Column) -> DataFrame:
        value, used = word_c3(w, pos)
        return df.withColumns(
            {f"_{name}": F.when(read, value).when(known, 0), "_pos": pos + F.when(read, used).otherwise(0)}
        )

    df = three_valued(df, "pattern_index", tail_p2, F.lit(False))
    df = one_bit(df, "mspel", tail_p2 & (flag["mspel"] == 1), tail_p2)
    df = one_bit(df, "abt_bit", tail_p2 & (flag["abt"] == 1), F.lit(False))
    df = three_valued(df, "abt_type", tail_p2 & (F.col("_abt_bit") == 1), tail_p2)
    df = one_bit(df, "j_type", wmv2_i & (flag["j_type"] == 1), wmv2_i)
    wmv2_tail = tail & (v == "wmv2")
    df = one_bit(
        df, "per_mb_rl", (wmv2_tail & (flag["per_mb_rl"] == 1)) | (tail & F.col("_fast")), wmv2_tail | (v == "wmv1")
    )
    per_picture = F.coalesce(F.col("_per_mb_rl"), F.lit(0)) == 0
    df = three_valued(df, "rl_chroma", tail & is_i & per_picture, tail & is_i)
    df = three_valued(df, "rl", tail & (is_p | per_picture), tail)
    df = one_bit(df, "dc", tail, F.lit(False))
    df = one_bit(df, "mv", tail & is_p, F.lit(False))

    band = F.when(F.col("_qscale") > 20, 2).when(F.col("_qscale") > 10, 1).otherwise(0)
    rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in WMV2_PATTERN_TABLE])
    last = {
        "pattern_table": F.get(F.get(rows, band), F.col("_pattern_index")),
        "per_mb_abt": F.when(F.col("_abt_bit").isNotNull(), 1 - F.col("_abt_bit")).when(tail_p2, 0),
        "header_bits": pos,
    }
    known = v.isNotNull() & (is_i | is_p)
    header = F.struct(*[last.get(n, F.col(f"_{n}")).cast("int").alias(n) for n in HEADER_FIELDS])
    # A filter on a header field must not be pushed below the projections: each would be pasted into the
    # next, and the condition would grow threefold per field. An outer generator stops the pushdown; a
    # plain one would have a filter on its array's size inferred and pushed.
    one = F.array(F.when(known, header))
    return df.select(*[F.col(f"`{c}`") for c in frames.columns], F.explode_outer(one).alias("header"))


def frame_status(version: Column, ftype: Column, header: Column, has_reference: Column | None = None) -> Column:
    """Why a frame could not be decoded, or ``ok``.

    v2 and v3 refuse only a zero quantiser (five bits cannot exceed 31). ``header_unread``: the fields
    behind a WMV2 skip map are unknown; nothing speaks against such a frame, so it may be a reference.
    """
    status = (
        F.when(version.isNull(), "unknown_codec")
        .when(ftype == "empty", "empty")
    )
    if has_reference is not None:
        status = status.when((ftype == "P") & ~has_reference, "no_reference")
    return (
        status.when(header["qscale"] == 0, "bad_qscale")
        .when((version == "wmv2") & (ftype == "I") & (header["j_type"] == 1), "unsupported_j_frame")
        .when(version.isin("wmv1", "wmv2") & (ftype == "P") & (header["per_mb_rl"] == 1), "unsupported_per_mb_table")
        .when(
            (version == "wmv2") & (ftype == "P") & ((header["per_mb_abt"] == 1) | (header["abt_type"] != 0)),
            "unsupported_abt",
        )
        .when((version == "wmv2") & (ftype == "P") & (header["skip_type"] != 0), "header_unread")
        .otherwise("ok")
    )


def geometry(width: Column, height: Column) -> Column:
    """Macroblock grid, padded luma size and chroma size of a 4:2:0 picture."""
    cols, rows = F.shiftright(width + 15, 4), F.shiftright(height + 15, 4)
    return F.struct(
        cols.alias("mb_cols"),
        rows.alias("mb_rows"),
        (cols * 16).alias("padded_width"),
        (rows * 16).alias("padded_height"),
        F.shiftright(width + 1, 1).alias("chroma_width"),
        F.shiftright(height + 1, 1).alias("chroma_height"),
    )
