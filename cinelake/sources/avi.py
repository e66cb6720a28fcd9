"""AVI files: stream header, chunk walk and index."""

from __future__ import annotations

from collections.abc import Generator, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinelake.functions.bits import le32
from cinelake.functions.codecs import version_of
from cinelake.sources.walk import walk_records

HEAD_BYTES = 12

STREAM_FIELDS = """container string, stream_no int, fourcc string, avih_width int, avih_height int,
    strf_width int, strf_height int, extradata binary, movi_start bigint, movi_end bigint, status string"""

PACKET_FIELDS = """seq bigint, chunk_id string, byte_offset bigint, size int, head binary,
    payload binary, truncated boolean"""


INDEX_FIELDS = "movi_start bigint, idx binary"


def _u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, body position, size) of the chunks in a range; bodies are padded to an even size."""
    while at + 8 <= end:
        size = _u32(data, at + 4)
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def _is_list(data: bytes, chunk: tuple[bytes, int, int], kind: bytes) -> bool:
    name, body, _ = chunk
    return name == b"LIST" and data[body : body + 4] == kind


def _stream_lists(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of the stream lists, nested in the header list or at the top level, before the media."""
    for top in _chunks(data, 12, len(data)):
        _, body, size = top
        if _is_list(data, top, b"movi"):
            return
        if _is_list(data, top, b"strl"):
            yield body + 4, min(body + size, len(data))
        elif _is_list(data, top, b"hdrl"):
            end = min(body + size, len(data))
            for inner in _chunks(data, body + 4, end):
                if _is_list(data, inner, b"strl"):
                    yield inner[1] + 4, min(inner[1] + inner[2], end)


def _main_size(data: bytes) -> tuple[int, int]:
    for top in _chunks(data, 12, len(data)):
        if _is_list(data, top, b"movi"):
            break
        if _is_list(data, top, b"hdrl"):
            for name, body, size in _chunks(data, top[1] + 4, min(top[1] + top[2], len(data))):
                if name == b"avih" and size >= 40 and body + 40 <= len(data):
                    return _u32(data, body + 32), _u32(data, body + 36)
    return 0, 0


def _movi_range(data: bytes) -> tuple[int, int] | None:
    for top in _chunks(data, 12, len(data)):
        if _is_list(data, top, b"movi"):
            return top[1] + 4, min(top[1] + top[2], len(data))
    return None


def is_avi(data: bytes) -> bool:
    return len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == b"AVI "


def _describe(data: bytes) -> Iterator[tuple]:
    """One row: the first video stream's header fields."""
    if not is_avi(data):
        return
    movi = _movi_range(data)
    avih_w, avih_h = _main_size(data)
    number, fourcc, w, h, extra = None, None, 0, 0, None
    for n, (start, end) in enumerate(_stream_lists(data)):
        handler = bitmap = None
        for name, body, size in _chunks(data, start, end):
            if name == b"strh" and data[body : body + 4] == b"vids" and body + 8 <= end:
                handler = data[body + 4 : body + 8]
            elif name == b"strf" and size >= 20 and body + 20 <= end:
                bitmap = (body, size)
        if handler is None:
            continue
        number, fourcc = n, handler
        if bitmap:
            body, size = bitmap
            compression = data[body + 16 : body + 20]
            fourcc = compression if any(compression) else handler
            w = int.from_bytes(data[body + 4 : body + 8], "little", signed=True)
            h = abs(int.from_bytes(data[body + 8 : body + 12], "little", signed=True))
            if size > 40 and body + size <= len(data):
                extra = data[body + 40 : body + size]
        break
    status = "no_movi" if movi is None else ("no_video" if number is None else "ok")
    start, end = movi or (None, None)
    name = fourcc.decode("latin-1") if fourcc else None
    yield "avi", number, name, _int32(avih_w), _int32(avih_h), w, _int32(h), extra, start, end, status


def _int32(v: int) -> int:
    """Keep a malformed unsigned size inside INT."""
    return v if v < 1 << 31 else v - (1 << 32)


def avi_streams(files: DataFrame) -> DataFrame:
    """One row per AVI file: FourCC, version, sizes of both headers, extradata, media range.

    ``width`` and ``height`` are the bitmap header's when it has them, else the main header's.
    Non-AVI files give no row.
    """
    raw = walk_records(files, _describe, StructType.fromDDL(STREAM_FIELDS))
    return finish_streams(raw)


def finish_streams(raw: DataFrame) -> DataFrame:
    """Add version and effective size; an unknown FourCC shows in ``status``."""
    own = (F.col("strf_width") > 0) & (F.col("strf_height") > 0)
    version = version_of(F.col("fourcc"))
    return raw.withColumns(
        {
            "version": version,
            "width": F.when(own, F.col("strf_width")).otherwise(F.col("avih_width")),
            "height": F.when(own, F.col("strf_height")).otherwise(F.col("avih_height")),
            "status": F.when((F.col("status") == "ok") & version.isNull(), "unknown_codec").otherwise(
                F.col("status")
            ),
        }
    )


VIDEO_STREAM = -1  # the first video stream of the header


def media_list(data: bytes, stream_no: int | None) -> tuple[tuple[int, int] | None, tuple[bytes, ...] | None]:
    """Range of an AVI file's media list (None: no such list) and the ids of the wanted chunks (None: all)."""
    if stream_no == VIDEO_STREAM:  # a header without a video stream leaves it at the first
        stream_no = next((row[1] for row in _describe(data)), None) or 0
    wanted = None if stream_no is None else tuple(f"{stream_no:02d}{k}".encode() for k in ("dc", "db"))
    return _movi_range(data) if is_avi(data) else None, wanted


def chunk_end(data: bytes, at: int) -> int:
    """Where the header after the one at ``at`` stands."""
    size, body = _u32(data, at + 4), at + 8
    if data[at : at + 4] == b"LIST" and data[body : body + 4] == b"rec ":
        return body + 4  # a grouping list: its chunks follow in line
    return body + size + size % 2


def media_packets(data: bytes, at: int, end: int, until: int, wanted: tuple[bytes, ...] | None, with_payload: bool,
                  max_size: int | None) -> Generator[tuple, None, int]:
    """Wanted chunks from ``at`` on whose headers start before ``until``; returns where the walk would go on."""
    seq = 0
    while at + 8 <= end and at < until:
        name, size, body, after = data[at : at + 4], _u32(data, at + 4), at + 8, chunk_end(data, at)
        grouping = after == body + 4 and name == b"LIST" and data[body:after] == b"rec "
        if max_size is not None and size > max_size and not grouping:
            return end
        if size > 0 and not grouping and (wanted is None or name in wanted):
            stop = min(body + size, len(data))
            yield (
                seq, name.decode("latin-1"), at, stop - body, data[body : min(stop, body + HEAD_BYTES)],
                data[body:stop] if with_payload else None, body + size > len(data),
            )
            seq += 1
        at = after
    return at


def _packet_walk(stream_no: int | None, with_payload: bool, max_size: int | None):
    def walk(data: bytes):
        movi, wanted = media_list(data, stream_no)
        if movi is not None:
            yield from media_packets(data, *movi, movi[1], wanted, with_payload, max_size)

    return walk


def avi_packets(
    files: DataFrame, with_payload: bool = False, stream_no: int | None = VIDEO_STREAM, max_size: int | None = None
) -> DataFrame:
    """Chunks of one stream in file order: of the file's video stream, unless ``stream_no`` names another (None: every
    chunk of the media list).

    ``byte_offset`` is the position of the chunk header; ``head`` holds the first 12 bytes, enough
    for every picture header, so metadata jobs need no payload. Zero-size chunks are skipped and a
    chunk running past the end of the file comes out short with ``truncated`` set.
    """
    out = walk_records(files, _packet_walk(stream_no, with_payload, max_size), StructType.fromDDL(PACKET_FIELDS))
    return out if with_payload else out.drop("payload")


def _index_blob(data: bytes):
    movi = _movi_range(data) if is_avi(data) else None
    if movi is None:
        return
    found = next(((b, s) for name, b, s in _chunks(data, 12, len(data)) if name == b"idx1"), None)
    if found is None:  # e.g. a media list whose stated size is wrong
        at = data.rfind(b"idx1")
        if at < 0 or at + 8 > len(data):
            return
        found = at + 8, _u32(data, at + 4)
    body, size = found
    yield movi[0], data[body : body + size]


def avi_index(files: DataFrame) -> DataFrame:
    """Index entries with the file offset of their chunk header in ``byte_offset``.

    Offsets may count from the file or from the media list; entry 0, whatever its type, anchors
    them to the start of the media list. The walk only finds the index; entries are cut in SQL.
    """
    return index_entries(walk_records(files, _index_blob, StructType.fromDDL(INDEX_FIELDS)))


def index_entries(found: DataFrame) -> DataFrame:
    """Entries of whole indexes (file_id, movi_start, idx)."""
    n = F.floor(F.octet_length("idx") / 16).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("idx"), i * 16 + 1, 16))
    base = F.col("movi_start") - le32(F.col("idx"), 8)
    rows = found.filter(n > 0).select(
        "file_id", base.alias("base"), F.posexplode(cut).alias("entry_no", "entry"))
    e = F.col("entry")
    return rows.select(
        "file_id",
        "entry_no",
        F.substring(e, 1, 4).cast("string").alias("chunk_id"),
        le32(e, 4).alias("flags"),
        le32(e, 8).alias("offset"),
        le32(e, 12).alias("size"),
        (F.col("base") + le32(e, 8)).alias("byte_offset"),
    )
