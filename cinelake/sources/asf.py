"""ASF/WMV files: stream header and the fragments of media objects."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from cinelake.sources.avi import HEAD_BYTES, finish_streams
from cinelake.sources.walk import walk_records

# fixed values: object GUIDs as stored in files
HEADER = bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C")
DATA = bytes.fromhex("3626B2758E66CF11A6D900AA0062CE6C")
FILE_PROPERTIES = bytes.fromhex("A1DCAB8C47A9CF118EE400C00C205365")
STREAM_PROPERTIES = bytes.fromhex("9107DCB7B7A9CF118EE600C00C205365")
VIDEO_MEDIA = bytes.fromhex("C0EF19BC4D5BCF11A8FD00805F5C442B")

HEADER_FIXED = 30  # GUID, size, object count, reserved
DATA_FIXED = 50  # GUID, size, file id, packet count, reserved
OBJECT_FIXED = 24  # GUID, size
STREAM_FIXED = 54  # fields of a stream object before its type-specific data
VIDEO_FIXED = 11  # width, height, flags, format size
BITMAP_FIXED = 40

STREAM_FIELDS = """container string, stream_no int, fourcc string, avih_width int, avih_height int,
    strf_width int, strf_height int, extradata binary, packet_size bigint, data_offset bigint, status string"""

FRAGMENT_FIELDS = """packet_no bigint, payload_no int, stream_no int, keyframe boolean, object_no bigint,
    offset bigint, object_size bigint, size int, head binary, payload binary"""


class Layout(NamedTuple):
    packet_size: int = 0
    stream_no: int = 0
    data_offset: int | None = None
    fourcc: bytes | None = None
    width: int = 0
    height: int = 0
    extradata: bytes | None = None


def _int(data: bytes, at: int, n: int, signed: bool = False) -> int:
    return int.from_bytes(data[at : at + n], "little", signed=signed)


def _video(layout: Layout, obj: bytes) -> Layout:
    """Fold one video stream object into the layout; a later one overrides an earlier one."""
    layout = layout._replace(
        stream_no=_int(obj, 48, 2) & 0x7F, fourcc=None, width=0, height=0, extradata=None
    )
    typed = obj[STREAM_FIXED : STREAM_FIXED + _int(obj, 40, 4)]
    if len(obj) < STREAM_FIXED or len(typed) < 35:
        return layout
    bitmap = typed[VIDEO_FIXED:]
    size = _int(bitmap, 0, 4)
    return layout._replace(
        width=_int(typed, 0, 4, signed=True),
        height=abs(_int(typed, 4, 4, signed=True)),
        fourcc=bitmap[16:20] if size >= 20 else None,
        extradata=bitmap[BITMAP_FIXED:size] if BITMAP_FIXED < size <= len(bitmap) else None,
    )


def read_layout(data: bytes) -> Layout | None:
    """Header of an ASF file, or None when it is not one. ``data_offset`` is None when unusable."""
    if len(data) < HEADER_FIXED or data[:16] != HEADER:
        return None
    layout = Layout()
    end = _int(data, 16, 8)
    if not HEADER_FIXED <= end <= len(data):
        return layout
    at = HEADER_FIXED
    while at + OBJECT_FIXED <= end:
        size = _int(data, at + 16, 8)
        if size < OBJECT_FIXED or at + size > end:
            break
        guid, obj = data[at : at + 16], data[at + OBJECT_FIXED : at + size]
        if guid == FILE_PROPERTIES and len(obj) >= 72:
            layout = layout._replace(packet_size=_int(obj, 68, 4))
        elif guid == STREAM_PROPERTIES and len(obj) >= 50 and obj[:16] == VIDEO_MEDIA:
            layout = _video(layout, obj)
        at += size
    usable = layout.packet_size > 0 and layout.stream_no > 0 and end + DATA_FIXED <= len(data)
    if usable and data[end : end + 16] == DATA:
        layout = layout._replace(data_offset=end + DATA_FIXED)
    return layout


def _describe(data: bytes) -> Iterator[tuple]:
    layout = read_layout(data)
    if layout is None:
        return
    name = layout.fourcc.decode("latin-1") if layout.fourcc else None
    status = "ok" if layout.data_offset is not None else "no_data"
    yield (
        "asf", layout.stream_no, name, 0, 0, layout.width, layout.height, layout.extradata,
        layout.packet_size, layout.data_offset, status,
    )


def asf_streams(files: DataFrame) -> DataFrame:
    """One row per ASF file: FourCC, version, size, extradata, packet size and data position."""
    return finish_streams(walk_records(files, _describe, StructType.fromDDL(STREAM_FIELDS)))


class _Reader:
    """Position inside one data packet; fields past the end read as 0."""

    def __init__(self, packet: bytes, at: int):
        self.packet, self.at = packet, at

    def sized(self, length_type: int) -> int:
        n = (0, 1, 2, 4)[length_type]
        if self.at + n > len(self.packet):
            return 0
        self.at += n
        return _int(self.packet, self.at - n, n)


def payloads(packet: bytes) -> Iterator[tuple]:
    """Payloads of one data packet: (stream, keyframe, object, offset, object size, bytes).

    A field that runs past the packet's data ends the packet.
    """
    start = 1 + (packet[0] & 0x0F) if packet and packet[0] & 0x80 else 0
    if start + 2 > len(packet):
        return
    lengths, props = packet[start], packet[start + 1]
    r = _Reader(packet, start + 2)
    r.sized(lengths >> 5 & 3)  # packet length
    r.sized(lengths >> 1 & 3)  # sequence
    padding = r.sized(lengths >> 3 & 3)
    r.at += 6  # send time, duration
    if r.at > len(packet):
        return
    end = len(packet) - padding if padding <= len(packet) else len(packet)
    several = lengths & 1
    count, length_type = 1, 0
    if several:
        if r.at >= end:
            return
        count, length_type = packet[r.at] & 0x3F, packet[r.at] >> 6
        r.at += 1
    for _ in range(count):
        if r.at >= end:
            return
        number = packet[r.at]
        r.at += 1
        object_no = r.sized(props >> 4 & 3)
        offset = r.sized(props >> 2 & 3)
        extra = r.sized(props & 3)
        object_size = _int(packet, r.at, 4) if extra >= 8 and r.at + 8 <= end else 0
        if r.at + extra > end:
            return
        r.at += extra
        size = r.sized(length_type) if several else end - r.at
        if r.at + size > end:
            return
        yield number & 0x7F, number >= 0x80, object_no, offset, object_size, packet[r.at : r.at + size]
        r.at += size


def asf_fragments(files: DataFrame, stream_no: int | None = -1, with_payload: bool = True) -> DataFrame:
    """Fragments of media objects in arrival order (packet_no, payload_no).

    ``stream_no=-1`` keeps the file's video stream, ``None`` every stream. A trailing partial packet
    is dropped. ``size`` repeats the payload's length and ``head`` its first 12 bytes, so that bookkeeping and
    headers need no payload; without ``with_payload`` none leaves the walk.
    """

    out = walk_records(files, _fragment_walk(stream_no, with_payload), StructType.fromDDL(FRAGMENT_FIELDS))
    return out if with_payload else out.drop("payload")


def _fragment_walk(stream_no: int | None, with_payload: bool, start: int = 0, until: int | None = None):
    """Walk the packets that start from ``start`` on and before ``until``: all of them by default."""

    def walk(data: bytes):
        layout = read_layout(data)
        if layout is None or layout.data_offset is None:
            return
        wanted = layout.stream_no if stream_no == -1 else stream_no
        step, first = layout.packet_size, layout.data_offset
        whole = (len(data) - first) // step
        if until is not None:
            whole = min(whole, -(-(until - first) // step))
        for n in range(max(0, -(-(start - first) // step)), whole):
            at = first + n * step
            for i, (stream, key, obj, offset, total, body) in enumerate(payloads(data[at : at + step])):
                if wanted is None or stream == wanted:
                    yield n, i, stream, key, obj, offset, total, len(body), body[:HEAD_BYTES], body if with_payload else None

    return walk
