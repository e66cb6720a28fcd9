"""Container bytes as column expressions: the writer side of the readers, for round trips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinelake.functions.bits import le_bytes

EMPTY = b""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once although ``use`` mentions it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def join_bytes(parts: Column) -> Column:
    """Concatenate an array of BINARY in one linear pass (by way of hex)."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def int_le(value: int, n: int) -> Column:
    return F.lit(value.to_bytes(n, "little"))


def chunk(name: str, body: Column) -> Column:
    """One RIFF chunk, padded to an even size."""

    def wrap(b: Column) -> Column:
        size = F.octet_length(b)
        pad = F.when(size % 2 == 1, F.lit(b"\0")).otherwise(F.lit(EMPTY))
        return F.concat(F.lit(name.encode()), le_bytes(size, 4), b, pad)

    return let(body, wrap)


def list_chunk(kind: str, body: Column) -> Column:
    return chunk("LIST", F.concat(F.lit(kind.encode()), body))


def avi_header(fourcc: Column, width: int, height: int) -> Column:
    """Header list of one video stream; the main header's size fields stay zero."""
    avih = chunk("avih", F.lit(bytes(44)))
    strh = chunk("strh", F.concat(F.lit(b"vids"), fourcc, F.lit(bytes(48))))
    strf = chunk(
        "strf",
        F.concat(int_le(40, 4), int_le(width, 4), int_le(height, 4), int_le(1, 2), int_le(24, 2), fourcc,
                 F.lit(bytes(20))),
    )
    return list_chunk("hdrl", F.concat(avih, list_chunk("strl", F.concat(strh, strf))))


def avi_file(fourcc: Column, chunks: Column, tail: Column | None = None, width: int = 96, height: int = 64) -> Column:
    """An AVI file around ready-made chunks, optionally followed by more top-level chunks."""
    parts = [F.lit(b"AVI "), avi_header(fourcc, width, height), list_chunk("movi", join_bytes(chunks))]
    if tail is not None:
        parts.append(tail)
    return chunk("RIFF", F.concat(*parts))


def object_pieces(payload: Column, number: Column, step: int) -> Column:
    """A media object cut into fragments of ``step`` bytes: number, offset, total size, body. No bytes, no fragments."""
    total = F.octet_length(payload)
    n = F.ceil(total / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(
        number.cast("int").alias("number"), (i * step).alias("offset"), total.alias("total"),
        F.substring(payload, i * step + 1, step).alias("body")))
    return F.filter(cut, lambda p: p["total"] > 0)


def asf_file(pieces: Column, step: int, fourcc: bytes, width: int = 96, height: int = 64) -> Column:
    """An ASF file with one fragment of ``object_pieces`` per data packet."""
    from cinelake.sources import asf

    packet = step + 32

    def obj(guid: bytes, body: Column, size: int) -> Column:
        return F.concat(F.lit(guid), int_le(24 + size, 8), body)

    props = obj(asf.FILE_PROPERTIES, F.concat(F.lit(bytes(68)), int_le(packet, 4), F.lit(bytes(8))), 80)
    bitmap = (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little")
    bitmap += bytes([1, 0, 24, 0]) + fourcc + bytes(20)
    typed = width.to_bytes(4, "little") + height.to_bytes(4, "little") + bytes([2]) + (40).to_bytes(2, "little") + bitmap
    stream = asf.VIDEO_MEDIA + bytes(24) + len(typed).to_bytes(4, "little") + bytes(4) + (1).to_bytes(2, "little")
    stream += bytes(4) + typed
    stream_obj = obj(asf.STREAM_PROPERTIES, F.lit(stream), len(stream))
    header_size = 30 + 104 + 24 + len(stream)
    header = F.concat(F.lit(asf.HEADER), int_le(header_size, 8), int_le(2, 4), F.lit(b"\x01\x02"), props, stream_obj)

    def data_packet(piece: Column) -> Column:
        body = piece["body"]
        fixed = 1 + 1 + 2 + 6 + 1 + 1 + 4 + 1 + 8  # bytes before the payload
        pad = F.lit(packet - fixed) - F.octet_length(body)
        return F.concat(
            F.lit(bytes([0b00010000, 0b00011101])),  # 16-bit padding length; 1-byte object, 4-byte offset, 1-byte extra
            le_bytes(pad, 2), F.lit(bytes(6)), F.lit(bytes([0x81])), le_bytes(piece["number"], 1),
            le_bytes(piece["offset"], 4), F.lit(bytes([8])), le_bytes(piece["total"], 4), F.lit(bytes(4)), body, F.unhex(F.repeat(F.lit("00"), pad)),
        )

    packets = F.transform(pieces, data_packet)
    data = F.concat(F.lit(asf.DATA), int_le(50, 8), F.lit(bytes(16)), int_le(0, 8), F.lit(bytes(2)), join_bytes(packets))
    return F.concat(header, data)
