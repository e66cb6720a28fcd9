"""Plain-Python container bytes for tests."""

from cinelake.sources import asf


def le(v, n):
    return int(v).to_bytes(n, "little", signed=v < 0)


def chunk(name, body, size=None):
    return name + le(len(body) if size is None else size, 4) + body + b"\0" * (len(body) % 2)


def lst(kind, body):
    return chunk(b"LIST", kind + body)


def strf(w, h, comp=b"MP41", extra=b""):
    return chunk(b"strf", le(40 + len(extra), 4) + le(w, 4) + le(h, 4) + le(1, 2) + le(24, 2) + comp + bytes(20) + extra)


def strl(kind=b"vids", handler=b"mp41", fmt=b""):
    return lst(b"strl", chunk(b"strh", kind + handler + bytes(48)) + fmt)


def avih(w=0, h=0, size=44):
    return chunk(b"avih", bytes(32) + le(w, 4) + le(h, 4) + bytes(size - 40))


def avi(streams, movi, main=None, tail=b""):
    body = b"AVI " + lst(b"hdrl", (avih() if main is None else main) + streams) + lst(b"movi", movi) + tail
    return chunk(b"RIFF", body)


def frag(stream=1, key=True, obj=0, off=0, size=0, body=b"", obj_t=1, off_t=3, repl_t=1):
    n = lambda v, t: b"" if t == 0 else le(v, (0, 1, 2, 4)[t])
    repl = le(size, 4) + bytes(4) if size else b""
    return bytes([stream | (0x80 if key else 0)]) + n(obj, obj_t) + n(off, off_t) + n(len(repl), repl_t) + repl, body


def packet(frags, width, types=(1, 3, 1), pay_t=2, pad_t=1, ec=b"", len_t=0, seq_t=0, multiple=None):
    """One data packet of ``width`` bytes; several fragments or ``multiple`` make a multiple-payload one."""
    obj_t, off_t, repl_t = types
    multiple = len(frags) > 1 if multiple is None else multiple
    n = lambda v, t: b"" if t == 0 else le(v, (0, 1, 2, 4)[t])
    head = ec + bytes([int(multiple) | seq_t << 1 | pad_t << 3 | len_t << 5, repl_t | off_t << 2 | obj_t << 4])
    body = b""
    if multiple:
        body += bytes([len(frags) | pay_t << 6])
        for h, b in frags:
            body += h + n(len(b), pay_t) + b
    else:
        body += frags[0][0] + frags[0][1]
    fixed = len(head) + len(n(0, len_t)) + len(n(0, seq_t)) + len(n(0, pad_t)) + 6 + len(body)
    pad = width - fixed
    assert pad >= 0 and (pad == 0 or pad_t)
    return head + n(width, len_t) + n(0, seq_t) + n(pad, pad_t) + bytes(6) + body + bytes(pad)


def asf_file(packets, width, fourcc=b"WMV2", w=96, h=64, extra=b"", stream_no=1, video=True, trailing=b""):
    def obj(guid, body):
        return guid + le(24 + len(body), 8) + body

    bih = le(40 + len(extra), 4) + le(w, 4) + le(h, 4) + bytes([1, 0, 24, 0]) + fourcc + bytes(20) + extra
    typed = le(w, 4) + le(h, 4) + b"\x02" + le(len(bih), 2) + bih
    sp = (asf.VIDEO_MEDIA if video else bytes(16)) + bytes(24) + le(len(typed), 4) + bytes(4)
    sp += le(stream_no, 2) + bytes(4) + typed
    objs = obj(asf.FILE_PROPERTIES, bytes(68) + le(width, 4) + bytes(8)) + obj(asf.STREAM_PROPERTIES, sp)
    header = asf.HEADER + le(30 + len(objs), 8) + le(2, 4) + b"\x01\x02" + objs
    data = asf.DATA + le(50, 8) + bytes(16) + le(len(packets), 8) + bytes(2)
    return header + data + b"".join(packets) + trailing
