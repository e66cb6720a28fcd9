import base64
import random

import pytest
from pyspark.sql import functions as F

import builders as B
from cinelake.functions.codecs import frame_type
from cinelake.operators.frames import frames_table, reconcile_index, thumbnail_packet
from cinelake.sources import asf, avi, media


def files(spark, contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id bigint, content binary")


def ch(name, body):
    return B.chunk(name, body)


def test_avi_streams(spark):
    vids = B.strl(fmt=B.strf(96, 64))
    auds = B.strl(b"auds", bytes(4), B.chunk(b"strf", bytes(60)))
    movi = ch(b"00dc", b"abc")
    rows = avi.avi_streams(files(spark, [
        B.avi(vids, movi),                                             # main header 0x0: bitmap size wins
        B.avi(auds + vids, movi, main=B.avih(10, 20)),                 # audio format over 40 bytes first
        B.avi(B.strl(fmt=B.strf(96, -64, b"\0\0\0\0")), movi),         # handler fallback, negative height
        B.avi(B.strl(fmt=B.strf(0, 0)), movi, main=B.avih(10, 20)),    # bitmap without size
        B.avi(B.strl(fmt=B.strf(8, 8, b"WMV2", b"\1\2\3\4")), movi),   # extradata
        B.avi(auds, movi),                                             # no video
        b"nothing here",
    ])).orderBy("file_id").collect()
    got = [(r.fourcc, r.version, r.width, r.height, r.avih_width, r.strf_width, r.extradata, r.stream_no, r.status)
           for r in rows]
    assert got == [
        ("MP41", "v1", 96, 64, 0, 96, None, 0, "ok"),
        ("MP41", "v1", 96, 64, 10, 96, None, 1, "ok"),
        ("mp41", "v1", 96, 64, 0, 96, None, 0, "ok"),
        ("MP41", "v1", 10, 20, 10, 0, None, 0, "ok"),
        ("WMV2", "wmv2", 8, 8, 0, 8, b"\1\2\3\4", 0, "ok"),
        (None, None, 0, 0, 0, 0, None, None, "no_video"),
    ]


def test_avi_packets(spark):
    vids = B.strl(fmt=B.strf(96, 64))
    v1 = [base64.b64decode(x) for x in ("AAABAABA/2PwG2g4P5o=", "AAABAAo3Ba8=")]
    inner = B.lst(b"rec ", ch(b"00dc", v1[1]) + ch(b"01wb", b"zz"))
    movi = ch(b"01wb", b"snd") + ch(b"00dc", v1[0]) + ch(b"00dc", b"") + inner + ch(b"00db", b"xyz")
    cut = B.avi(vids, movi)[:-2]
    rows = avi.avi_packets(files(spark, [B.avi(vids, movi), cut, b"RIFF"]), with_payload=True).collect()
    whole = sorted((r for r in rows if r.file_id == 0), key=lambda r: r.seq)
    assert [(r.chunk_id, bytes(r.payload), r.truncated) for r in whole] == [
        ("00dc", v1[0], False), ("00dc", v1[1], False), ("00db", b"xyz", False)]
    assert all(bytes(r.head) == bytes(r.payload)[:12] and r.size == len(r.payload) for r in whole)
    short = sorted((r for r in rows if r.file_id == 1), key=lambda r: r.seq)
    assert (bytes(short[-1].payload), short[-1].truncated) == (b"xy", True)
    data = B.avi(vids, movi)
    assert all(data[r.byte_offset : r.byte_offset + 4] == r.chunk_id.encode() for r in whole)
    every = avi.avi_packets(files(spark, [data]), stream_no=None).collect()
    assert sorted(r.chunk_id for r in every) == ["00db", "00dc", "00dc", "01wb", "01wb"]
    assert "payload" not in every[0].asDict()


def index_of(movi, base, flags=0x10):
    out, at = b"", 0
    while at + 8 <= len(movi):
        size = int.from_bytes(movi[at + 4 : at + 8], "little")
        out += movi[at : at + 4] + B.le(flags, 4) + B.le(at + base, 4) + B.le(size, 4)
        at += 8 + size + size % 2
    return B.chunk(b"idx1", out)


@pytest.mark.parametrize("base", [0, 4, 1000])
def test_index_anchoring(spark, base):
    movi = ch(b"01wb", b"snd") + ch(b"00dc", b"abcd") + ch(b"00dc", b"e")
    data = B.avi(B.strl(fmt=B.strf(96, 64)), movi, tail=index_of(movi, base))
    f = files(spark, [data])
    merged = reconcile_index(avi.avi_index(f), avi.avi_packets(f, stream_no=None)).orderBy("byte_offset").collect()
    assert [(r.index_id, r.index_size, r["class"]) for r in merged] == [
        ("01wb", 3, "match"), ("00dc", 4, "match"), ("00dc", 1, "match")]
    only_video = reconcile_index(avi.avi_index(f), avi.avi_packets(f)).collect()
    assert sorted(r["class"] for r in only_video) == ["index_only", "match", "match"]
    assert avi.avi_index(files(spark, [B.avi(b"", movi)])).count() == 0


def test_media_files_sniff_and_pruning(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.avi").write_bytes(B.avi(b"", b""))
    (tmp_path / "sub" / "b.wmv").write_bytes(B.asf_file([], 100))
    (tmp_path / "c.txt").write_bytes(b"<!DOCTYPE html>")
    df = media.media_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.container for r in media.sniff(df, extra={"html": b"<!DOCTYPE"}).collect()}
    assert got == {"a.avi": "avi", "b.wmv": "asf", "c.txt": "html"}
    assert media.media_files(spark, str(tmp_path), "*.avi").count() == 1
    plan = df.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_length_prefixed(spark):
    data = B.le(3, 4) + b"abc" + B.le(0, 4) + B.le(9, 4) + b"zz"
    rows = media.length_prefixed(files(spark, [data])).orderBy("record_no").collect()
    assert [(r.size, r.payload and bytes(r.payload)) for r in rows] == [(3, b"abc"), (0, None), (9, None)]


@pytest.mark.parametrize("w,h", [(4, 2), (5, 3)])
def test_i420_planes(spark, w, h):
    cw, ch_ = (w + 1) // 2, (h + 1) // 2
    rng = random.Random(1)
    raw = rng.randbytes(2 * (w * h + 2 * cw * ch_) + 3)
    got = {(r.frame_no, r.plane, r.row): r.samples for r in media.i420_planes(files(spark, [raw, b"x"]), w, h).collect()}
    want, at = {}, 0
    for f in range(2):
        for plane, pw, ph in (("Y", w, h), ("Cb", cw, ch_), ("Cr", cw, ch_)):
            for r in range(ph):
                want[f, plane, r] = list(raw[at : at + pw])
                at += pw
    assert got == want


def test_asf_streams(spark):
    rows = asf.asf_streams(files(spark, [
        B.asf_file([], 200, extra=b"\1\2\3\4"), B.asf_file([], 200, fourcc=b"wmv1", h=-64),
        B.asf_file([], 0), B.asf_file([], 200, video=False), b"x" * 50,
    ])).orderBy("file_id").collect()
    got = [(r.fourcc, r.version, r.width, r.height, r.extradata, r.packet_size, r.status) for r in rows]
    assert got == [
        ("WMV2", "wmv2", 96, 64, b"\1\2\3\4", 200, "ok"),
        ("wmv1", "wmv1", 96, 64, None, 200, "ok"),
        ("WMV2", "wmv2", 96, 64, None, 0, "no_data"),
        (None, None, 0, 0, None, 200, "no_data"),
    ]


def test_asf_fragments(spark):
    width = 120
    f = B.frag
    packets = [
        B.packet([f(obj=1, off=0, size=6, body=b"abc")], width),
        B.packet([f(obj=1, off=3, size=6, body=b"def"), f(stream=2, obj=9, body=b"snd"),
                  f(obj=2, off=0, size=2, body=b"gh")], width, pay_t=1),
        B.packet([f(obj=3, off=0, size=4, body=b"ijkl", obj_t=2, off_t=2, repl_t=2)], width, types=(2, 2, 2),
                 ec=bytes([0x82, 0, 0]), len_t=2, seq_t=1, pad_t=2),
        B.packet([f(obj=4, off=0, size=4, body=b"mnop", obj_t=3, off_t=1, repl_t=3)], width, types=(3, 1, 3),
                 len_t=3, seq_t=3, pad_t=3, multiple=True, pay_t=3),
        B.packet([f(obj=0, off=0, body=b"q" * 111, obj_t=0, off_t=0, repl_t=0)], width, types=(0, 0, 0), pad_t=0),
    ]
    data = B.asf_file(packets, width, trailing=packets[0][:-1])
    rows = asf.asf_fragments(files(spark, [data])).orderBy("packet_no", "payload_no").collect()
    got = [(r.packet_no, r.payload_no, r.stream_no, r.object_no, r.offset, r.object_size, bytes(r.payload)) for r in rows]
    assert got == [
        (0, 0, 1, 1, 0, 6, b"abc"), (1, 0, 1, 1, 3, 6, b"def"), (1, 2, 1, 2, 0, 2, b"gh"),
        (2, 0, 1, 3, 0, 4, b"ijkl"), (3, 0, 1, 4, 0, 4, b"mnop"), (4, 0, 1, 0, 0, 0, b"q" * 111)]
    assert asf.asf_fragments(files(spark, [data]), stream_no=None).count() == 7


GOLDEN_I = bytes.fromhex("117bd24000019187")
GOLDEN_P = bytes.fromhex("51ffffffffffffffff0f")


def test_frames_of_whole_files(spark):
    """v3 golden packets, and a WMV1 file whose P headers depend on the carried bit rate."""
    v3 = B.avi(B.strl(fmt=B.strf(16, 16, b"DIV3")), b"".join(ch(b"00dc", p) for p in (GOLDEN_P, GOLDEN_I, GOLDEN_P, b"\x40\x00", GOLDEN_P)))

    def bits(text):
        text = text.ljust(-(-len(text) // 8) * 8, "0")
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))

    fast = bits("00" + "00101" + "00001" + "11001" + f"{51:011b}" + "1" + "0" + "10" + "11" + "1")
    inter = bits("01" + "00101" + "1" + "1")  # the per-macroblock bit is set
    wmv1 = B.avi(B.strl(fmt=B.strf(16, 16, b"WMV1")), ch(b"00dc", fast) + ch(b"00dc", inter))
    f = files(spark, [v3, wmv1])
    out = {(r.file_id, r.seq): r for r in frames_table(avi.avi_packets(f), avi.avi_streams(f)).collect()}
    got = [(r.frame_type, r.status, r.gop_id, r.p_index, r.ref_seq) for (i, _), r in sorted(out.items()) if i == 0]
    assert got == [
        ("P", "no_reference", 0, None, None), ("I", "ok", 1, 0, None), ("P", "ok", 1, 1, 1),
        ("P", "bad_qscale", 1, 2, 2), ("P", "ok", 1, 3, 2)]
    assert out[0, 1].header.qscale == 8 and out[0, 1].header.rl == 2
    assert (out[1, 0].bit_rate, out[1, 1].bit_rate) == (51 * 1024, 51 * 1024)
    assert (out[1, 1].header.per_mb_rl, out[1, 1].status) == (1, "unsupported_per_mb_table")


def test_thumbnails_from_files(spark):
    movi = b"".join(ch(b"00dc", GOLDEN_I if n % 3 == 0 else GOLDEN_P) for n in range(40))
    head = B.strl(fmt=B.strf(16, 16, b"DIV3"))
    start = B.avi(head, movi).index(b"movi") + 4
    at = lambda n: start + sum(8 + len(GOLDEN_I if k % 3 == 0 else GOLDEN_P) for k in range(n))

    def indexed(keys, first=0):
        """Index of every chunk, relative to the media list, with key flags where asked."""
        entries = b"".join(
            b"00dc" + B.le(16 if n in keys else 0, 4) + B.le(at(n) - start + first, 4) + B.le(8, 4) for n in range(40))
        return B.avi(head, movi, tail=B.chunk(b"idx1", entries))

    f = files(spark, [
        indexed({n for n in range(40) if n % 3 == 0}, first=4),  # 14 keys: the second one
        indexed({0, 1, 2, 4, 5, 7, 8, 10, 11, 13}),              # the target is a P frame: back to the first
        indexed({1, 3}),                                          # the first key is no I frame: by byte fraction
        B.avi(head, movi),                                        # no index
        B.avi(head, ch(b"00dc", GOLDEN_I)),                       # nothing at or after the fraction but the only frame
    ])
    cut = files(spark, [B.avi(head, ch(b"00dc", GOLDEN_P) + ch(b"00dc", GOLDEN_I))[:-2]])
    short = avi.avi_packets(cut).withColumn("frame_type", frame_type(F.lit("v3"), F.col("head")))
    assert short.filter("truncated and frame_type = 'I'").count() == 1 and thumbnail_packet(short).count() == 0
    typed = avi.avi_packets(f).withColumn("frame_type", frame_type(F.lit("v3"), F.col("head")))
    ranged = typed.join(avi.avi_streams(f).join(f.select("file_id", F.octet_length("content").alias("file_length")), "file_id")
                        .select("file_id", "movi_start", "file_length"), "file_id")
    got = {r.file_id: (r.rule, r.byte_offset) for r in thumbnail_packet(ranged, avi.avi_index(f)).collect()}
    size = {r.file_id: r.file_length for r in ranged.select("file_id", "file_length").distinct().collect()}

    def by_fraction(i):
        target = start + int((size[i] - start) * 0.1)
        return next(at(n) for n in range(0, 40, 3) if at(n) >= target)

    assert got[0] == ("index", at(3))
    assert got[1] == ("index", at(0))
    assert got[2] == ("fraction", by_fraction(2))
    assert got[3] == ("fraction", by_fraction(3))
    assert got[4] == ("first", start)
