import pytest
from pyspark.sql import functions as F

from cinelake.functions import codecs as C

# golden packets: (version, first bytes, type, fields)
GOLDEN = [
    ("v3", "117bd240", "I", dict(qscale=8, slice_code=23, rl_chroma=1, rl=2, dc=1)),
    ("v3", "117bb01e", "I", dict(qscale=8, slice_code=23, rl_chroma=1, rl=2, dc=1)),
    ("v3", "51f33333", "P", dict(qscale=8, skip_coded=1, rl=2, dc=1, mv=1)),
    ("v3", "51ffffff", "P", dict(qscale=8, skip_coded=1, rl=2, dc=1, mv=1, header_bits=12)),
    ("v1", "000001000040ff63", "I", dict(qscale=4, frame_no=0, slice_code=1)),
    ("v1", "000001000a3705af", "P", dict(qscale=3, frame_no=1)),
    ("v1", "0000010012258146", "P", dict(qscale=2, frame_no=2)),
    ("v1", "000001001a270513", "P", dict(qscale=2, frame_no=3)),
    ("v1", "0000010022268112", "P", dict(qscale=2, frame_no=4)),
]


@pytest.fixture(scope="module")
def golden(spark):
    df = spark.createDataFrame([(i, v, bytearray.fromhex(h)) for i, (v, h, _, _) in enumerate(GOLDEN)],
                               "i int, version string, head binary")
    return df.withColumn("frame_type", C.frame_type(F.col("version"), F.col("head")))


def test_golden_headers(golden):
    for r in C.frame_header(golden).collect():
        _, _, ftype, fields = GOLDEN[r.i]
        assert r.frame_type == ftype
        for name, value in fields.items():
            assert r.header[name] == value, (r.i, name)


def test_generic_type_test_is_wrong_for_v1(golden):
    rows = golden.filter("version = 'v1'").select(C.frame_type(F.lit("v3"), F.col("head")).alias("t")).collect()
    assert {r.t for r in rows} == {"I"}


def pack(fields):
    text = "".join(f"{v:0{n}b}" for v, n in fields)
    return bytearray(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


def one_header(spark, version, ftype, payload, bit_rate=None, extradata=None):
    df = spark.createDataFrame([(version, ftype, payload, bit_rate, extradata)],
                               "version string, frame_type string, head binary, bit_rate int, extradata binary")
    return C.frame_header(df, bit_rate="bit_rate", extradata="extradata").first().header


def test_wmv1_bit_rate_boundary(spark):
    at = pack([(0, 2), (5, 5), (1, 5), (25, 5), (50, 11), (1, 1), (2, 2), (3, 2), (1, 1)])
    h = one_header(spark, "wmv1", "I", at)
    assert (h.bit_rate, h.per_mb_rl, h.rl_chroma, h.rl, h.dc) == (50 * 1024, 0, 1, 2, 1)
    over = pack([(0, 2), (5, 5), (1, 5), (25, 5), (51, 11), (1, 1), (0, 1), (2, 2), (3, 2), (1, 1)])
    h = one_header(spark, "wmv1", "I", over)
    assert (h.bit_rate, h.per_mb_rl, h.rl_chroma, h.rl, h.dc) == (51 * 1024, 0, 1, 2, 1)
    p = pack([(1, 2), (5, 5), (1, 1), (0, 1), (3, 2), (1, 1), (0, 1)])
    h = one_header(spark, "wmv1", "P", p, bit_rate=51 * 1024)
    assert (h.qscale, h.skip_coded, h.per_mb_rl, h.rl, h.dc, h.mv) == (5, 1, 0, 2, 1, 0)


def test_wmv2_headers(spark):
    i = pack([(0, 1), (9, 7), (6, 5), (0, 1), (0, 1), (2, 2), (0, 1), (1, 1)])
    h = one_header(spark, "wmv2", "I", i)
    assert (h.i7, h.qscale, h.j_type, h.per_mb_rl, h.rl_chroma, h.rl, h.dc) == (9, 6, 0, 0, 1, 0, 1)
    p = pack([(1, 1), (12, 5), (0, 2), (2, 2), (1, 1), (1, 1), (0, 1), (0, 1), (3, 2), (1, 1), (0, 1)])
    h = one_header(spark, "wmv2", "P", p)
    assert (h.qscale, h.skip_type, h.pattern_index, h.pattern_table) == (12, 0, 1, 0)
    assert (h.mspel, h.per_mb_abt, h.abt_type, h.per_mb_rl, h.rl, h.dc, h.mv) == (1, 0, 0, 0, 2, 1, 0)
    mapped = pack([(1, 1), (12, 5), (1, 2), (255, 8)])
    h = one_header(spark, "wmv2", "P", mapped)
    assert (h.qscale, h.skip_type, h.rl, h.mv) == (12, 1, None, None)


def test_wmv2_flags_and_defaults(spark):
    ext = pack([(25, 5), (100, 11), (0, 1), (1, 1), (0, 1), (0, 1), (1, 1), (0, 1), (1, 3), (0, 7)])
    df = spark.createDataFrame([(ext,), (bytearray(b"ab"),), (None,)], "e binary")
    rows = [r[0] for r in df.select(C.wmv2_flags(F.col("e"))).collect()]
    assert tuple(rows[0]) == (25, 102400, 0, 1, 0, 0, 1, 0)
    for r in rows[1:]:
        assert tuple(r) == (None, None, 1, 0, 1, 1, 0, 1)


def test_fourcc(spark):
    df = spark.createDataFrame([("div3",), (" MP42 ",), ("MPG4",), ("wmv7",), ("WMV8",), ("XVID",)], "fourcc string")
    rows = C.fourcc_version(df).collect()
    assert [r.version for r in rows] == ["v3", "v2", "v1", "wmv1", "wmv2", None]
    assert [r.status for r in rows] == ["ok"] * 5 + ["unknown_codec"]
    assert sum(len(v) for v in C.FOURCC_ALIASES.values()) == 21


def test_status(spark):
    df = spark.createDataFrame(
        [
            ("v3", bytearray.fromhex("117bd240"), True, "ok"),
            ("v3", bytearray.fromhex("0001d240"), True, "bad_qscale"),
            ("v3", bytearray.fromhex("51f33333"), False, "no_reference"),
            ("v3", bytearray(), True, "empty"),
            (None, bytearray.fromhex("51f33333"), True, "unknown_codec"),
            ("wmv2", pack([(0, 1), (9, 7), (6, 5), (1, 1), (0, 1)]), True, "unsupported_j_frame"),
            ("wmv2", pack([(1, 1), (12, 5), (0, 2), (0, 1), (1, 1), (1, 1), (0, 1), (1, 1)]), True,
             "unsupported_per_mb_table"),
            ("wmv2", pack([(1, 1), (12, 5), (0, 2), (0, 1), (1, 1), (0, 1), (0, 1), (0, 1)]), True,
             "unsupported_abt"),
            ("wmv2", pack([(1, 1), (12, 5), (2, 2), (0, 1), (1, 1), (0, 1), (0, 1), (0, 1)]), True, "header_unread"),
        ],
        "version string, head binary, has_ref boolean, want string",
    ).withColumn("frame_type", C.frame_type(F.col("version"), F.col("head")))
    out = C.frame_header(df).withColumn(
        "got", C.frame_status(F.col("version"), F.col("frame_type"), F.col("header"), F.col("has_ref")))
    for r in out.collect():
        assert r.got == r.want


def test_geometry_odd_size(spark):
    r = spark.range(1).select(C.geometry(F.lit(33), F.lit(17)).alias("g")).first().g
    assert tuple(r) == (3, 2, 48, 32, 17, 9)


def test_guards(spark):
    df = spark.createDataFrame([("00dc", 0), ("00db", 5), ("01dc", 5), ("01wb", 5)], "c string, s int")
    rows = df.select(C.is_video(F.col("c")).alias("v"), C.is_video(F.col("c"), 1).alias("v1"),
                     C.size_ok(F.col("s")).alias("ok")).collect()
    assert [(r.v, r.v1, r.ok) for r in rows] == [
        (True, False, False), (True, False, True), (False, True, True), (False, False, True)]
