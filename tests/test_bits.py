import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cinelake.functions import bits as B


def ref_bits(data: bytes, pos: int, n: int) -> int:
    text = "".join(f"{b:08b}" for b in data).ljust(pos + n, "0")
    return int(text[pos : pos + n].ljust(n, "0"), 2)


@pytest.fixture(scope="module")
def payloads(spark):
    rng = random.Random(5)
    rows = [(i, bytearray(rng.randbytes(i % 13))) for i in range(60)]
    return spark.createDataFrame(rows, "id int, p binary")


def test_bits_static_and_column_positions(payloads):
    widths = [(0, 1), (0, 2), (2, 5), (7, 9), (17, 11), (37, 2), (3, 32), (5, 48), (90, 8)]
    cols = [B.bits(F.col("p"), p, n).alias(f"s_{p}_{n}") for p, n in widths]
    cols += [B.bits(F.col("p"), F.lit(p), n).alias(f"c_{p}_{n}") for p, n in widths if n <= 42]
    for r in payloads.select("p", *cols).collect():
        for p, n in widths:
            want = ref_bits(bytes(r.p), p, n)
            assert r[f"s_{p}_{n}"] == want
            if n <= 42:
                assert r[f"c_{p}_{n}"] == want


def test_little_endian(payloads):
    cols = [
        B.le16(F.col("p"), 1).alias("le16"),
        B.le32(F.col("p"), F.lit(2)).alias("le32"),
        B.le32s(F.col("p"), 2).alias("le32s"),
        B.le64(F.col("p"), 3).alias("le64"),
    ]
    for r in payloads.select("p", *cols).collect():
        d = bytes(r.p)
        assert r.le16 == (int.from_bytes(d[1:3], "little") if len(d) >= 3 else None)
        assert r.le32 == (int.from_bytes(d[2:6], "little") if len(d) >= 6 else None)
        assert r.le32s == (int.from_bytes(d[2:6], "little", signed=True) if len(d) >= 6 else None)
        assert r.le64 == (int.from_bytes(d[3:11], "little", signed=True) if len(d) >= 11 else None)


def test_le_bytes_round_trip(spark):
    df = spark.createDataFrame([(0,), (1,), (300,), (2**32 - 1,)], "v bigint")
    out = df.select("v", B.le32(B.le_bytes(F.col("v"), 4), 0).alias("w")).collect()
    assert all(r.v == r.w for r in out)


def test_bit_string_and_c3(payloads):
    out = payloads.select("p", B.bit_string(F.col("p"), 77).alias("s"), B.c3(F.col("p"), 5).alias("c"),
                          B.c3(F.col("p"), F.lit(5)).alias("d")).collect()
    for r in out:
        text = "".join(f"{b:08b}" for b in bytes(r.p)).ljust(77, "0")[:77]
        assert r.s == text
        want = (0, 1) if text[5] == "0" else ((1, 2) if text[6] == "0" else (2, 2))
        assert tuple(r.c) == want and tuple(r.d) == want


def test_strings(spark):
    df = spark.createDataFrame([("0101011",), ("",), ("1",), ("111",)], "s string")
    out = df.select(
        "s", B.pattern_positions(F.col("s"), "101").alias("p"), B.trim_run(F.col("s"), "1").alias("t")
    ).collect()
    assert [(r.p, r.t) for r in out] == [([1, 3], "01010"), ([], ""), ([], ""), ([], "")]


def test_values(spark):
    df = spark.createDataFrame([(0, 0), (3, 5), (3, 2), (1, 0), (8, 0), (8, 255)], "l int, v int")
    got = [r[0] for r in df.select(B.sign_magnitude(F.col("l"), F.col("v"))).collect()]
    assert got == [0, 5, -5, -1, -255, 255]
    d = spark.createDataFrame([(0,), (127,), (128,), (255,)], "v int")
    assert [r[0] for r in d.select(B.int8(F.col("v"))).collect()] == [0, 127, -128, -1]


def test_pack_unpack_complement(spark):
    df = spark.range(64).select(F.col("id").cast("int").alias("c"))
    flags = [B.unpack6(F.col("c"), i) for i in range(6)]
    for r in df.select("c", B.pack6(flags).alias("p"), B.complement(F.col("c")).alias("x")).collect():
        assert r.c == r.p
        assert r.x == (r.c ^ 0x3C if r.c & 3 != 3 else r.c)


def test_bits_of_whole_payloads(spark):
    rng = random.Random(8)
    data = [b"", b"\x00", b"\xff" * 9, rng.randbytes(50), rng.randbytes(60_000), None]
    df = spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in enumerate(data)], "id int, p binary")
    bits = B.all_bits(F.col("p"))
    for r in df.select("id", bits.alias("s"), B.bit_positions(bits, "11011").alias("at")).collect():
        d = data[r.id]
        want = None if d is None else "".join(f"{b:08b}" for b in d)
        assert r.s == want
        assert r["at"] == ([k for k in range(len(want)) if want.startswith("11011", k)] if want is not None else [])


def test_bit_scan_is_what_the_bit_string_says(spark):
    rng = random.Random(5)
    data = [None, b"", b"\xff", b"\xff\xff", b"\0", b"\x01", b"\xb6\xdb\x6d", b"\0\xff\x80", rng.randbytes(1 << 20)]
    data += [rng.randbytes(rng.randrange(1, 40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(data)), "id int, p binary")
    for pattern in ("1", "11011", "0011101", "01" * 9):
        for r in df.select("id", B.bit_scan(F.col("p"), pattern).alias("found")).collect():
            if data[r.id] is None:
                assert r.found is None
                continue
            s = "".join(f"{b:08b}" for b in data[r.id])
            at = [k for k in range(len(s)) if s.startswith(pattern, k)] if len(s) < 400 else None
            f = r.found
            assert (f.n_bits, f.ones, f.trimmed, f.md5) == (len(s), s.count("1"), len(s.rstrip("1")), hashlib.md5(s.encode()).hexdigest())
            assert f.positions == at or at is None and len(f.positions) >= s.count(pattern)
    with pytest.raises(ValueError):
        B.bit_scan(F.col("p"), "")
