import math
import random

from pyspark.sql import functions as F

from cinelake.operators import quality as Q


def lines(clip, frame, plane, rows):
    return [(clip, frame, plane, i, r) for i, r in enumerate(rows)]


SCHEMA = "clip_id string, frame_no int, plane string, row int, samples array<smallint>"


def test_plane_and_block_error(spark):
    rng = random.Random(1)
    a = [[rng.randrange(256) for _ in range(37)] for _ in range(20)]
    b = [[min(255, max(0, v + rng.randrange(-20, 21))) for v in r] for r in a]
    got = lines("c", 0, "Y", a) + lines("c", 1, "Y", a) + lines("c", 2, "Y", a) + lines("c", 3, "Y", a)
    ref = lines("c", 0, "Y", b) + lines("c", 1, "Y", a) + lines("c", 2, "Y", a[:-1]) + lines("c", 3, "Y", [r[:-1] for r in a])
    cmp = Q.compare_planes(spark.createDataFrame(got, SCHEMA), spark.createDataFrame(ref, SCHEMA))
    e = {r.frame_no: r for r in Q.plane_error(cmp).collect()}
    sse = sum((x - y) ** 2 for p, q in zip(a, b) for x, y in zip(p, q))
    assert e[0].squared_error == sse and math.isclose(e[0].mse, sse / 740)
    assert math.isclose(e[0].psnr, 10 * math.log10(65025 / (sse / 740)))
    assert e[0].max_diff == max(abs(x - y) for p, q in zip(a, b) for x, y in zip(p, q))
    assert (e[1].mse, e[1].psnr, e[1].status) == (0.0, math.inf, "ok")
    assert (e[2].mse, e[2].psnr, e[2].status) == (None, None, "mismatch")
    assert e[3].status == "mismatch"
    kinds = {(r.frame_no, r.status) for r in cmp.collect()}
    assert (2, "missing_ref") in kinds and (3, "length_mismatch") in kinds
    blocks = {(r.bx, r.by): r.squared_error for r in Q.block_error(cmp.filter("frame_no = 0"), 16, 10.0).collect()}
    want = {}
    for bx in range(2):
        s = sum((a[y][x] - b[y][x]) ** 2 for y in range(16) for x in range(16 * bx, 16 * bx + 16))
        if s / 256 > 10:
            want[bx, 0] = s
    assert blocks == want


def test_block_stats(spark):
    # one 16x16 picture whose four blocks have known means
    means = {(0, 0): 128, (1, 0): 160, (0, 1): 144, (1, 1): 176}
    rows = [[means[x // 8, y // 8] + (3 if (x, y) == (0, 0) else 0) for x in range(16)] for y in range(16)]
    df = spark.createDataFrame(lines("c", 0, "Y", rows) + lines("c", 0, "Cb", [[x * 9 for x in range(8)]] * 8), SCHEMA)
    got = {(r.plane, r.bx, r.by): r for r in Q.block_stats(df).collect()}
    assert got["Y", 1, 0].mean == 160 and got["Y", 1, 0].variance == 0 and not got["Y", 1, 0].coded
    assert math.isclose(got["Y", 0, 0].variance, (9 * 64 - 9) / 4096)
    assert got["Cb", 0, 0].coded


def test_coded_pattern(spark):
    rows = [("c", 0, 0, 0, b, [10] * 64, [10 + (2 if b in (0, 3, 5) else 1 if b in (1, 4) else 0)] * 64) for b in range(6)]
    df = spark.createDataFrame(rows, "clip_id string, frame_no int, mbx int, mby int, blk int, samples array<int>, ref_samples array<int>")
    r = Q.coded_pattern(df).first()
    # luma over 80: blocks 0 and 3 (128); chroma over 60: 4 (64) and 5 (128)
    assert (r.cbp, r.blocks) == (0b100111, 6)


def test_runs_and_clips(spark):
    inf = math.inf
    e = spark.createDataFrame([("a", 0, inf), ("a", 1, 95.0), ("a", 2, 60.0), ("a", 3, inf), ("b", 4, inf), ("b", 5, 91.0),
                               ("c", 0, None)], "clip_id string, frame_no int, psnr double")
    got = {r.clip_id: (r.frames, r.first_failure, r.exact_run) for r in Q.bit_exact_run(e).collect()}
    assert got == {"a": (4, 2, 2), "b": (2, None, 2), "c": (1, 0, 0)}
    frames = spark.createDataFrame([("a", 8, 8)] * 3 + [("b", 8, 8)] * 2 + [("c", 8, 8), ("c", 8, 9), ("x", 1, 1)],
                                   "clip_id string, width int, height int")
    want = spark.createDataFrame([("a", 3, 8, 8), ("b", 5, 8, 8), ("c", 2, 8, 8), ("d", 1, 8, 8)],
                                 "clip_id string, frames int, width int, height int")
    v = {r.clip_id: r.verdict for r in Q.check_clips(frames, want).collect()}
    assert v == {"a": "ok", "b": "frame_count", "c": "dimensions", "d": "missing", "x": "unexpected"}
