import random

import pytest
from pyspark.sql import functions as F

from cinelake.operators import frames as FR
from cinelake.operators.lookup import lookup_join
from cinelake.operators.scan import Running, ordered_scan
from cinelake.session import saved


def make_frames(seed=3, n=400):
    rng = random.Random(seed)
    rows = []
    for f in range(3):
        for s in range(n if f == 0 else 40):
            t = rng.choices(["I", "P", "empty"], [1, 8, 1])[0]
            st = "ok" if t != "empty" and rng.random() < 0.8 else "bad_qscale"
            rows.append((f, s, t, st, rng.choice([None, 100, 200]), rng.randrange(1, 50)))
    return rows


SCHEMA = "file_id long, seq long, frame_type string, status string, bit_rate int, size int"


@pytest.fixture(scope="module")
def rows():
    return make_frames()


@pytest.fixture(scope="module")
def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, F.rand(1))


def expected(rows):
    """One file at a time, frame by frame."""
    out = {}
    state = {}
    for f, s, t, st, br, size in sorted(rows):
        z = state.setdefault(f, dict(gop=0, p=0, ref=None, ok_i=False, rate=None, off=0))
        offset = z["off"]
        z["off"] += size
        if t == "I":
            z["gop"] += 1
            z["p"] = 0
            if br is not None:
                z["rate"] = br
        elif t == "P":
            z["p"] += 1
        ref, status = None, st
        if t == "P":
            if z["ok_i"]:
                ref = z["ref"]
            else:
                status = "no_reference"
        p = z["p"] if z["gop"] and t != "empty" else None
        out[f, s] = (z["gop"], p, None if p is None else p % 2 == 0, z["rate"], ref, status, offset)
        if st == "ok":
            if t == "I":
                z["ok_i"] = True
            z["ref"] = s
    return out


@pytest.mark.parametrize("chunk_rows", [7, 1 << 18])
def test_track_equals_frame_by_frame(frames, rows, chunk_rows):
    want = expected(rows)
    got = FR.track(FR.offsets(frames, chunk_rows=chunk_rows), chunk_rows=chunk_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.gop_id, r.p_index, r.no_rounding, r.bit_rate, r.ref_seq, r.status, r.byte_offset) == want[
            r.file_id, r.seq
        ]


def test_totals(frames, rows):
    got = ordered_scan(frames, ["file_id"], ["seq"], {
        "s": Running("total_sum", F.col("size")), "lo": Running("total_min", F.col("size")),
        "hi": Running("total_max", F.col("size"))}, chunk_rows=7)
    for r in got.select("file_id", "s", "lo", "hi").distinct().collect():
        sizes = [x[5] for x in rows if x[0] == r.file_id]
        assert (r.s, r.lo, r.hi) == (sum(sizes), min(sizes), max(sizes))


def test_gop_profile(frames, rows):
    want = expected(rows)
    got = {r.file_id: r for r in FR.gop_profile(frames, chunk_rows=7).collect()}
    for f in range(3):
        mine = [v for (ff, _), v in want.items() if ff == f]
        runs = {}
        for (ff, s), v in want.items():
            if ff == f and v[0] > 0:
                t = next(x[2] for x in rows if x[0] == f and x[1] == s)
                runs[v[0]] = runs.get(v[0], 0) + (t == "P")
        assert got[f].frames == len(mine)
        assert got[f].gops == max(v[0] for v in mine)
        assert got[f].longest_p_run == max(runs.values(), default=0)
        assert got[f].no_reference == sum(v[5] == "no_reference" for v in mine)


def test_growing_sides_are_never_broadcast(spark):
    """Written tables look small by their files; only a counted table may be broadcast."""
    table = saved(spark.range(1000).select(F.col("id").alias("file_id"), F.lit(0).alias("zero")), "small-files")
    probe = spark.range(1000).select(F.col("id").alias("file_id"))
    joined = lookup_join(probe, table, ["file_id"], max_rows=10)
    scanned = ordered_scan(
        saved(spark.range(1000).select((F.col("id") % 9).alias("file_id"), F.col("id").alias("seq")), "rows"),
        ["file_id"], ["seq"], {"n": Running("sum", F.lit(1))}, chunk_rows=10)
    for df in (joined, scanned):
        assert df.count() == 1000
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert lookup_join(probe, table, ["file_id"], max_rows=1000)._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
