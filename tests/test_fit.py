import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.functions import predictors as P
from cinelake.operators import fit


def test_neighbours_and_predictors(spark):
    rng = random.Random(2)
    grid = {(f, x, y): rng.randrange(100) for f in "ab" for x in range(6) for y in range(4) if rng.random() < 0.9}
    df = spark.createDataFrame([(f, x, y, v, f"t{v}") for (f, x, y), v in grid.items()],
                               "frame_id string, gx int, gy int, value int, tag string")
    n = fit.with_neighbours(df, 7)
    out = n.withColumn("g", P.gradient_pred(F.col("left"), F.col("topleft"), F.col("top"))).withColumn(
        "gl", P.gradient_pred(F.col("left"), F.col("topleft"), F.col("top"), "left")).withColumn(
        "m", P.mv_pred(F.col("left"), F.col("top"), F.col("topright"), F.col("gy"))).collect()
    assert len(out) == len(grid)
    for r in out:
        at = lambda dx, dy: grid.get((r.frame_id, r.gx + dx, r.gy + dy), 7)
        a, b, c, d = at(-1, 0), at(-1, -1), at(0, -1), at(1, -1)
        assert (r.value, r.tag) == (grid[r.frame_id, r.gx, r.gy], f"t{r.value}")
        assert (r.left, r.topleft, r.top, r.topright) == (a, b, c, d)
        assert (r.g.pred, r.g.from_left) == ((a, True) if abs(a - b) > abs(b - c) else (c, False))
        assert r.gl.from_left == (abs(a - b) >= abs(b - c))
        assert r.m == (a if r.gy == 0 else sorted([a, c, d])[1])


def test_small_predictors(spark):
    df = spark.range(1, 32).select(F.col("id").cast("int").alias("q"))
    rows = df.select("q", P.dc_scaler(F.col("q")).alias("l"), P.dc_scaler(F.col("q"), "chroma").alias("c"),
                     P.dc_scaler(F.col("q"), "luma", "wmv1").alias("wl"),
                     P.dc_scaler(F.col("q"), "chroma", "wmv1").alias("wc")).collect()
    by = {r.q: r for r in rows}
    assert [by[q].l for q in (1, 4, 5, 8, 9, 24, 25, 31)] == [8, 8, 10, 16, 17, 32, 34, 46]
    assert [by[q].c for q in (1, 4, 5, 8, 24, 25, 31)] == [8, 8, 9, 10, 18, 19, 25]
    assert [by[q].wl for q in (1, 5, 6, 7, 8, 31)] == [8, 8, 9, 9, 10, 21]
    assert [by[q].wc for q in (1, 4, 5, 6, 7, 31)] == [8, 8, 9, 9, 10, 22]
    r = spark.range(1).select(
        P.default_predictor(F.lit(8)).alias("d"), P.cbp_pred(F.lit(1), F.lit(0), F.lit(0)).alias("a"),
        P.cbp_pred(F.lit(1), F.lit(1), F.lit(0)).alias("b"), P.coded_flag(F.lit(1), F.lit(1), F.lit(0), F.lit(0)).alias("f"),
        P.wrap_mv(F.lit(64)).alias("w"), P.wrap_mv(F.lit(-64)).alias("v"), P.wrap_mv(F.lit(63)).alias("u"),
        P.median3(F.lit(5), F.lit(-2), F.lit(3)).alias("m"),
        P.mv_pred(F.lit(4), F.lit(9), F.lit(9), F.lit(2), "left").alias("l"),
        P.mv_pred(F.lit(4), F.lit(9), F.lit(None).cast("int"), F.lit(2)).alias("n")).first()
    assert tuple(r) == (128, 1, 0, 0, 0, 0, 63, 3, 4, 4)


@pytest.mark.parametrize("name", list(P.SCAN_ORDERS))
def test_scan_orders_are_permutations(name):
    assert sorted(P.SCAN_ORDERS[name]) == list(range(64))
    assert P.SCAN_ORDERS["zigzag"][:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_reorder(spark):
    df = spark.createDataFrame([([10, 20, 30],)], "a array<int>")
    r = df.select(P.reorder(F.col("a"), [2, 0, 1]).alias("x"),
                  P.reorder(F.col("a"), F.array(F.lit(2), F.lit(0), F.lit(1))).alias("y")).first()
    assert r.x == r.y == [30, 10, 20]


def test_score(spark):
    df = spark.createDataFrame([(1, 2, 2, "a"), (5, 6, 5, "a"), (3, 9, 7, "b")], "l int, t int, truth int, k string")
    forms = {"left": F.col("l"), "top": F.col("t"), "never": F.lit(None).cast("int")}
    got = {(r.k, r.formula): (r.points, r.matches) for r in fit.score(df, F.col("truth"), forms, 0, ["k"]).collect()}
    assert got == {("a", "left"): (2, 1), ("a", "top"): (2, 1), ("a", "never"): (2, 0),
                   ("b", "left"): (1, 0), ("b", "top"): (1, 0), ("b", "never"): (1, 0)}
    loose = {r.formula: r.matches for r in fit.score(df, F.col("truth"), forms, 1).collect()}
    assert loose["left"] == 2 and loose["top"] == 2


def test_ols(spark):
    rng = np.random.default_rng(3)
    rows, data = [], {}
    for g in ("a", "b"):
        x = rng.integers(0, 200, (50, 3))
        y = 2 * x[:, 0] - x[:, 1] + 0.5 * x[:, 2] + 7 + rng.normal(0, 3, 50)
        data[g] = (x, y)
        rows += [(g, *map(int, r), float(v)) for r, v in zip(x, y)]
    rows += [("few", 1, 2, 3, 4.0)] * 3 + [("flat", i, i, 2 * i, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, l int, t int, d int, y double")
    got = {r.g: r for r in fit.ols(df, "y", ["l", "t", "d"], ["g"]).collect()}
    assert set(got) == {"a", "b", "flat"}
    assert got["flat"].coef_l is None and got["flat"].n == 9
    for g, (x, y) in data.items():
        a = np.column_stack([x, np.ones(len(y))])
        coef, *_ = np.linalg.lstsq(a, y, rcond=None)
        r = got[g]
        assert np.allclose([r.coef_l, r.coef_t, r.coef_d, r.intercept], coef)
        assert np.isclose(r.resid_std, (y - a @ coef).std())


def test_step_scale(spark):
    df = spark.createDataFrame([(1, v) for v in (10.2, 12.0, 14.4, 12.4)] + [(2, 5.0), (2, 5.1), (3, 0.5), (3, 1.5)],
                               "q int, v double")
    got = {r.q: (r.distinct_values, r.scale) for r in fit.step_scale(df, "v", ["q"]).collect()}
    assert got == {1: (3, 16), 2: (1, None), 3: (2, 16)}


def test_permutation(spark):
    runs = [("ok", r) for r in range(63)] + [("zero", r) for r in (-1, 0, 1)] + [("twice", 3), ("twice", 3)]
    df = spark.createDataFrame(runs, "k string, run int")
    got = {(r.k, r.offset): (r.clean, r.complete, r.chosen) for r in fit.is_permutation(df, "run", ["k"]).collect()}
    assert got["ok", 1] == (True, True, True)
    assert got["ok", 2] == (True, False, False)
    assert got["ok", 0] == (False, False, False)
    assert got["zero", 1] == (False, False, False) and got["zero", 2] == (True, True, True)
    assert not any(v[0] for k, v in got.items() if k[0] == "twice")


def test_sweep_and_coverage(spark):
    s = fit.sweep(spark, q=[2, 8], cbp=list(range(4)), mag=["a", "b"])
    rows = {tuple(r) for r in s.collect()}
    assert len(rows) == s.count() == 16
    obs = spark.createDataFrame([(2, 0, "a"), (2, 0, "a"), (8, 3, "b")], "q int, cbp int, mag string")
    assert {tuple(r) for r in fit.coverage(obs, s).collect()} == rows - {(2, 0, "a"), (8, 3, "b")}


def test_running_level_and_ranks(spark):
    rng = random.Random(8)
    rows = [("f", r, "y", m, b, rng.randrange(-9, 9)) for r in range(2) for m in range(5) for b in range(4)]
    df = spark.createDataFrame(rows, "frame_id string, row int, component string, mx int, blk int, diff int")
    for chunk in (2, 1 << 16):
        for r in fit.running_level(df, chunk_cells=chunk).collect():
            assert r.level == 128 + sum(x[5] for x in rows if x[1] == r.row and (x[3], x[4]) <= (r.mx, r.blk))
    obs = spark.createDataFrame(
        [("t", "0", 130.0), ("t", "0", 128.0), ("t", "1", 100.0), ("t", "01", 200.0)], "table_id string, code string, value double")
    assert {r.code: r.label for r in fit.rank_label(obs, 128).collect()} == {"1": -1, "0": 0, "01": 1}


def test_expand_runs(spark):
    rng = random.Random(6)
    rows = [(b, k, rng.randrange(4), rng.randrange(1, 99)) for b in range(6) for k in range(10 + 30 * b)]
    df = spark.createDataFrame(rows, "blk int, k int, run int, value int")
    zig = P.SCAN_ORDERS["zigzag"]
    for scan, start in ((None, 0), (zig, 1)):
        want = {}
        for b in range(6):
            dense, pos = [0] * 64, start
            for _, _, run, value in sorted(r for r in rows if r[0] == b):
                pos += run
                if pos < 64:
                    dense[scan[pos] if scan else pos] = value
                pos += 1
            want[b] = dense
        got = {r.blk: r["values"] for r in fit.expand_runs(df, ["blk"], ["k"], scan=scan, start=start).collect()}
        assert got == want
