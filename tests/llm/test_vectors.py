"""Hard negatives and whitening against plain versions."""

import math

import numpy as np
import pytest

from cinelake.llm import hard_negatives as hn
from cinelake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id long, h long, part int, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, la, 0, 0, 1, "x") for i, v, la in rows], SCHEMA)


def random_rows(n, dim=20, labels=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[n // 2 :] = x[: n - n // 2] + 0.2 * x[n // 2 :]
    return [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(labels))) for i, v in enumerate(x)]


def plain_negatives(rows, anchors, k=5):
    """All pairs in whole numbers."""
    usable = []
    for i, v, la in rows:
        if la is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        row = (i, tuple(math.floor(256 * float(np.float32(c))) for c in v), la)
        if row not in usable:
            usable.append(row)
    out = []
    for a in usable:
        if a[0] is None or a[0] % anchors:
            continue
        scored = [(-sum(p * q for p, q in zip(a[1], b[1])), b[0] is None, b[0] or 0, b) for b in usable if b is not a and len(b[1]) == len(a[1])]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[3][2] == a[2]][:k]:
            fits = [s for s in scored if s[3][2] != a[2] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:k]
            out += [(a[0], p[3][0], r, s[3][0], -p[0], -s[0]) for r, s in enumerate(fits, 1)]
    return out


def key(rows):
    return sorted(tuple((x is None, x or 0) for x in r) for r in rows)


@pytest.mark.parametrize("block_bytes", [1 << 23, 4000])
def test_hard_negatives_match_all_pairs(spark, block_bytes):
    rows = random_rows(240)
    rows += [(1000, rows[0][1], 1), (1001, rows[0][1], 1), (1010, None, 1), (1020, [float("nan")] * 20, 1), (1030, [None] * 20, 1),
             (1040, rows[3][1], None), (1050, [0.0] * 20, 2), (1060, [0.0] * 20, 0), (None, rows[5][1], 0), (1070, [0.5, 0.5], 0),
             (1080, [0.5, 0.4], 0), (1090, [0.5, 0.4], 1), (1100, [], 1), (20, rows[20][1], rows[20][2]), (1110, [3e38] * 20, 1)]
    got = hn.mine(frame(spark, rows).repartition(3), anchor=hn.F.col("id") % 10 == 0, block_bytes=block_bytes).collect()
    want = plain_negatives([r for r in rows if r[0] != 1110], 10)
    assert len(want) > 200 and key(map(tuple, got)) == key(want)


def test_hard_negatives_with_many_copies(spark):
    rows = random_rows(60, labels=2)
    rows += [(100 + i, rows[7][1], i % 2) for i in range(80)]
    got = hn.mine(frame(spark, rows), anchor=hn.F.col("id") % 20 == 0).collect()
    assert key(map(tuple, got)) == key(plain_negatives(rows, 20))


def test_hard_negative_edges(spark):
    assert hn.mine(frame(spark, [])).collect() == []
    assert hn.mine(frame(spark, [(100, [1.0, 0.0], 1)])).collect() == []
    assert hn.mine(frame(spark, [(None, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1)])).collect() == []


def test_intervals_hold_and_prune(spark):
    x = np.floor(256 * np.array([r[1] for r in random_rows(600, 64)]))
    block = hn.Block(np.arange(len(x)).tobytes(), np.arange(len(x)).tobytes(), np.ones(len(x), bool).tobytes(), x.astype(np.int32).tobytes(), 64).coded()
    for a in x[:20]:
        anchor, before, exact = hn.Anchor(a), np.zeros(len(x)), x @ a
        widths = []
        for level in range(hn.LEVELS):
            low, high, before = anchor.interval(block.words[level], block.aligned[level], block.left[level], block.norms, before)
            assert (low <= exact).all() and (exact <= high).all()
            widths.append(float(np.mean(high - low)))
        assert widths == sorted(widths, reverse=True)
        assert np.mean(high >= np.sort(exact)[-6]) < 0.3  # few are left for the exact scores


# Whitening

def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 40):
        a = rng.standard_normal((n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1]:
            assert whitening.inertia(a, float(shift)) == int((values > shift).sum())
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def with_values(values, seed=2):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 1, 0.5], [1e6, 1, 1e-3], [2, 2 - 1e-9, 1, 0, 0], [1] * 6, [7, 7 - 1e-14, 2], [0, 0], [4]])
def test_leading_eigenvectors(values):
    a = with_values(values)
    e, v = whitening.leading(a, 4)
    want = sorted((x for x in values if x > 0), reverse=True)[:4]
    assert np.allclose(e, want, rtol=1e-9) and np.allclose(v.T @ v, np.eye(len(e)), atol=1e-12)
    assert np.abs(a @ v - v * e).max(initial=0) < 1e-12 * max(values + [1])


def numbers(rows):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in rows])


def test_whitening_matches_a_dense_solver(spark):
    rows = random_rows(300, 12, seed=4)
    odd = [(900, None, 1), (901, [None] * 12, 1), (902, [float("inf")] * 12, 1), (903, [3e38] * 12, 1)]
    got = whitening.whiten(frame(spark, rows + odd).repartition(4), most=5).collect()
    x = numbers(rows).astype(float)
    d = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(d.T @ d / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 5 * len(rows) and {r.n for r in got} == {300} and len({r.identity_error for r in got}) == 1
    assert 0 < got[0].identity_error < 1e-9
    exact = numbers(rows).astype(object)
    deviation = ((len(rows) * exact - exact.sum(axis=0)) ** 2).sum(axis=1)
    for k in range(5):
        z = np.zeros(len(rows))
        for r in got:
            if r.component == k + 1:
                z[r.vec_id] = r.whitened
                assert r.deviation == deviation[r.vec_id] and math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9)
        want = d @ vectors[:, k] / math.sqrt(values[k])
        assert min(np.abs(z - want).max(), np.abs(z + want).max()) < 1e-8


def test_whitening_edges(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1)])).collect() == []  # no variance
    flat = whitening.whiten(frame(spark, [(i, [float(i), 5.0], 0) for i in range(4)] + [(None, [0.0, 5.0], 0), (9, [], 0)])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 5 and any(r.vec_id is None for r in flat)
    mixed = whitening.whiten(frame(spark, [(i, [float(i)] * (1 + i % 2), 0) for i in range(40)])).collect()
    assert {r.n for r in mixed} == {20} and len(mixed) == 40
    far = whitening.Model(1 << 40, [0], np.ones(1), np.ones((1, 1)), 1.0)
    assert far.deviations(np.array([[1 << 20], [1 << 30]])) == [None, None] and far.deviations(np.array([[3]])) == [None]
    assert whitening.Model(1 << 20, [0], np.ones(1), np.ones((1, 1)), 1.0).deviations(np.array([[3]])) == [9 << 40]
