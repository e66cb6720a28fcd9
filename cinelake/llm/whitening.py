"""Embedding whitening by spectrum slicing.

The covariance of all vectors is summed up by Spark, one matrix of the vectors' dimension, and its leading eigenvalues
are found one by one on the driver. The inertia of an LDL' factorisation of the shifted covariance counts the eigenvalues
above the shift, so bisection isolates each leading eigenvalue in an interval of its own. From there Rayleigh quotient iteration
converges cubically to the eigenvector, and two more counts, just below and just above the quotient, certify that it is
the k-th eigenvalue and no other. Eigenvalues too close to be told apart are certified together, and their
vectors are an orthonormal basis of the common space.

Vectors are fixed-point integers (``floor(scale * c) + offset``), so sums are exact. Every product is one of
centred values. Tasks pass on one row per matrix entry of what they have read, and Spark adds these up; what reaches the driver is
bounded by the square of the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import small_batches
from cinelake.session import saved

#: Bunch and Kaufman's constant: least growth over a 1x1 or 2x2 pivot.
ALPHA = (1 + 17**0.5) / 8
EPS = float(np.finfo(np.float64).eps)
#: Largest magnitude of a fixed-point entry: sums over 2**20 rows of a batch stay exact.
LARGEST = 1 << 42
BATCH = 500


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above the shift, by the signs of D in LDL' = A - shift I.

    Pivots are 1x1, or 2x2 where the diagonal is too small (Bunch and Kaufman); a 2x2 pivot has one eigenvalue of either sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    k, n, above = 0, len(a), 0
    while k < n:
        below = np.abs(a[k + 1 :, k])
        largest = below.max() if k + 1 < n else 0.0
        size = 1
        if largest > 0 and abs(a[k, k]) < ALPHA * largest:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            other = row.max()
            if abs(a[k, k]) * other < ALPHA * largest**2:
                size = 1 if abs(a[r, r]) >= ALPHA * other else 2
                to = k + size - 1
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if size == 1:
            d = a[k, k]
            above += d > 0
            if d != 0:
                c = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(c, c / d)
        else:
            above += 1
            c = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
        k += size
    return int(above)


def solved(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    """Unit vector along (A - shift I)^-1 v; a shift that is an eigenvalue is moved by a rounding error."""
    for nudge in (0.0, 1.0, -2.0, 8.0):
        try:
            x = np.linalg.solve(matrix - (shift + nudge * EPS * scale) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all() and np.any(x):
            return x / np.linalg.norm(x)
    return v


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest positive eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvalues that rounding cannot tell from 0 are left out.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0  # no eigenvalue is greater
    tiny = n * EPS * scale
    if not scale > 0:
        return np.zeros(0), np.zeros((n, 0))
    counts = {scale * (1 + 1e-12): 0, tiny: inertia(matrix, tiny)}

    def count(at: float) -> int:
        if at not in counts:
            counts[at] = inertia(matrix, at)
        return counts[at]

    wanted = min(most, counts[tiny])
    values, vectors = [], []
    rng = np.random.default_rng(0)
    while len(values) < wanted:
        k = len(values)  # so many are known; the next one lies between lo and hi
        lo = max(at for at, c in counts.items() if c > k)
        hi = min(at for at, c in counts.items() if c <= k)
        while count(lo) - count(hi) > 1 and hi - lo > 4 * tiny:  # isolate
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if count(mid) > k else (lo, mid)
        group = min(count(lo), wanted) - k  # over 1 only where rounding hides the gaps
        while True:
            found = []
            for _ in range(group):
                found.append(_iterated(matrix, (lo + hi) / 2, rng.standard_normal(n), vectors + [v for _, v in found], scale, group > 1))
            found.sort(key=lambda f: -f[0])
            if count(found[-1][0] - 8 * tiny) >= k + group and count(found[0][0] + 8 * tiny) <= k:
                break
            if hi - lo <= 4 * tiny:
                raise ArithmeticError(f"eigenvalue {k + 1} is not certified")
            mid = (lo + hi) / 2  # the iteration went to a neighbour: start nearer
            lo, hi = (mid, hi) if count(mid) > k else (lo, mid)
        values += [v for v, _ in found]
        vectors += [v for _, v in found]
    out = np.stack(vectors, axis=1) if vectors else np.zeros((n, 0))
    return np.array(values), out


def _iterated(matrix: np.ndarray, near: float, v: np.ndarray, known: list[np.ndarray], scale: float, close: bool) -> tuple[float, np.ndarray]:
    """Rayleigh quotient and unit eigenvector of the eigenvalue next to ``near``, orthogonal to the ``known`` ones.

    A few steps with the fixed shift come first, then the quotient is the shift. In a ``close`` group the shift stays.
    """
    others = np.stack(known, axis=1) if known else np.zeros((len(v), 0))

    def clean(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - others @ (others.T @ x)
        return x / np.linalg.norm(x)

    v = clean(v)
    for _ in range(4):
        v = clean(solved(matrix, near, v, scale))
    for _ in range(0 if close else 12):
        rho = float(v @ matrix @ v)
        if np.linalg.norm(matrix @ v - rho * v) <= 4 * EPS * scale:
            break
        v = clean(solved(matrix, rho, v, scale))
    return float(v @ matrix @ v), v


@dataclass(frozen=True)
class Model:
    """What is fitted on vectors of one dimension."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray  # eigenvectors over the root of their eigenvalues, as columns
    trace: float
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from the exact n x - S."""
        return self.wide(x).astype(np.float64) / self.n

    def wide(self, x: np.ndarray) -> np.ndarray:
        """n x - S as whole numbers, of 64 bits where these hold them."""
        largest = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if largest < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squares of n x - S per row, exact; None where 64 bits do not hold it."""
        d = self.wide(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        exact = (d.astype(object) ** 2).sum(axis=1).tolist() if d.shape[1] else [0] * len(d)
        return [e if e < 1 << 63 else None for e in exact]


def fixed_point(rows: DataFrame, scale: int, offset: int) -> DataFrame:
    """``id``, ``dim`` and the packed 64-bit entries of every usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed = [], [], []
            for i, v in zip(batch.column("id"), batch.column("vector"), strict=True):
                if not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(scale * np.asarray(v.values, np.float64)) + offset if len(v.values) else np.zeros(0)
                if not np.isfinite(x).all() or np.abs(x).max(initial=0) > LARGEST:
                    continue
                ids.append(i.as_py())
                dims.append(len(x))
                packed.append(x.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["id", "dim", "x"])

    return rows.mapInArrow(run, "id long, dim int, x binary")


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers and stacked vectors of a batch, per dimension."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.nonzero(dims == dim)[0]
        raw = b"".join(batch.column("x")[int(k)].as_buffer() for k in at)
        yield int(dim), at, np.frombuffer(raw, np.int64).reshape(len(at), dim)


def fit_sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Exact count and sums per dimension of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, at, x in matrices(batch):
                n, s = held.get(dim, (0, np.zeros(dim, object)))
                held[dim] = (n + len(at), s + x.sum(axis=0).astype(object))
        rows = [(d, j, v) for d, (n, s) in held.items() for j, v in [(-1, n), *enumerate(s)]]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array([str(v) for v in cols[2]], pa.string())], names=["dim", "j", "v"])

    parts = vectors.select("dim", "x").mapInArrow(run, "dim int, j int, v string")
    got = parts.groupBy("dim", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # dimension + 1 rows
    out: dict[int, tuple[int, list[int]]] = {}
    for dim in {r["dim"] for r in got}:
        own = {r["j"]: int(r["v"]) for r in got if r["dim"] == dim}
        out[dim] = (own[-1], [own[j] for j in range(dim)])
    return out


def products(vectors: DataFrame, models: dict[int, Model], whitened: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension the sums of centred vectors (whitened ones if asked for), and of their products."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, _, x in matrices(batch):
                m = shared.value[dim]
                d = m.centred(x) @ m.axes if whitened else m.centred(x)
                s, p = held.get(dim, (0.0, 0.0))
                held[dim] = (s + d.sum(axis=0), p + d.T @ d)
        for dim, (s, p) in held.items():
            i, j = np.triu_indices(len(p))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i) + len(s), dim), pa.int32()), pa.array(np.concatenate([np.full(len(s), -1), i]), pa.int32()),
                 pa.array(np.concatenate([np.arange(len(s)), j]), pa.int32()), pa.array(np.concatenate([s, p[i, j]]), pa.float64())],
                names=["dim", "i", "j", "v"])

    parts = vectors.select("dim", "x").mapInArrow(run, "dim int, i int, j int, v double")
    got = parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toArrow()  # half the square of the dimension
    shared.destroy()
    dims, i, j, v = (got.column(c).to_numpy() for c in ("dim", "i", "j", "v"))
    out = {}
    for dim in models:
        size = models[dim].axes.shape[1] if whitened else dim
        s, p = np.zeros(size), np.zeros((size, size))
        one, both = (dims == dim) & (i < 0), (dims == dim) & (i >= 0)
        s[j[one]] = v[one]
        p[i[both], j[both]] = p[j[both], i[both]] = v[both]
        out[dim] = (s, p)
    return out


def fit(vectors: DataFrame, most: int) -> dict[int, Model]:
    """The model of each dimension, from all vectors (written, as ``fixed_point`` makes them)."""
    models = {dim: Model(n, s, np.zeros(0), np.zeros((dim, 0)), 0.0) for dim, (n, s) in fit_sums(vectors).items()}
    for dim, (_, p) in products(vectors, models, whitened=False).items():
        m = models[dim]
        covariance = p / m.n
        values, axes = leading(covariance, most)
        models[dim] = Model(m.n, m.sums, values, axes / np.sqrt(values), float(np.trace(covariance)))
    for dim, (s, p) in products(vectors, models, whitened=True).items():
        m = models[dim]
        # the mean of centred vectors is 0 but for rounding
        off = p / m.n - np.outer(s / m.n, s / m.n) - np.eye(len(s))
        models[dim] = Model(m.n, m.sums, m.values, m.axes, m.trace, float(np.abs(off).max(initial=0.0)))
    return models


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32, scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """``id_col``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    One row per usable vector and component, for the ``most`` greatest eigenvalues that are not 0: constant columns and
    single vectors have no components. Vectors that are null or hold null, non-finite or huge entries (beyond 2**42 in fixed
    point) are left out. Vectors of another dimension are fitted and numbered by themselves; empty ones have no components. Repeated rows
    and null ids count like any others. A deviation beyond 64 bits is null. An empty table gives an empty one; columns other than those named are left out.
    """
    spark = rows.sparkSession
    with small_batches(spark, BATCH):
        narrow = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        vectors = saved(fixed_point(narrow, scale, offset), "fixed-point")
        shared = spark.sparkContext.broadcast(fit(vectors, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, BATCH) for k in range(0, whole.num_rows, BATCH)):
                for dim, at, x in matrices(batch):
                    m = shared.value[dim]
                    k = len(m.values)
                    each = np.repeat(np.arange(len(at)), k)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(at)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                         pa.array(np.full(len(each), m.n), pa.int64()), pa.array(m.deviations(x), pa.int64()).take(pa.array(each)),
                         pa.array((m.centred(x) @ m.axes).ravel(), pa.float64()), pa.array(np.tile(m.values / (m.trace or 1.0), len(at)), pa.float64()),
                         pa.array(np.full(len(each), m.error), pa.float64())],
                        names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = vectors.mapInArrow(run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
