"""Near-duplicate vectors by PCA-ordered tiled comparison, exact.

Vectors are compared within a label. They are ordered along the first principal axis and cut into tiles; equal vectors
meet there and become one class with a multiplicity. Two unit vectors with cosine c or more differ by at
most sqrt(2 - 2c) on every axis, so only tiles that lie that near each other are compared.

A label's tiles form blocks of consecutive ones. A task holds one block in memory, and half of the other blocks
stream by, so that every two blocks meet in one task. A label of up to ``SPLIT_BYTES`` is one block and travels once; a larger one
has up to three and travels twice, until a third of it is more than a task may hold (``BLOCK_BYTES``). From there on the
way grows with the number of blocks. Vectors are stored as they are given (single precision stays single), never rotated ones.

Two tiles are compared by one product of their leading dimensions on the principal axes, in single precision; the norms of
what is left, as one more coordinate, add the Cauchy-Schwarz bound of the rest. Survivors are decided by
the cosine of the vectors as given, in double precision. Where many survive, a product of all dimensions with a bound of its
rounding error decides what is clear.

A task returns a row per linked vector (links, and one member of its local component), never the links
themselves. The axes are fitted on a bounded sample; they only order the work and cannot change a result.
All vectors of a label have to be compared with those near on the first axis: for one huge label work stays quadratic
(in tiles), as the exact contract demands.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import small_batches, small_side
from cinelake.llm.components import components
from cinelake.session import saved

#: Vectors the axes are fitted on.
PCA_SAMPLE = 5_000
#: Bytes of a tile's vectors, of a block that a task holds, and of a label from which it is split in blocks.
TILE_BYTES = 512 * 1024
BLOCK_BYTES = 128 << 20
SPLIT_BYTES = 16 << 20
#: Rows of a tile compared at once, and tiles handed to Python at once.
CHUNK = 256
TILES = 8
SLACK = 1e-9
#: Stands for a class without any id.
NOBODY = int(np.iinfo(np.int64).max)
#: Bits of a class number for the place in a tile, and for the tile in its task.
PLACE_BITS, TILE_BITS = 20, 24


def products(x: np.ndarray, axis: np.ndarray | None = None) -> np.ndarray:
    """Every row's product with the axis, or with itself: summed up one dimension after the other, so that equal rows agree to the bit."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for s in range(0, len(x), CHUNK):
            for k, column in enumerate(np.ascontiguousarray(x[s : s + CHUNK].T, np.float64)):
                out[s : s + CHUNK] += column * (column if axis is None else axis[k])
    return out


def usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, vectors and their squared norms, by dimension, of the batch's rows that can link with something."""
    column, label = batch.column("vector"), batch.column("label")
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    known = label.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[known & (lengths > 0)]).tolist():
        at = np.flatnonzero(known & (lengths == dim))
        x = flat[starts[at][:, None] + np.arange(dim)] + 0.0  # -0 equals 0; null components are NaN
        square = products(x)
        ok = np.isfinite(x).all(axis=1) & (square > 0) & (square < np.inf)
        yield at[ok], x[ok], square[ok]


def binaries(x: np.ndarray) -> pa.Array:
    """The rows' bytes."""
    width = x.dtype.itemsize * x.shape[1]
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def hashes(x: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of every row."""
    rows = memoryview(np.ascontiguousarray(x)).cast("B")
    width = x.dtype.itemsize * x.shape[1]
    return [np.fromiter((xxhash.xxh3_64_intdigest(rows[k : k + width], seed) for k in range(0, len(rows), width)), np.uint64, len(x)).view(np.int64)
            for seed in (1, 2)]


def keys(rows: DataFrame) -> DataFrame:
    """``id``, ``label``, ``dim`` (0: links with nothing) and two hashes of the vector, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, h1, h2 = (np.zeros(batch.num_rows, t) for t in (np.int32, np.int64, np.int64))
            for at, x, _ in usable(batch):
                dims[at] = x.shape[1]
                h1[at], h2[at] = hashes(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *map(pa.array, (dims, h1, h2))],
                                             names=["id", "label", "dim", "h1", "h2"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, label {kind}, dim int, h1 long, h2 long")


def axes(rows: DataFrame, least: float) -> dict[int, tuple[np.ndarray, int]]:
    """Principal axes per dimension from about ``PCA_SAMPLE`` vectors, and of how many a product is cheapest."""
    n = rows.count()
    got = rows.sample(min(1.0, PCA_SAMPLE / max(n, 1)), seed=1).select("label", "vector").toArrow().combine_chunks().to_batches()
    out = {}
    for batch in got:
        for _, x, square in usable(batch):
            if len(x):
                x = x.astype(np.float64) / np.sqrt(square)[:, None]
                tried, fitted = (x[:1000], x[1000:]) if len(x) > 2000 else (x[:1000], x)  # axes fit their own sample too well
                r = np.linalg.eigh(fitted.T @ fitted)[1][:, ::-1].copy()
                out[x.shape[1]] = (r, leading(tried @ r, least))
    return out


def leading(x: np.ndarray, least: float) -> int:
    """The cheapest number of leading dimensions for the pairs of the sample: a survivor's cosine costs as much as hundreds of products of all dimensions."""
    dim = x.shape[1]
    costs = {}
    for k in sorted({*range(8, dim, 8), dim}):
        left = np.sqrt(np.maximum(0, 1 - (x[:, :k] ** 2).sum(axis=1)))
        costs[k] = k + 300 * dim * np.mean(x[:, :k] @ x[:, :k].T + np.outer(left, left) >= least)
    return min(costs, key=costs.get)


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is true; rows are a multiple of eight long, and eight are skipped at a time."""
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    if not len(words):
        return words, words
    k, bit = np.nonzero(mask.reshape(-1, 8)[words])
    return np.divmod(words[k] * 8 + bit, mask.shape[1])


class Tile:
    """Vectors of one label that are neighbours on the first axis: as given, and their leading dimensions with the norm of the rest."""

    def __init__(self, number: int, lo: float, hi: float, ids: pa.Buffer, vectors: pa.Buffer, dim: int, dtype: type, axes: tuple | None) -> None:
        self.number, self.lo, self.hi = number, lo, hi
        self.node, self.m, self.h1, self.h2 = np.frombuffer(ids, np.int64).reshape(4, -1)
        self.v = np.frombuffer(vectors, dtype).reshape(-1, dim)
        turn, k = axes or (np.eye(dim), min(dim, 16))
        v = self.v.astype(np.float64)
        self.norm = np.sqrt(np.einsum("nd,nd->n", v, v))
        lead = v / self.norm[:, None] @ turn[:, :k]
        left = np.sqrt(np.maximum(0, 1 - np.einsum("nd,nd->n", lead, lead))) if k < dim else np.zeros(len(lead))
        self.lead = np.column_stack([lead, left]).astype(np.float32)
        self.links = np.zeros(len(lead), np.int64)

    def units(self, rows: slice) -> np.ndarray:
        return (self.v[rows] / self.norm[rows, None]).astype(np.float32)

    def cosines(self, other: Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the vectors at these places, in double precision."""
        out = np.empty(len(i))
        step = max(1, 2**20 // self.v.shape[1])
        for s in range(0, len(i), step):
            a, b = i[s : s + step], j[s : s + step]
            x, y = (t.v[at].astype(np.float64) for t, at in ((self, a), (other, b)))
            out[s : s + step] = np.einsum("nd,nd->n", x, y) / (self.norm[a] * other.norm[b])
        return out

    def pairs(self, other: Tile, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the vectors here and there whose cosine is at least so much, some rows at a time."""
        n, m, dim = len(self.v), len(other.v), self.v.shape[1]
        rounding = lambda k: (k + 10) * 2.0**-23
        wide = -(-m // 8) * 8
        columns = np.zeros((other.lead.shape[1], wide), np.float32)
        columns[:, :m] = other.lead.T
        mask = np.zeros((min(CHUNK, n), wide), bool)
        bounds = np.zeros((min(CHUNK, n), wide), np.float32)
        enough, all_columns = np.float32(least - rounding(len(columns))), None
        for k in range(0, n, CHUNK):
            rows = slice(k, min(k + CHUNK, n))
            p, yes = bounds[: rows.stop - k], mask[: rows.stop - k]
            np.matmul(self.lead[rows], columns, out=p)
            np.greater_equal(p, enough, out=yes)
            yes[:, m:] = False
            if np.count_nonzero(yes) > 5 * (len(p) + m) + p.size / 100:  # from here on a product of all dimensions is cheaper
                if all_columns is None:
                    all_columns = np.zeros((dim, wide), np.float32)
                    all_columns[:, :m] = other.units(slice(None)).T
                np.matmul(self.units(rows), all_columns, out=p)
                yes &= p >= np.float32(least - rounding(dim))
                i, j = hits(yes & (p < np.float32(least + rounding(dim))))
                yes[i, j] = self.cosines(other, i + k, j) >= least
                i, j = hits(yes)
            else:
                i, j = hits(yes)
                on = self.cosines(other, i + k, j) >= least
                i, j = i[on], j[on]
            if len(i):
                yield i + k, j


class Block:
    """The tiles that a task holds, with the components of their vectors as far as they are known."""

    def __init__(self, least: float) -> None:
        self.least = least
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
        self.tiles: list[Tile] = []
        self.parent = array("q")

    def find(self, place: int) -> int:
        root = place
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[place] != root:
            self.parent[place], place = root, self.parent[place]
        return root

    def roots(self, places: np.ndarray) -> np.ndarray:
        each, back = np.unique(places, return_inverse=True)
        return np.array([self.find(p) for p in each.tolist()], np.int64)[back]

    def hold(self, tile: Tile) -> None:
        """Compare a tile with those held and with itself, and hold it."""
        start = len(self.parent)
        tile.root = np.arange(start, start + len(tile.v))
        self.parent.extend(tile.root.tolist())
        tile.links += tile.m - 1
        self.tiles.append(tile)
        self.meet(tile)

    def meet(self, tile: Tile) -> None:
        """Count the links of a tile with those held; a tile that is not held gets its components' roots from them (-1: none)."""
        if not self.tiles or self.tiles[-1] is not tile:
            tile.root = np.full(len(tile.v), -1)
        for held in self.tiles:
            if held.lo - tile.hi > self.reach or tile.lo - held.hi > self.reach:
                continue
            for i, j in held.pairs(tile, self.least):
                if held is tile:
                    i, j = i[i < j], j[i < j]
                held.links += np.bincount(i, tile.m[j], len(held.v)).astype(np.int64)
                tile.links += np.bincount(j, held.m[i], len(tile.v)).astype(np.int64)
                new = tile.root[j] < 0
                tile.root[j[new]] = held.root[i[new]]
                new = held.root[i] != tile.root[j]
                i, j = i[new], j[new]
                n = len(self.parent)
                for pair in np.unique(held.root[i] * n + tile.root[j]).tolist():
                    a, b = self.find(pair // n), self.find(pair % n)
                    self.parent[max(a, b)] = min(a, b)
                held.root[i] = self.roots(held.root[i])
                tile.root[j] = self.roots(tile.root[j])

    def linked(self, tile: Tile) -> tuple[np.ndarray, ...]:
        """Hashes, class numbers, least ids, class numbers of a member of the component, and links, of the vectors with links."""
        at = np.flatnonzero(tile.links)
        roots = self.roots(tile.root[at])
        starts = np.cumsum([0, *(len(t.v) for t in self.tiles)])
        which = np.searchsorted(starts, roots, "right") - 1
        numbers = np.array([t.number for t in self.tiles], np.int64)[which] + roots - starts[which]
        return tile.h1[at], tile.h2[at], tile.number + at, tile.node[at], numbers, tile.links[at]


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    least: float = 0.93) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` (least id reachable, itself included) and ``kept`` per row.

    Links: equal labels that are not null, equal dimension, cosine of at least ``least``. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. Equal vectors link with each other; repeated
    rows count as vectors of their own. A null id is counted as a link of others but has a null component.
    An empty table gives an empty one; columns other than those named are left out. ``rows`` are read several times
    rather than copied, so they have to be the same every time.
    """
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    dtype = np.float32 if single else np.float64
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    all_rows = saved(keys(rows), "vector-keys")
    rotation = rows.sparkSession.sparkContext.broadcast(axes(rows, least))
    key = ["label", "dim", "h1", "h2"]
    kind = rows.schema["label"].dataType.simpleString()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors with their place on the first axis; copies within a batch are counted."""
        for batch in batches:
            for at, x, square in usable(batch):
                dim, turn = x.shape[1], rotation.value.get(x.shape[1])
                first = products(x, np.eye(1, dim)[0] if turn is None else turn[0][:, 0]) / np.sqrt(square)
                h1, h2 = hashes(x)
                label, node = (batch.column(c).take(pa.array(at)) for c in ("label", "id"))
                one = pa.table({"label": label, "h1": h1, "h2": h2, "node": pc.fill_null(node, NOBODY), "row": np.arange(len(at))}).group_by(
                    ["label", "h1", "h2"]).aggregate([("node", "min"), ("row", "count"), ("row", "min")])
                row = one.column("row_min").to_numpy()
                label, h1, h2, node, m = (one.column(c).combine_chunks() for c in ("label", "h1", "h2", "node_min", "row_count"))
                yield pa.RecordBatch.from_arrays(
                    [label, pa.array(np.full(len(row), dim, np.int32)), pa.array(first[row]), h1, h2, node, m, binaries(x[row])],
                    names=["label", "dim", "first", "h1", "h2", "node", "m", "v"])

    ordered = rows.mapInArrow(order, f"label {kind}, dim int, first double, h1 long, h2 long, node long, m long, v binary")
    place = ["label", "dim", "first", "h1", "h2"]
    tile_bytes, width = TILE_BYTES, np.dtype(dtype).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors become classes, and consecutive classes of a label tiles."""
        made, task = 0, TaskContext.get().partitionId()

        def tiles(held: list[pa.RecordBatch], size: int, last: bool) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
            """Full tiles of a label's rows, and the rows left over; at the end of the label all rows."""
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            h1, h2, m, node = (t.column(c).to_numpy() for c in ("h1", "h2", "m", "node"))
            starts = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            one = t.take(pa.array(starts)).combine_chunks()
            for c, x in (("m", np.add.reduceat(m, starts)), ("node", np.minimum.reduceat(node, starts))):
                one = one.set_column(one.schema.get_field_index(c), c, pa.array(x))
            out, ends = [], len(starts) if last else (len(starts) - 1) // size * size  # the last class may go on
            for s in range(0, ends, size):
                tile = one.slice(s, min(size, ends - s))
                first = tile.column("first").to_numpy()
                ids = b"".join(tile.column(c).to_numpy().tobytes() for c in ("node", "m", "h1", "h2"))
                vectors = b"".join(tile.column("v").to_pylist())
                number = ((task << TILE_BITS) + made) << PLACE_BITS
                made += 1
                out.append(pa.RecordBatch.from_arrays(
                    [*(tile.column(c).slice(0, 1).combine_chunks() for c in ("label", "dim")), pa.array([number], pa.int64()),
                     *(pa.array([x]) for x in (float(first[0]), float(first[-1]), len(first))), *(pa.array([x], pa.binary()) for x in (ids, vectors))],
                    names=["label", "dim", "tile", "lo", "hi", "n", "ids", "vs"]))
            return out, one.slice(ends).to_batches() if ends < len(starts) else []

        held, size, now = [], 1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            label, dim = pc.dictionary_encode(batch.column("label")).indices.to_numpy(), batch.column("dim").to_numpy()
            bounds = [0, *(np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1).tolist(), batch.num_rows]
            for s, e in pairwise(bounds):
                here = (batch.column("label")[s].as_py(), int(dim[s]))
                if held and here != now:
                    yield from tiles(held, size, True)[0]
                    held = []
                now, size = here, min(max(1, tile_bytes // (here[1] * width)), 1 << PLACE_BITS)
                held.append(batch.slice(s, e - s))
                if sum(b.num_rows for b in held) > 2 * size:
                    out, held = tiles(held, size, False)
                    yield from out
        if held:
            yield from tiles(held, size, True)[0]

    tiles = saved(ordered.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(
        cut, f"label {kind}, dim int, tile long, lo double, hi double, n long, ids binary, vs binary"), "tiles")

    # every block meets itself and the half of the others that precedes it, in a circle
    along = Window.partitionBy("label", "dim").orderBy("lo", "tile").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("label", "dim"))
    size = total * F.col("dim") * width
    blocks = F.greatest(F.ceil(size / BLOCK_BYTES), F.least(F.ceil(size / SPLIT_BYTES), F.lit(3)))
    placed = saved(tiles.select(
        "label", "dim", "tile", "lo", "hi", blocks.alias("blocks"), F.floor(F.coalesce(F.sum("n").over(along), F.lit(0)) * blocks / total).alias("block")),
        "tile-blocks")
    held = placed.groupBy("label", "dim", F.col("block").alias("target")).agg(F.min("lo").alias("from"), F.max("hi").alias("to"))
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("blocks") / 2)))
    meets = placed.withColumn("step", steps).withColumn("target", F.pmod(F.col("block") - F.col("step"), F.col("blocks"))).filter(
        (2 * F.col("step") != F.col("blocks")) | (F.col("target") < F.col("block")))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    near = (F.col("lo") - F.col("to") <= reach) & (F.col("from") - F.col("hi") <= reach)
    meets = small_side(saved(meets.join(held, ["label", "dim", "target"]).filter(near).select("tile", "target", "step"), "tile-targets"))
    task = ["label", "dim", "target"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = Block(least), None

        def rows_of(tile: Tile) -> pa.RecordBatch:
            h1, h2, *found = block.linked(tile)
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(h1), label_type), pa.array(np.full(len(h1), now[1], np.int32)), *map(pa.array, (h1, h2, *found))],
                names=["label", "dim", "h1", "h2", "number", "node", "root", "links"])

        for batch in batches:
            label_type = batch.schema.field("label").type
            for row in range(batch.num_rows):
                label, dim, target, step, number, lo, hi = (batch.column(c)[row].as_py() for c in (*task, "step", "tile", "lo", "hi"))
                if now != (label, dim, target):
                    yield from map(rows_of, block.tiles)
                    block, now = Block(least), (label, dim, target)
                tile = Tile(number, lo, hi, *(batch.column(c)[row].as_buffer() for c in ("ids", "vs")), dim, dtype, rotation.value.get(dim))
                if step == 0:
                    block.hold(tile)
                else:
                    block.meet(tile)
                    yield rows_of(tile)
        yield from map(rows_of, block.tiles)

    spread = tiles.join(meets, "tile").select(*task, "step", "tile", "lo", "hi", "ids", "vs").repartition(*task).sortWithinPartitions(*task, "step", "tile")
    with small_batches(rows.sparkSession, TILES):
        found = saved(spread.mapInArrow(
            match, f"label {kind}, dim int, h1 long, h2 long, number long, node long, root long, links long"), "tile-links")
    reached = components(found.select(F.col("number").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "number")
    node = F.when(F.col("node") != NOBODY, F.col("node"))
    classes = found.groupBy(*key).agg(F.min("number").alias("number"), F.min(node).alias("node"), F.sum("links").alias("links"))
    classes = saved(classes.join(reached, "number", "left").withColumn("component", F.coalesce("component", "number")), "linked-vectors")
    names = classes.groupBy("component").agg(F.min("node").alias("named"))
    result = classes.join(names, "component").select(*key, "links", "named", F.lit(True).alias("linked"))
    out = all_rows.join(result, key, "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("linked"), F.col("named")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
