"""Hard-negative mining on rotated one-bit codes with stored code-vector alignment.

Vectors are whole numbers; a score is an exact inner product. Each unit vector is rotated, and the signs of its coordinates
are its code: a corner of the cube, a few bits long. Stored beside it is its alignment, the product of the vector and the
(unit) corner; what the corner leaves over is coded again, so a vector has ``LEVELS`` codes and as many alignments, and the norm of the
last remainder. An anchor is quantised to bit planes, and its products with all corners are popcounts of planes and codes.
Alignment times that product estimates the cosine; Cauchy-Schwarz bounds what is missing by the norms of the two remainders,
so the interval holds for certain. A pair is dropped as soon as its interval shows that it cannot
count; each further code is read only for pairs still open, and what survives all codes is scored in whole numbers.

Rows and anchors are packed into blocks of bounded size, and a task compares one block of anchors with one of rows. It
returns no more than the best few per anchor (and positive); Spark cuts these lists again before it brings them together.
First every anchor meets the rows of its label, then, with its positives' scores, the rows of other labels. Work is
anchors times rows, as the exact contract asks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import small_batches, small_side
from cinelake.session import saved

#: One-bit codes of a vector, and bit planes of an anchor.
LEVELS = 4
PLANES = 8
#: Rows and anchors of a block (fewer where vectors are long): a task holds one of each.
BLOCK_BYTES = 8 << 20
#: Norm from which a vector takes no part: products of smaller ones fit 64 bits.
TOO_LONG = float(1 << 31)
#: Rounding of the bounds, relative to the product of the norms.
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and rotated unit vectors (zero vectors stay zero)."""
    norm = np.sqrt(np.einsum("nd,nd->n", x, x))
    return norm, (x / np.where(norm > 0, norm, 1)[:, None]) @ rotation(x.shape[1])


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as unsigned 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Norms, and per level and row the code (words), the alignment and the norm of the remainder."""
    norm, rest = unit_rows(x)
    root = np.sqrt(x.shape[1])
    words, aligned, left = [], [], []
    for _ in range(LEVELS):
        positive = rest >= 0
        corner = np.where(positive, 1 / root, -1 / root)
        a = np.einsum("nd,nd->n", rest, corner)
        rest = rest - a[:, None] * corner
        words.append(packed_bits(positive))
        aligned.append(a)
        left.append(np.sqrt(np.einsum("nd,nd->n", rest, rest)))
    return norm, np.stack(words), np.stack(aligned), np.stack(left)


class Anchor:
    """An anchor's bit planes, ready to be multiplied with codes."""

    def __init__(self, x: np.ndarray):
        norm, q = unit_rows(x[None])
        q = q[0]
        self.norm, self.root = float(norm[0]), np.sqrt(len(q))
        self.low = float(q.min())
        self.step = (float(q.max()) - self.low) / ((1 << PLANES) - 1)
        steps = np.rint((q - self.low) / self.step).astype(np.int64) if self.step > 0 else np.zeros(len(q), np.int64)
        self.planes = packed_bits(((steps >> np.arange(PLANES)[:, None]) & 1).astype(np.uint8))
        near = self.low + self.step * steps
        self.total = float(near.sum())
        self.off = float(np.sqrt(((q - near) ** 2).sum()))  # what the planes leave over
        self.length = float(np.sqrt((q * q).sum()))

    def corner_products(self, words: np.ndarray) -> np.ndarray:
        """Product of the quantised anchor with the corner of each code, from popcounts."""
        dim = 64 * words.shape[1]
        kind = np.int32 if dim << PLANES < 1 << 31 else np.int64
        weighted = np.zeros(len(words), kind)
        for j, plane in enumerate(self.planes):
            for w in range(words.shape[1]):
                weighted += np.bitwise_count(words[:, w] & plane[w]).astype(kind) << j
        set_bits = sum(np.bitwise_count(words[:, w]).astype(kind) for w in range(words.shape[1]))
        return (2 * (self.low * set_bits + self.step * weighted) - self.total) / self.root

    def interval(self, words: np.ndarray, aligned: np.ndarray, left: np.ndarray, norms: np.ndarray, before: np.ndarray,
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the scores after this level's code, and the estimate so far. ``before``: estimate of the earlier levels."""
        s = self.corner_products(words)
        estimate = before + aligned * s
        spread = self.off * (1.0 + left)  # what the planes leave over meets the codes' sum, a unit vector less the remainder
        # the remainder is orthogonal to this level's corner, so only the anchor's part beside that corner meets it
        across = np.sqrt(np.maximum(0.0, self.length**2 - np.maximum(0.0, np.abs(s) - self.off) ** 2))
        half = left * across + spread + SLACK
        scale = self.norm * norms
        return (estimate - half) * scale, (estimate + half) * scale, estimate


class Block:
    """Rows that are compared together: ids, row hashes, whole-number vectors and their codes."""

    def __init__(self, ids: bytes, hashes: bytes, named: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.hashes = np.frombuffer(hashes, np.int64)
        self.named = np.frombuffer(named, np.bool_)
        self.x = np.frombuffer(vectors, np.int32).reshape(len(self.ids), dim)
        self.wide = self.x.astype(np.float64)

    def coded(self) -> Block:
        self.norms, self.words, self.aligned, self.left = codes(self.wide)
        return self

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products with the rows ``at``."""
        x = self.wide[at]
        if np.abs(anchor).sum() * np.abs(x).max(initial=0.0) < 1 << 53:
            return (x @ anchor).astype(np.int64)
        return self.x[at].astype(np.int64) @ anchor.astype(np.int64)

    def best(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places in ``at`` of the k best: greater scores, then smaller ids (null last), then hashes."""
        if len(at) > 4 * k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            keep = np.nonzero(score >= least)[0]
        else:
            keep = np.arange(len(at))
        rows = at[keep]
        return keep[np.lexsort((self.hashes[rows], self.ids[rows], ~self.named[rows], -score[keep]))[:k]]


def levels(block: Block, anchor: Anchor) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per code the rows still open and the bounds of their scores; the caller sends back which of them stay open."""
    at, before, norms = np.arange(len(block.ids)), np.zeros(len(block.ids)), block.norms
    for words, aligned, left in zip(block.words, block.aligned, block.left, strict=True):
        if len(at) < len(words):
            words, aligned, left, norms = words[at], aligned[at], left[at], block.norms[at]
        low, high, estimate = anchor.interval(words, aligned, left, norms, before)
        on = yield at, low, high
        at, before = at[on], estimate[on]
    yield at, before, before


def top(block: Block, x: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows for an anchor, and their scores; ``skip`` is the anchor's own place."""
    steps = levels(block, Anchor(x))
    at, low, high = next(steps)
    least = -np.inf
    for _ in range(LEVELS):
        if len(at) > k + 1:  # exact scores of the most promising rows are a bound for all
            guess = at[np.argpartition(-(low + high), k)[: k + 1]]
            score = block.scores(x, guess[guess != skip] if skip is not None else guess)
            least = max(least, np.sort(score)[-k])
        on = high >= least
        if skip is not None:
            on &= at != skip
        at, low, high = steps.send(np.nonzero(on)[0])
    score = block.scores(x, at)
    chosen = block.best(at, score, k)
    return at[chosen], score[chosen]


def between(block: Block, x: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose score lies in [least, most], and their scores."""
    steps = levels(block, Anchor(x))
    at, low, high = next(steps)
    for _ in range(LEVELS):
        at, low, high = steps.send(np.nonzero((high >= least) & (low <= most))[0])
    score = block.scores(x, at)
    on = (score >= least) & (score <= most)
    return at[on], score[on]


def whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """``id``, ``label``, ``dim``, a hash of label and vector, and the packed vector of every row that takes part."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims, hashes, packed = [], [], [], []
            labels = batch.column("label").to_pylist()
            for k, v in enumerate(batch.column("vector")):
                if labels[k] is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(scale * np.asarray(v.values, np.float64))
                with np.errstate(over="ignore", invalid="ignore"):
                    if not np.sqrt((x * x).sum()) < TOO_LONG:
                        continue
                raw = x.astype(np.int32).tobytes()
                at.append(k)
                dims.append(len(x))
                hashes.append(xxhash.xxh3_64_intdigest(raw + repr(labels[k]).encode()))
                packed.append(raw)
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(took), batch.column("label").take(took), pa.array(dims, pa.int32()),
                 pa.array(np.array(hashes, np.uint64).view(np.int64), pa.int64()), pa.array(packed, pa.binary())],
                names=["id", "label", "dim", "h", "x"])

    return rows.mapInArrow(run, f"id long, label {kind}, dim int, h long, x binary")


def blocks(rows: DataFrame, block_bytes: int, carried: str | None = None) -> DataFrame:
    """Rows packed by label and dimension into blocks of about ``block_bytes``: hash-dealt parts of even size.

    The ``carried`` column (arrays of longs) comes along as a list.
    """
    kind = rows.schema["label"].dataType.simpleString()
    parts = rows.groupBy("label", "dim").agg(F.count("*").alias("n")).select(
        F.col("label").alias("label_"), F.col("dim").alias("dim_"),
        F.ceil(F.col("n") * (F.col("dim") * 8 + 32) / F.lit(block_bytes)).alias("parts"))
    dealt = rows.join(small_side(saved(parts, "block-counts")), (F.col("label") == F.col("label_")) & (F.col("dim") == F.col("dim_")))
    # the id takes part, so that copies of a vector spread as well
    dealt = dealt.select(*rows.columns, F.pmod(F.xxhash64("id", "h"), F.col("parts")).alias("part"))

    def pack(block: pa.Table) -> pa.Table:
        named = np.array([i is not None for i in block.column("id").to_pylist()], np.bool_)
        ids = block.column("id").fill_null(0).to_numpy()
        first = {c: pa.array([block.column(c)[0].as_py()], block.schema.field(c).type) for c in ("label", "dim", "part")}
        packed = {"ids": ids.tobytes(), "hs": block.column("h").to_numpy().tobytes(), "named": named.tobytes(),
                  "xs": b"".join(block.column("x").to_pylist())}
        lists = {carried: pa.array([block.column(carried).to_pylist()], pa.list_(pa.list_(pa.int64())))} if carried else {}
        return pa.table(first | {k: pa.array([v], pa.binary()) for k, v in packed.items()} | lists)

    out = dealt.groupBy("label", "dim", "part").applyInArrow(
        pack, f"label {kind}, dim int, part long, ids binary, hs binary, named binary, xs binary" + f", {carried} array<array<long>>" * bool(carried))
    return saved(out, "blocks")


PAYLOAD = ("ids", "hs", "named", "xs")


def met(anchors: DataFrame, rows: DataFrame, same: bool) -> DataFrame:
    """Pairs of an anchor block (``_a`` columns, and its labels) and a row block, of equal or of other labels."""
    here = anchors.select(*[F.col(c).alias(f"{c}_a") for c in ("label", "dim", "part")])
    there = rows.select("label", "dim", "part")
    label = F.col("label_a") == F.col("label")
    pairs = here.join(there, (F.col("dim_a") == F.col("dim")) & (label if same else ~label))  # the block directories: no vectors
    pairs = pairs.repartition("label_a", "part_a", "label", "part", "dim")
    full = anchors.select(*[F.col(c).alias(f"{c}_a") for c in anchors.columns])
    return pairs.join(full, ["label_a", "dim_a", "part_a"]).join(rows, ["label", "dim", "part"])


def block_of(batch: pa.RecordBatch, row: int, suffix: str = "") -> Block:
    dim = batch.column("dim")[row].as_py()
    return Block(*(batch.column(c + suffix)[row].as_py() for c in PAYLOAD), dim)


def best_rows(found: DataFrame, keys: list[str], k: int, rank: str, score: str, ident: str, tie: str) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows to k before they meet."""
    order: list[Column] = [F.col(score).desc(), F.col(ident).asc_nulls_last(), F.col(tie)]
    return found.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def mine(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256,
         anchor: Column | None = None, n_positives: int = 5, n_negatives: int = 5, band: tuple[int, int, int] = (80, 100, 100),
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Components become ``floor(scale * c)``. An anchor's positives are its best ``n_positives`` other rows of its label (default:
    column ``label``), a positive's negatives the best ``n_negatives`` rows of other labels with ``band[0] * positive <= band[1] * negative <=
    band[2] * positive``. Greater scores come first, ties by smaller id, null ids last. ``anchor`` (default: ids divisible
    by 100) picks the anchors; rows with a null id are none. Rows with a null label, a null or empty vector, a null or non-finite component, or a
    norm of 2**31 and more (their scores need not fit 64 bits) take no part, and only vectors of one dimension are compared.
    Rows equal in id, label and vector count once; rows that share an id only are rows of their own. A positive without
    negatives gives no rows, an empty table an empty one; columns other than those named are left out.
    """
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    anchor = F.col("id") % 100 == 0 if anchor is None else anchor
    narrow = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("vector"))
    with small_batches(spark, 500):
        kind = narrow.schema["label"].dataType.simpleString()
        once = whole_numbers(narrow, scale).filter("dim > 0").groupBy("id", "label", "dim", "h").agg(F.first("x").alias("x"))
        every = saved(once, "whole-numbers")
        row_blocks = blocks(every, block_bytes)
    asked = every.filter(F.col("id").isNotNull() & anchor)
    lo, mid, hi = band

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, block = block_of(batch, row, "_a"), block_of(batch, row).coded()
                own = {(i, h): k for k, (i, h, n) in enumerate(zip(block.ids.tolist(), block.hashes.tolist(), block.named, strict=True)) if n}
                cols: list[list] = [[] for _ in range(5)]
                for i, h, x in zip(one.ids.tolist(), one.hashes.tolist(), one.wide, strict=True):
                    at, score = top(block, x, n_positives, own.get((i, h)))
                    cols[0] += [i] * len(at)
                    cols[1] += [h] * len(at)
                    cols[2] += [int(block.ids[k]) if block.named[k] else None for k in at]
                    cols[3] += block.hashes[at].tolist()
                    cols[4] += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["anchor_id", "anchor_h", "positive_id", "positive_h", "positive_score"])

    key = ["anchor_id", "anchor_h"]
    with small_batches(spark, 4):
        anchor_blocks = blocks(asked, block_bytes)
        found = met(anchor_blocks, row_blocks, same=True).mapInArrow(
            positives, "anchor_id long, anchor_h long, positive_id long, positive_h long, positive_score long")
        liked = saved(best_rows(found, key, n_positives, "_rank", "positive_score", "positive_id", "positive_h"), "positives")

        # anchors again, each with its positives' scores: at most n_positives numbers a row
        scored = liked.groupBy(*key).agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))
        with_scores = asked.join(scored.select(F.col("anchor_id").alias("id"), F.col("anchor_h").alias("h"), "wanted"), ["id", "h"])
        again = met(blocks(with_scores, block_bytes, "wanted"), row_blocks, same=False)

        def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    one, block = block_of(batch, row, "_a"), block_of(batch, row).coded()
                    wanted = batch.column("wanted_a")[row].as_py()
                    cols: list[list] = [[] for _ in range(6)]
                    for i, h, x, scores in zip(one.ids.tolist(), one.hashes.tolist(), one.wide, wanted, strict=True):
                        scores = [p for p in scores if lo * p <= hi * p]
                        if not scores:
                            continue
                        least, most = (-(-lo * p // mid) for p in scores), (hi * p // mid for p in scores)
                        at, score = between(block, x, min(least), max(most))
                        for p in scores:
                            on = np.nonzero((lo * p <= mid * score) & (mid * score <= hi * p))[0]
                            chosen = on[block.best(at[on], score[on], n_negatives)]
                            cols[0] += [i] * len(chosen)
                            cols[1] += [h] * len(chosen)
                            cols[2] += [p] * len(chosen)
                            cols[3] += [int(block.ids[k]) if block.named[k] else None for k in at[chosen]]
                            cols[4] += block.hashes[at[chosen]].tolist()
                            cols[5] += score[chosen].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[
                        "anchor_id", "anchor_h", "positive_score", "negative_id", "negative_h", "negative_score"])

        hard = again.mapInArrow(negatives, "anchor_id long, anchor_h long, positive_score long, negative_id long, negative_h long, negative_score long")
        hard = saved(best_rows(hard, [*key, "positive_score"], n_negatives, "rank", "negative_score", "negative_id", "negative_h"), "negatives")
    return liked.join(hard, [*key, "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
