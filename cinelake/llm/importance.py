"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The raw model counts hashed words and word pairs over all documents, the target model over documents labelled good.
A document's importance is the ratio of the two models, averaged over its n-grams and scaled to a
nominal length, so that long texts have no advantage. Gumbel noise drawn from the id is added to the log weight; the k
greatest sums are a sample without replacement in proportion to the weights. k is the number of documents whose weight
lies on the good side of a threshold fitted on held-out labels.

Both counts are summed per task into arrays of fixed size and merged by slices. Labels are the only bounded sample
(``MAX_LABELS``, by hash); the raw model, the weights, the threshold's count and the cut cover all documents. No text
is shuffled: the cut is one number, found by histograms, and decisions follow from a row alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import MULTIPLIER, slices
from cinelake.session import saved

#: Buckets of words and of word pairs; both models together are 4 MB in a task.
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SLICES = 64
#: Pseudo-counts of a bucket of words and of pairs: rare n-grams say little.
SHRINK = (10.0, 30.0)
#: Pairs overlap with the words, so they are no independent evidence and count less.
PAIR_WEIGHT = 0.3
#: N-grams every document counts as.
NOMINAL_LENGTH = 250
#: Labelled documents used for fitting, and the share of them held out for the threshold.
MAX_LABELS = 500_000
HELD_OUT = 5
RAW, TARGET, HELD_GOOD, HELD_BAD = 0, 1, 2, 3


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray  # log ratio per bucket: words, then pairs
    cut: float  # least Gumbel key of the sample
    seed: str

    def keeps(self, ident: int | None, text: bytes | None) -> bool:
        return self.key(ident, log_weight(self.ratios, text)) >= self.cut

    def key(self, ident: int | None, weight: float) -> float:
        u = ((xxhash.xxh64_intdigest(f"{self.seed}:{ident}") >> 11) + 0.5) / (1 << 53)
        return weight - float(np.log(-np.log(u)))


def buckets(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased words and of the pairs of neighbouring words."""
    words = (text or b"").lower().split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * MULTIPLIER
    pairs = (h[:-1] * np.uint64(3) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    down = np.uint64(64 - BUCKET_BITS)
    return (h >> down).astype(np.int64), (pairs >> down).astype(np.int64)


def log_weight(ratios: np.ndarray, text: bytes | None) -> float:
    """Log importance at the nominal length; 0 for a text without words."""
    words, pairs = buckets(text)
    if not len(words):
        return 0.0
    total = float(ratios[words].sum()) + PAIR_WEIGHT * float(ratios[pairs + BUCKETS].sum())
    return NOMINAL_LENGTH * total / len(words)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """The texts of a batch, one at a time."""
    for text in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield text.as_py()


def roles(labels: DataFrame, good: Column, seed: str) -> DataFrame:
    """``_id`` and ``role`` of at most about ``MAX_LABELS`` labelled documents; contradicting labels count as bad."""
    per_id = labels.filter("_id IS NOT NULL").groupBy("_id").agg(F.min(good.cast("int")).alias("good"))
    n = per_id.count()
    h = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1_000_000))
    if n > MAX_LABELS:
        per_id = per_id.filter(h < 1_000_000 * MAX_LABELS // n)
    held = F.pmod(F.xxhash64(F.lit(f"{seed}-held"), "_id"), F.lit(HELD_OUT)) == 0
    role = (F.when(held & (F.col("good") == 1), HELD_GOOD).when(held, HELD_BAD)
            .when(F.col("good") == 1, TARGET).otherwise(RAW))
    return saved(per_id.select("_id", role.alias("role")), "roles")


def count(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of all rows and of the target rows, per bucket."""
    width = 2 * BUCKETS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2 * BUCKETS), np.int64)
        held: list[list[np.ndarray]] = [[], [], [], []]  # raw words and pairs, target words and pairs

        def flush() -> None:
            for k, found in enumerate(held):
                if found:
                    part = slice(k % 2 * BUCKETS, (k % 2 + 1) * BUCKETS)
                    sums[k // 2, part] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                    found.clear()

        size = 0
        for batch in slices(batches):
            for text, role in zip(texts(batch), batch.column("role").to_pylist(), strict=True):
                hashed = buckets(text)
                size += len(hashed[0])
                for k in (0, 2) if role == TARGET else (0,):
                    held[k].append(hashed[0])
                    held[k + 1].append(hashed[1])
                if size >= BUCKETS:
                    flush()
                    size = 0
        flush()
        blobs = [[s[k * width : (k + 1) * width].tobytes() for k in range(SLICES)] for s in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())],
            names=["slice", "raw", "target"])

    def add(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in part:
            for s, raw, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = np.stack([np.frombuffer(raw, np.int64), np.frombuffer(target, np.int64)])
                sums[s] = sums[s] + both if s in sums else both
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v[0].tobytes() for v in sums.values()], pa.binary()),
             pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], names=["slice", "raw", "target"])

    kind = "slice int, raw binary, target binary"
    merged = rows.select("text", "role").mapInArrow(run, kind).repartition(SLICES, "slice").mapInArrow(add, kind).toArrow()
    out = np.zeros((2, 2 * BUCKETS), np.int64)
    for s, raw, target in zip(*(c.to_pylist() for c in merged.columns), strict=True):  # SLICES rows of fixed size
        out[0, s * width : (s + 1) * width] = np.frombuffer(raw, np.int64)
        out[1, s * width : (s + 1) * width] = np.frombuffer(target, np.int64)
    return out[0], out[1]


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target counts to those expected from the raw model, both shrunk."""
    out = np.zeros(2 * BUCKETS, np.float32)
    for k, shrink in enumerate(SHRINK):
        part = slice(k * BUCKETS, (k + 1) * BUCKETS)
        total = raw[part].sum()
        if total and target[part].sum():
            expected = raw[part] * (target[part].sum() / total)
            out[part] = np.log((target[part] + shrink) / (expected + shrink))
    return out


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """Weight that separates held-out good from bad best (sum of both rates): the middle of the gap between the greatest
    weight dropped and the least one kept; none without either."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    at = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(good, at, "left") / len(good)
    dropped = np.searchsorted(bad, at, "left") / len(bad)
    best = int(np.argmax(kept + dropped))
    return float((at[best - 1] + at[best]) / 2) if best else float(at[0])


def kth_greatest(rows: DataFrame, column: str, k: int, *, bins: int = 1024, enough: int = 1000) -> float:
    """The k-th greatest value, by histograms that close in on it; at most ``bins`` or ``enough`` values reach the driver."""
    lo, hi, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return -np.inf
    if k < 1:
        return np.inf
    left = k  # rank of the wanted value among those in [lo, hi]
    c = F.col(column)
    while True:
        inside = rows.filter((c >= lo) & (c <= hi))
        if n <= enough:
            return sorted((r[0] for r in inside.select(c).collect()), reverse=True)[left - 1]
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        of = F.least(F.floor((c - lo) / width), F.lit(bins - 1))
        got = sorted(inside.groupBy(of.alias("bin")).agg(F.count("*"), F.min(c), F.max(c)).collect(), reverse=True)
        for _, m, least, most in got:
            if left <= m:
                lo, hi, n = least, most, m
                break
            left -= m


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
        good: Column | None = None, seed: str = "gumbel") -> tuple[Model, DataFrame]:
    """The model with its cut, and ``id_col``, ``log_weight``, ``key`` of every row.

    ``good`` tells target labels (default: quality 1 and not toxic). Null ids have no label; a null or empty text has weight
    0. Rows with equal id and text share a key and are kept or rejected together. Without target labels, or
    without bad ones to hold against them, every row is kept. Empty tables give empty ones.
    """
    if good is None:
        good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = roles(labels.withColumn("_id", F.col(label_id)), good, seed)
    marked = rows.join(F.broadcast(known), F.col("id") == F.col("_id"), "left").select(
        "id", "text", F.coalesce("role", F.lit(RAW)).alias("role"))
    ratios = log_ratios(*count(marked))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    unset = Model(np.zeros(0), 0.0, seed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            weights = [log_weight(shared.value, t) for t in texts(batch)]
            keys = [unset.key(i, w) for i, w in zip(batch.column("id").to_pylist(), weights, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("role"), pa.array(weights, pa.float64()), pa.array(keys, pa.float64())],
                names=["id", "role", "log_weight", "key"])

    kind = rows.schema["id"].dataType.simpleString()
    scores = saved(marked.mapInArrow(score, f"id {kind}, role int, log_weight double, key double"), "scores")
    held = scores.filter(F.col("role").isin(HELD_GOOD, HELD_BAD)).select("role", "log_weight").toArrow()  # bounded by MAX_LABELS
    role, weight = held.column("role").to_numpy(), held.column("log_weight").to_numpy()
    least = threshold(weight[role == HELD_GOOD], weight[role == HELD_BAD])
    k = scores.filter(F.col("log_weight") >= float(least)).count() if np.isfinite(least) else scores.count()
    cut = kth_greatest(scores, "key", k)
    return Model(ratios, cut, seed), scores.select(F.col("id").alias(id_col), "log_weight", "key")


def sample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``id_col``, ``log_weight`` and ``key`` of the rows in the sample."""
    model, scores = fit(docs, labels, **options)
    return scores.filter(F.col("key") >= F.lit(float(model.cut)))


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows in the sample with all their columns."""
    model, _ = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            yield batch.filter(pa.array([shared.value.keeps(i, t) for i, t in zip(ids, texts(batch, text_col), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
