"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Odd multiplier of the polynomial word-window hashes.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin where there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns of a batch as row tuples."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that only a piece's values become Python objects at a time.

    What Arrow has freed goes back to the system after every batch: workers are reused, and others need the memory.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        del batch
        pa.default_memory_pool().release_unused()


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order is as good as random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes; empty where there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    h = words[:n].copy()
    for k in range(1, width):
        h *= MULTIPLIER
        h += words[k : n + k]
    return mix(h)


#: Rows up to which a small table may be broadcast.
BROADCAST_ROWS = 500_000


def small_side(written: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The written table, marked for broadcast if it is within the bound; beyond it joins shuffle."""
    return F.broadcast(written) if written.count() <= max_rows else written


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Actions inside hand Python workers batches of so many rows; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
