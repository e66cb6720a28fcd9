"""Connected components by alternating large and small stars, and fixed-size bitmaps over ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.session import saved


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (least node it reaches) for every node on an edge (``a``, ``b``).

    Each round rewires every node's larger neighbours to its least neighbour (large star), then its smaller
    ones (small star); the stars left at the end are the components. Rounds grow with the logarithm of the node count.
    Minima are combined before the shuffle and the joins that follow may be split by AQE, so a node with
    very many neighbours fills no task. Every round is written to the shared folder. Loops are ignored,
    repeated edges count once, and no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    e = saved(e, "edges")
    before = _signature(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = saved(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = saved(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        after = _signature(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


#: Bits of a bitmap: 2**26 are 8 MB, whatever the number of values.
BITMAP_BITS = 26


def bit_of(value: Column) -> Column:
    """The bit of a value."""
    return F.xxhash64(value).bitwiseAND((1 << BITMAP_BITS) - 1)


def bitmap(values: DataFrame, bit: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap (unsigned 64-bit words) of the bits of all rows: a prefilter that may only err by saying yes.

    Its size is fixed: at most 2**(bits - 6) words reach the driver, however many values there are. With very many
    values it fills up and lets more through, which costs time but loses nothing.
    """
    words = values.select(bit.alias("bit")).selectExpr("bit >> 6 AS w", "shiftleft(1L, CAST(bit & 63 AS INT)) AS x")
    got = words.groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("x").to_numpy()
    return out.view(np.uint64)


def holds(bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each bit."""
    bit = bit.astype(np.int64)
    return ((bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
