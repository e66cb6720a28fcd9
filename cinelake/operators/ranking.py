"""Positions in one total order over a whole table, without a window that holds the table.

Range splitters come from Spark's bounded sample of the order columns. Each partition then holds one stretch of
the order, sorted; a row's position is the number of rows in the stretches before its own plus its place inside. The only
table that meets in one task has a row per partition. Rows that agree in all order columns lie in one stretch, so the
order should end with columns that tell rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.session import saved

#: Bits of a row's place inside its partition, as ``monotonically_increasing_id`` lays them out.
_PLACE_BITS = 33


def positions(df: DataFrame, order: Sequence[str | Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's position (long, from 0) in ``order``.

    The input is computed twice (for the sample and for the shuffle), so it should be a written table or cheap. The result
    is a written table. Equal rows are placed in any order; an empty table stays empty.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("_at", F.monotonically_increasing_id()), "positions")
    stretch = F.shiftright("_at", _PLACE_BITS)
    counts = placed.groupBy(stretch.alias("_stretch")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_stretch", stretch).join(F.broadcast(starts), "_stretch")  # a row per partition
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))
