"""Proportional stratified interleaving: deal rows into shards that all match the mixture of sources.

DataFrame operations only. Every row gets a seeded random key; its rank within its source, divided by the
source's size, says how far through the source it lies. All rows sorted by that fraction form one sequence in
which every source is spread evenly, and equal cuts of the sequence are the shards: their row counts differ by
one at most and each holds its share of every source, give or take a row or two.

No sort ever gathers a source or the whole table in one task. Ranks within a source are counted per slice of the
key's first hex digits (a rank is the rows in earlier slices plus the rank in the slice), and positions in the
sequence the same way per slice of the fraction; both offset tables are aggregates. Sources start evenly spaced, so
that many small ones do not all fall on one fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import small_side
from cinelake.operators.ranking import positions
from cinelake.session import saved

#: Hex digits of the key that name a slice: 16**3 slices per source.
SLICE_DIGITS = 3
#: Slices of the fraction.
CELLS = 4096


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the text in UTF-8 (null: of nothing, which is 0)."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def interleave(
    rows: DataFrame, n_shards: int, *, id_col: str = "doc_id", stratum_col: str = "source", seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows ``id_col``, ``keep``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    A null stratum is a stratum of its own, a null id an id of its own. Repeated rows are dealt like any others;
    rows that agree in id and ``keep`` are interchangeable. An empty table gives an empty one; with fewer
    rows than shards some shards stay empty. Columns other than those named are left out, so their names
    cannot clash.
    """
    unnamed = F.concat_ws(":", F.lit("null"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keep])  # spreads null ids
    ident = F.coalesce(F.col(id_col).cast("string"), unnamed)
    narrow = rows.select(
        F.col(id_col).alias("_id"),
        F.concat(F.when(F.col(stratum_col).isNull(), "n").otherwise("v"),
                 F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).alias("_s"),
        F.md5(F.concat(F.lit(f"{seed}:"), ident).cast("binary")).alias("_key"),
        F.struct(*keep, F.lit(0).alias("_")).alias("_kept"),
    ).withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))
    narrow = saved(narrow, "interleave-rows")

    counts = narrow.groupBy("_s", "_slice").agg(F.count("*").alias("_n"))
    by_slice = Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_s", "_slice",
        F.coalesce(F.sum("_n").over(by_slice), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_s")).alias("_size"),
    )
    order = Window.partitionBy("_s", "_slice").orderBy("_key", "_id", "_kept")
    sources = saved(positions(saved(narrow.select("_s").distinct(), "interleave-names"), ["_s"], "_at"), "interleave-sources")
    n_sources = sources.count()
    start = (F.col("_at") + 0.5) / F.lit(float(n_sources))
    ranked = (
        narrow.join(offsets, ["_s", "_slice"]).join(small_side(sources), "_s")
        .withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1)
        .select("_id", "_s", "_key", "_kept",
                ((F.col("_rank") + start) / F.col("_size")).alias("_frac"))
        .withColumn("_cell", F.floor(F.col("_frac") * CELLS))
    )
    ranked = saved(ranked, "interleave-ranks")

    cells = ranked.groupBy("_cell").agg(F.count("*").alias("_n"))  # at most CELLS rows
    everything = Window.partitionBy(F.lit(0))
    starts = cells.select(
        "_cell",
        F.coalesce(F.sum("_n").over(everything.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias("_total"),
    )
    within = Window.partitionBy("_cell").orderBy("_frac", "_s", "_key", "_id", "_kept")
    return (
        ranked.join(starts, "_cell")
        .withColumn("_pos", F.col("_before") + F.row_number().over(within) - 1)
        .withColumn("shard", F.expr(f"CAST((_pos * {n_shards}) DIV _total AS INT)"))
        .withColumn("slot", F.expr(f"_pos - (shard * _total + {n_shards - 1}) DIV {n_shards}"))
        .select(F.col("_id").alias(id_col), *[F.col(f"_kept.{c}").alias(c) for c in keep], "shard", "slot")
    )
