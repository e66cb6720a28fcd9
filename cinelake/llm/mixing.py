"""Mixing sources to target weights by systematic sampling.

Each source gets a target of words. A document's expected number of copies is its source's target over its source's
words. The expected copies are summed up along the source's documents, one random offset of the source is added, and a
document is emitted once for every whole number its stretch of the sum crosses. All documents of a source expect the
same, so the sum before the r-th document is r times that, and the count of the copies taken is off by less than one.

Documents lie in the order of their sizes: then the words taken differ from the target by no more than the
largest document or so, however uneven sizes are. Ties go by a seeded hash of the id. The order comes from range
splitters (``positions``), so a source of any size spreads over tasks. Crossings are counted in whole
numbers of up to 38 digits, never in rounded sums, so that a rerun takes the same documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import small_side
from cinelake.operators.ranking import positions
from cinelake.session import saved

#: A word, as the size counts them.
WORD = r"[^\x20\x09-\x0D]+"
WIDE = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Number of words of the text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """``source``, ``source_size``, ``first`` (position of its first document), and the target as ``num`` / ``den``.

    Sources (``source``, ``source_size``, ``first``) in the order of ``first`` weigh ``weights``, repeating. Together they get
    ``share`` of all sizes. No target exceeds ``most`` times its source's size: what a source cannot take is shared out
    again among the others by weight until none is above its limit. Every round caps a source at least; two
    numbers a round reach the driver.
    """
    at = saved(positions(sizes, ["first"], "_at"), "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    at = at.withColumn("weight", weight.cast("long"))
    total = at.agg(F.sum("source_size")).first()[0] or 0
    above, below = share
    # in units of 1 / below words: what a source can take, and what is left to share
    full = {"words": 0, "weight": 0}
    limit = F.col("source_size").cast(WIDE) * most * below
    everything = at.agg(F.sum("weight")).first()[0] or 0
    open_weight, left = everything, total * above
    capped = F.lit(False)
    while open_weight:
        capped = F.col("weight").cast(WIDE) * left > limit * open_weight
        got = at.filter(capped).agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
        if (got[0], got[1]) == (full["weight"], full["words"]):
            break
        full = {"weight": got[0], "words": got[1]}
        open_weight, left = everything - got[0], total * above - got[1] * most * below
    shared_out = F.col("weight").cast(WIDE) * max(left, 0)
    num = F.when(capped, F.col("source_size").cast(WIDE) * most).otherwise(shared_out) if open_weight else F.col("source_size").cast(WIDE) * most
    den = F.when(capped, F.lit(1)).otherwise(F.lit(open_weight * below)) if open_weight else F.lit(1)
    return at.select("source", "source_size", "first", num.cast(WIDE).alias("num"), den.cast("long").alias("den"))


def mix(rows: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
        weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix") -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target`` (of the row's source), ``copies`` and ``taken`` (copies times size) per row.

    ``size`` (default: words of ``text``) is a whole number, at least 0. Sources are ordered by code point, null last, as a
    source of its own; ``share`` is a fraction of all sizes. No row has more than ``most`` copies. A source without words has
    target 0, and its rows have no copies. Rows with a null id are rows of their own; repeated rows are drawn one by one. An empty table gives an
    empty one; columns other than those named are left out, so their names cannot clash.
    """
    size = n_words(F.col("text")) if size is None else size
    narrow = rows.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.cast("long").alias("size"))
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"))
    # the number tells repeated rows apart for the splitters; it is written once and so stays the same
    narrow = saved(narrow.withColumns({"tie": tie, "row": F.monotonically_increasing_id()}), "mix-rows")
    placed = positions(narrow, [F.col("source").asc_nulls_last(), "size", "tie", "id", "row"], "_place").drop("tie", "row")
    placed = saved(placed, "mix-places")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_place").alias("first"))
    goal = targets(saved(sizes, "mix-sizes"), weights, share, most)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("source").isNull(), "n").otherwise("v"),
                                              F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10)
    unit = F.greatest(F.col("den").cast("decimal(18,0)") * F.col("source_size").cast("decimal(18,0)"), F.lit(1)).cast(WIDE)
    goal = saved(goal.select(F.col("source").alias("source_"), "source_size", "first", "num", "den", unit.alias("unit"),
                             (start.cast("double") / F.lit(4294967296.0)).alias("offset")), "mix-targets")
    both = placed.join(small_side(goal), F.col("source").eqNullSafe(F.col("source_")))

    def crossed(rank: Column) -> Column:
        """Whole numbers up to the expected copies of so many documents plus the offset."""
        upto = (rank.cast("decimal(18,0)") * F.col("num")).cast(WIDE)
        whole = F.call_function("div", upto, F.col("unit"))
        over = (upto % F.col("unit")).cast("double") / F.col("unit").cast("double") + F.col("offset")
        return whole + F.when(over >= 1, 1).otherwise(0)

    rank = F.col("_place") - F.col("first")
    copies = F.when(F.col("source_size") > 0, crossed(rank + 1) - crossed(rank)).otherwise(0).cast("long")
    return both.select(
        F.col("id").alias(id_col), "size", "source_size", (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"),
        copies.alias("copies"), (copies * F.col("size")).alias("taken"))
