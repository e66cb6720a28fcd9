"""Joins against lookup tables: broadcast behind a size check, shuffle otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.session import saved

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small: rows first, bytes only if those fit; every partition sends one row."""
    n = df.agg(F.count(F.lit(1))).first()[0]
    if n > max_rows:
        return False
    row_bytes = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return (df.agg(F.sum(row_bytes)).first()[0] or 0) <= max_bytes


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled and never broadcast.

    Spark takes a written table for as large as its files. Compressed keys and zeros make millions of rows look
    smaller than the broadcast limit, and unpacked they do not fit into the driver.
    """
    return df.hint("merge")


def lookup_join(
    probe: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    computed: bool = False,
) -> DataFrame:
    """Join many rows to a lookup table whose keys may be hot on the probe side.

    A table of checked size is broadcast. A larger one is joined by shuffle, where adaptive execution
    splits the probe side of a hot key over tasks, equal rows too. A ``computed`` table is written out
    first, so that the check and the join share one computation.
    """
    on = list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the lookup side can only be the right side")
    if computed:
        table = saved(table, "lookup")
    if fits_broadcast(table, max_rows):
        return probe.join(F.broadcast(table), on, how)
    return probe.join(shuffled(table), on, how)
