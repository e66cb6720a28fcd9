"""Running aggregates over very long keys.

A plain window puts all rows of a key in one task, so one huge file would decide the run time.
``ordered_scan`` cuts each key into chunks along its order, runs the window inside each chunk, scans
the one-row-per-chunk summaries, and adds each chunk's carry back. Rows of a hot key spread over as
many tasks as it has chunks; only the summaries of a key meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.operators.lookup import shuffled

# rows of one key handled by one window group when the order column counts the rows of the key
CHUNK_ROWS = 1 << 18


@dataclass(frozen=True)
class Running:
    """One output of a scan.

    kind: ``sum`` / ``sum_before`` (running sum with and without the current row),
    ``last`` / ``last_before`` (latest non-null value), ``since`` (running sum of the rows after the
    latest row where ``reset`` holds), ``total_sum`` / ``total_min`` / ``total_max`` (whole key).
    """

    kind: str
    value: Column
    reset: Column | None = None


_TOTALS = {"total_sum": F.sum, "total_min": F.min, "total_max": F.max}


def chunk_of(seq: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of an integer order column."""
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.call_function("div", col.cast("bigint"), F.lit(rows).cast("bigint"))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, Running],
    chunk: Sequence[Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add one column per output, scanned per ``keys`` in ``order`` (which must be total per key).

    ``chunk`` lists columns that are non-decreasing along ``order`` and split a key into groups of
    bounded size; by default the first order column divided by ``chunk_rows``.
    """
    keys, order = list(keys), list(order)
    chunk_cols = list(chunk) if chunk is not None else [chunk_of(order[0], chunk_rows)]
    names = [f"_chunk{i}" for i in range(len(chunk_cols))]
    prepared = {**dict(zip(names, chunk_cols)), **{f"_v_{n}": r.value for n, r in outputs.items()}}
    prepared.update({f"_r_{n}": r.reset for n, r in outputs.items() if r.reset is not None})
    rows = df.withColumns(prepared)

    local = Window.partitionBy(*keys, *names).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    in_chunk, marks = {}, {}
    for n, r in outputs.items():
        v = F.col(f"_v_{n}")
        if r.kind in ("sum", "since"):
            in_chunk[f"_l_{n}"] = F.sum(v).over(upto)
        elif r.kind == "sum_before":
            in_chunk[f"_l_{n}"] = F.sum(v).over(before)
        elif r.kind in ("last", "last_before"):
            in_chunk[f"_l_{n}"] = F.last(v, ignorenulls=True).over(upto if r.kind == "last" else before)
        elif r.kind not in _TOTALS:
            raise ValueError(f"unknown scan kind {r.kind}")
        if r.kind == "since":
            marks[f"_m_{n}"] = F.last(F.when(F.col(f"_r_{n}"), F.col(f"_l_{n}")), ignorenulls=True).over(upto)
    scanned = rows.withColumns(in_chunk) if in_chunk else rows
    if marks:
        scanned = scanned.withColumns(marks)

    # Summaries come from the raw rows, with map-side partial sums; only ``since`` needs the order
    # inside a chunk and so reads the (column-pruned) windowed rows.
    position = F.struct(*[F.col(c) for c in order])
    aggs = []
    for n, r in outputs.items():
        v = F.col(f"_v_{n}")
        if r.kind in ("last", "last_before"):
            latest = F.max(F.when(v.isNotNull(), F.struct(position.alias("at"), v.alias("v"))))
            aggs.append(latest["v"].alias(f"_s_{n}"))
        else:
            aggs.append(_TOTALS.get(r.kind, F.sum)(v).alias(f"_s_{n}"))
        if r.kind == "since":
            aggs.append(F.max(F.struct(position.alias("at"), F.col(f"_m_{n}").alias("v")))["v"].alias(f"_t_{n}"))
    summaries = (scanned if marks else rows).groupBy(*keys, *names).agg(*aggs)

    whole = Window.partitionBy(*keys)
    run = whole.orderBy(*names)
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    through = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = {}
    for n, r in outputs.items():
        if r.kind == "since":
            # key-wide running sum at the latest reset inside the chunk
            bases[f"_b_{n}"] = F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)) + F.col(f"_t_{n}")
    if bases:
        summaries = summaries.withColumns(bases)
    carries = []
    for n, r in outputs.items():
        s = F.col(f"_s_{n}")
        if r.kind in ("sum", "sum_before"):
            c = F.sum(s).over(earlier)
        elif r.kind == "since":
            start = F.last(F.col(f"_b_{n}"), ignorenulls=True).over(earlier)
            c = F.coalesce(F.sum(s).over(earlier), F.lit(0)) - F.coalesce(start, F.lit(0))
        elif r.kind in ("last", "last_before"):
            c = F.last(s, ignorenulls=True).over(earlier)
        else:
            c = _TOTALS[r.kind](s).over(whole)
        carries.append(c.alias(f"_c_{n}"))
    carry = summaries.select(*keys, *names, *carries)

    joined = scanned.join(shuffled(carry), [*keys, *names])
    out = []
    for n, r in outputs.items():
        c, here = F.col(f"_c_{n}"), F.col(f"_l_{n}")
        if r.kind in ("sum", "sum_before"):
            out.append((F.coalesce(here, F.lit(0)) + F.coalesce(c, F.lit(0))).alias(n))
        elif r.kind == "since":
            mark = F.col(f"_m_{n}")
            out.append(F.when(mark.isNotNull(), here - mark).otherwise(here + c).alias(n))
        elif r.kind in ("last", "last_before"):
            out.append(F.coalesce(here, c).alias(n))
        else:
            out.append(c.alias(n))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in outputs], *out)
