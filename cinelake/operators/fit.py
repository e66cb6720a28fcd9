"""Fitting formulas to observations: grid neighbours, scores, least squares, steps, ranks, runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinelake.operators.ranking import positions
from cinelake.operators.scan import Running, chunk_of, ordered_scan
from cinelake.session import saved

CELL = ["frame_id", "gx", "gy"]

# neighbour name -> where the neighbour lies, relative to the cell
NEIGHBOURS = {"left": (-1, 0), "topleft": (-1, -1), "top": (0, -1), "topright": (1, -1)}


def with_neighbours(cells: DataFrame, default: Column | int | None = 0, value: str = "value") -> DataFrame:
    """Add left, topleft, top and topright values; outside the grid they are ``default``.

    Every cell sends its value to the four cells that look at it, and one aggregate per cell position
    collects them: a single shuffle with at most five rows per key, instead of four self-joins.
    """
    rest = [c for c in cells.columns if c not in CELL]
    own_type = F.struct(*rest)
    outgoing = [
        F.struct(F.lit(name).alias("role"), F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"))
        for name, (dx, dy) in NEIGHBOURS.items()
    ]
    here = F.struct(F.lit("self").alias("role"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    sent = cells.withColumn("_to", F.explode(F.array(here, *outgoing))).select(
        "frame_id",
        (F.col("gx") + F.col("_to.dx")).alias("gx"),
        (F.col("gy") + F.col("_to.dy")).alias("gy"),
        F.col("_to.role").alias("_role"),
        F.when(F.col("_to.role") == "self", own_type).alias("_own"),
        F.col(value).alias("_value"),
    )
    edge = F.lit(default) if not isinstance(default, Column) else default
    seen = [F.max(F.when(F.col("_role") == name, F.col("_value"))).alias(name) for name in NEIGHBOURS]
    grouped = sent.groupBy(*CELL).agg(F.max("_own").alias("_own"), *seen).filter(F.col("_own").isNotNull())
    return grouped.select(
        *CELL, *[F.col(f"_own.{c}").alias(c) for c in rest], *[F.coalesce(F.col(n), edge).alias(n) for n in NEIGHBOURS]
    )


def score(
    points: DataFrame, target: Column, formulas: dict[str, Column], tol: float = 0, by: Sequence[str] = ()
) -> DataFrame:
    """How often each named formula is within ``tol`` of the target, all in one scan of the points.

    The formulas are aggregated side by side and only the finished sums are turned into rows.
    """
    names = list(formulas)
    sums = [
        F.sum(F.coalesce((F.abs(formulas[n] - target) <= tol).cast("bigint"), F.lit(0))).alias(f"_m{i}")
        for i, n in enumerate(names)
    ]
    totals = points.filter(target.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("points"), *sums)
    pairs = F.array(*[
        F.struct(F.lit(n).alias("formula"), F.col(f"_m{i}").alias("matches")) for i, n in enumerate(names)
    ])
    return totals.select(*by, "points", F.explode(pairs).alias("f")).select(
        *by, F.col("f.formula").alias("formula"), "points", F.coalesce("f.matches", F.lit(0)).alias("matches"),
        (F.col("f.matches") / F.col("points")).alias("rate"),
    )


def ols(points: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Least squares ``y ~ xs + intercept`` per group: coef_<x>, intercept, resid_std, n.

    Spark reduces each group to its means and covariances; only that one row per group is solved in
    Python. Groups with fewer points than unknowns are skipped; a singular system gives nulls.
    """
    xs, by = list(xs), list(by)
    value = {c: F.col(c).cast("double") for c in [*xs, y]}
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(value[y]).alias("my"), F.var_pop(value[y]).alias("vy")]
    aggs += [F.avg(value[x]).alias(f"m{i}") for i, x in enumerate(xs)]
    aggs += [F.covar_pop(value[x], value[y]).alias(f"y{i}") for i, x in enumerate(xs)]
    aggs += [
        F.covar_pop(value[xs[i]], value[xs[j]]).alias(f"c{i}_{j}") for i in range(len(xs)) for j in range(i + 1)
    ]
    complete = points.dropna(subset=[*xs, y])
    sums = complete.groupBy(*by).agg(*aggs).filter(F.col("n") >= len(xs) + 1)
    coefs = [f"coef_{x}" for x in xs]
    schema = StructType([sums.schema[c] for c in by]).add("n", "long")
    for c in [*coefs, "intercept", "resid_std"]:
        schema = schema.add(c, "double")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(xs)
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                cov = np.array([[getattr(r, f"c{max(i, j)}_{min(i, j)}") for j in range(k)] for i in range(k)])
                rhs = np.array([getattr(r, f"y{i}") for i in range(k)])
                fit = [None] * (k + 2)
                if k and np.linalg.cond(cov) < 1e12:
                    coef = np.linalg.solve(cov, rhs)
                    means = np.array([getattr(r, f"m{i}") for i in range(k)])
                    fit = [*coef, r.my - coef @ means, max(r.vy - coef @ rhs, 0.0) ** 0.5]
                out.append([*[getattr(r, c) for c in by], r.n, *fit])
            yield pd.DataFrame(out, columns=schema.names)

    return sums.mapInPandas(solve, schema)


def step_scale(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quantiser scale behind a set of values: ``round(8 * (max - min) / (distinct - 1))``.

    Values are rounded to integers first (halves to even); fewer than two distinct values give null.
    """
    rounded = F.rint(F.col(value).cast("double"))
    distinct = df.select(*by, rounded.alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    stats = distinct.groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct_values"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    n = F.col("distinct_values")
    step = F.when(n >= 2, F.rint(8.0 * (F.col("hi") - F.col("lo")) / (n - 1)).cast("bigint"))
    return stats.select(*by, "distinct_values", step.alias("scale"))


def is_permutation(
    df: DataFrame, position: str, by: Sequence[str] = (), offsets: Sequence[int] = (1, 2, 0)
) -> DataFrame:
    """Try offsets in order: an offset is clean when position + offset names each place once and
    leaves place 0 free. One row per group and offset; ``chosen`` marks the first clean one.

    Positions are counted once; the offsets are expanded on the one summary row per group.
    """
    p = F.col(position)
    per = df.filter(p.isNotNull()).groupBy(*by, position).agg(F.count(F.lit(1)).alias("n"))
    taken = [F.max(F.when(p == -o, 1).otherwise(0)).alias(f"_t{i}") for i, o in enumerate(offsets)]
    stats = per.groupBy(*by).agg(
        F.sum("n").alias("positions"), F.count(F.lit(1)).alias("distinct_positions"),
        F.min(position).alias("lo"), F.max(position).alias("hi"), *taken,
    )
    unique = F.col("positions") == F.col("distinct_positions")
    tries = F.array(*[
        F.struct(F.lit(i).alias("try"), F.lit(o).alias("offset"), (unique & (F.col(f"_t{i}") == 0)).alias("clean"))
        for i, o in enumerate(offsets)
    ])
    first = F.array_min(F.transform(F.filter(tries, lambda t: t["clean"]), lambda t: t["try"]))
    rows = stats.select(
        *by, "positions", "distinct_positions", "lo", "hi", first.alias("_first"), F.explode(tries).alias("t"))
    contiguous = F.col("hi") - F.col("lo") + 1 == F.col("distinct_positions")
    return rows.select(
        *by, F.col("t.offset").alias("offset"), "positions", "distinct_positions", F.col("t.clean").alias("clean"),
        (F.col("t.clean") & contiguous & (F.col("lo") + F.col("t.offset") == 1)).alias("complete"),
        F.coalesce(F.col("t.try") == F.col("_first"), F.lit(False)).alias("chosen"),
    )


def sweep(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Every combination of the axes' values, computed from a row number rather than by cross joins."""
    total = 1
    for values in axes.values():
        total *= len(values)
    columns, below = [], total
    for name, values in axes.items():
        below //= len(values)
        at = (F.floor(F.col("id") / below) % len(values)).cast("int")
        columns.append(F.get(F.array(*[F.lit(v) for v in values]), at).alias(name))
    return spark.range(total).select(*columns)


def coverage(obs: DataFrame, swept: DataFrame) -> DataFrame:
    """Combinations of the sweep that no observation covers."""
    on = swept.columns
    return swept.join(obs.select(*on).distinct(), on, "left_anti")


def running_level(
    cells: DataFrame,
    order: Sequence[str] = ("mx", "blk"),
    keys: Sequence[str] = ("frame_id", "row", "component"),
    start: int = 128,
    chunk_cells: int = 1 << 16,
) -> DataFrame:
    """Level of each block: ``start`` plus the differences so far in its row and component."""
    run = {"_sum": Running("sum", F.col("diff").cast("bigint"))}
    scanned = ordered_scan(cells, keys, order, run, chunk=[chunk_of(order[0], chunk_cells)])
    return scanned.withColumn("level", F.col("_sum") + start).drop("_sum")


def rank_label(obs: DataFrame, zero: float) -> DataFrame:
    """Label each code by the rank of its mean value, counted from the code that produced ``zero``.

    Observations are averaged per code first, so the ranking sees one row per code. Equal means rank
    by code; of several codes that produced ``zero`` the lowest ranked counts. All tables are ranked in one
    order cut into ranges, so a table may be as large as it likes; only one row per table is joined back.
    """
    v = F.col("value").cast("double")
    means = saved(obs.groupBy("table_id", "code").agg(
        F.avg(v).alias("mean"), F.coalesce(F.max(v == F.lit(float(zero))), F.lit(False)).alias("_zero")), "means")
    placed = positions(means, ["table_id", "mean", "code"], "_at")
    first = placed.groupBy("table_id").agg(F.min("_at").alias("_first"), F.min(F.when(F.col("_zero"), F.col("_at"))).alias("_zero_at"))
    first = first.withColumnRenamed("table_id", "_table")
    same = F.col("table_id").eqNullSafe(F.col("_table"))
    return placed.join(first, same).select(
        "table_id", "code", "mean", (F.col("_at") - F.col("_first") + 1).cast("int").alias("rank"),
        (F.col("_at") - F.col("_zero_at")).cast("int").alias("label"))


def expand_runs(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int = 64,
    scan: Sequence[int] | None = None,
    start: int = 0,
) -> DataFrame:
    """Dense arrays from (run, value) events: each event skips ``run`` places, then fills one.

    Places of ``n`` and beyond are dropped; ``scan`` says which array index a place means, ``start``
    the first place (1 when the array's head is coded apart). The k-th event lies at place k or later,
    so only the first ``n`` events of a block can count: Spark cuts each task's groups to them before
    the shuffle, and no block brings more than ``n`` rows together.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    head = events.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    place = F.sum(F.col("run") + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1 + start
    placed = head.withColumn("_place", place.cast("int")).filter(F.col("_place") < n)
    pairs = placed.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_place", "value"))).alias("_m"), F.count(F.lit(1)).alias("placed")
    )
    place_of = list(range(n))
    for p, index in enumerate(scan or []):
        place_of[index] = p
    order_of = F.array(*[F.lit(p) for p in place_of])
    dense = F.transform(order_of, lambda p: F.coalesce(F.try_element_at(F.col("_m"), p), F.lit(0)))
    return pairs.select(*keys, "placed", dense.alias("values"))
