"""Fitting queries: every embedding is a frame of 8 x 8 cells, line items are runs and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import predictors as P
from cinelake.operators import fit
from cinelake.plans.registry import query, table

SIDE = 8


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("k", "x"))
    return cells.select(
        "frame_id", (F.col("k") % SIDE).cast("int").alias("gx"), F.floor(F.col("k") / SIDE).cast("int").alias("gy"),
        F.floor(F.col("x").cast("double") * 1000).cast("int").alias("value"))


_CELLS = f"""e AS (SELECT vec_id AS frame_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
c AS (SELECT frame_id, (k % {SIDE})::INT AS gx, (k // {SIDE})::INT AS gy, floor(x::DOUBLE * 1000)::INT AS value FROM e),
n AS (SELECT c.*, coalesce(l.value, 0) AS "left", coalesce(d.value, 0) AS topleft, coalesce(t.value, 0) AS top,
  coalesce(r.value, 0) AS topright FROM c
  LEFT JOIN c l ON l.frame_id = c.frame_id AND l.gx = c.gx - 1 AND l.gy = c.gy
  LEFT JOIN c d ON d.frame_id = c.frame_id AND d.gx = c.gx - 1 AND d.gy = c.gy - 1
  LEFT JOIN c t ON t.frame_id = c.frame_id AND t.gx = c.gx AND t.gy = c.gy - 1
  LEFT JOIN c r ON r.frame_id = c.frame_id AND r.gx = c.gx + 1 AND r.gy = c.gy - 1)"""


@query(f'WITH {_CELLS} SELECT frame_id, gx, gy, value, "left", topleft, top, topright FROM n')
def grid_neighbours(spark, sf_dir):
    return fit.with_neighbours(_cells(spark, sf_dir))


@query(f"""WITH {_CELLS}, g AS (SELECT *, abs("left" - topleft) > abs(topleft - top) AS fl FROM n),
p AS (SELECT *, CASE WHEN fl THEN "left" ELSE top END AS f1,
  floor((CASE WHEN fl THEN "left" ELSE top END + topleft) / 2.0) AS f2, "left" + top - topleft AS f3 FROM g)
SELECT fl AS from_left, unnest(['select', 'average', 'planar']) AS formula, count(*) AS points,
  unnest([sum((abs(f1 - value) <= 60)::INT)::BIGINT, sum((abs(f2 - value) <= 60)::INT)::BIGINT,
    sum((abs(f3 - value) <= 60)::INT)::BIGINT]) AS matches FROM p GROUP BY fl""")
def predictor_scores(spark, sf_dir):
    cells = fit.with_neighbours(_cells(spark, sf_dir))
    g = P.gradient_pred(F.col("left"), F.col("topleft"), F.col("top"))
    points = cells.withColumn("g", g).select("*", F.col("g.from_left").alias("from_left"), F.col("g.pred").alias("pred"))
    formulas = {
        "select": F.col("pred"),
        "average": F.floor((F.col("pred") + F.col("topleft")) / 2),
        "planar": F.col("left") + F.col("top") - F.col("topleft"),
    }
    return fit.score(points, F.col("value"), formulas, 60, ["from_left"]).drop("rate")


# Normal equations on centred sums, solved by Cramer's rule.
@query(f"""WITH {_CELLS}, g AS (SELECT *, abs("left" - topleft) > abs(topleft - top) AS fl FROM n),
s AS (SELECT fl, count(*) AS n, avg(value) AS my, avg("left") AS m1, avg(top) AS m2, avg(topleft) AS m3,
  var_pop(value) AS vy, var_pop("left") AS a, covar_pop("left", top) AS b, covar_pop("left", topleft) AS c,
  var_pop(top) AS d, covar_pop(top, topleft) AS e, var_pop(topleft) AS f,
  covar_pop("left", value) AS y1, covar_pop(top, value) AS y2, covar_pop(topleft, value) AS y3 FROM g GROUP BY fl),
k AS (SELECT *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) AS det FROM s),
x AS (SELECT *, (y1*(d*f-e*e) - b*(y2*f-e*y3) + c*(y2*e-d*y3)) / det AS c1,
  (a*(y2*f-e*y3) - y1*(b*f-c*e) + c*(b*y3-y2*c)) / det AS c2,
  (a*(d*y3-e*y2) - b*(b*y3-c*y2) + y1*(b*e-c*d)) / det AS c3 FROM k)
SELECT fl AS from_left, n, round(c1, 6) AS coef_left, round(c2, 6) AS coef_top, round(c3, 6) AS coef_topleft,
  round(my - c1*m1 - c2*m2 - c3*m3, 6) AS intercept, round(sqrt(vy - c1*y1 - c2*y2 - c3*y3), 6) AS resid_std FROM x""")
def ols_fit(spark, sf_dir):
    cells = fit.with_neighbours(_cells(spark, sf_dir))
    g = P.gradient_pred(F.col("left"), F.col("topleft"), F.col("top"))
    fitted = fit.ols(cells.withColumn("from_left", g["from_left"]), "value", ["left", "top", "topleft"], ["from_left"])
    numbers = ["coef_left", "coef_top", "coef_topleft", "intercept", "resid_std"]
    return fitted.select("from_left", "n", *[F.round(c, 6).alias(c) for c in numbers])


@query(f"""WITH {_CELLS}, m AS (SELECT *, CASE WHEN gy = 0 THEN "left" ELSE list_sort(["left", top, topright])[2] END AS pred FROM n)
SELECT frame_id, gx, gy, pred, CASE WHEN pred <= -64 THEN pred + 64 WHEN pred >= 64 THEN pred - 64 ELSE pred END AS wrapped,
  CASE WHEN abs("left" - topleft) >= abs(topleft - top) THEN "left" ELSE top END AS tie_left,
  (("left" > 0)::INT) AS coded_left, xor((value > 0)::INT, CASE WHEN (top > 0) <> (topleft > 0) THEN (top > 0)::INT ELSE ("left" > 0)::INT END) AS flag
FROM m""")
def vector_prediction(spark, sf_dir):
    n = fit.with_neighbours(_cells(spark, sf_dir))
    pred = P.mv_pred(F.col("left"), F.col("top"), F.col("topright"), F.col("gy"))
    on = {c: (F.col(c) > 0).cast("int") for c in ("value", "left", "topleft", "top")}
    return n.select(
        "frame_id", "gx", "gy", pred.alias("pred"), P.wrap_mv(pred).alias("wrapped"),
        P.gradient_pred(F.col("left"), F.col("topleft"), F.col("top"), "left")["pred"].alias("tie_left"),
        on["left"].alias("coded_left"),
        P.coded_flag(on["value"], on["left"], on["topleft"], on["top"]).alias("flag"))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_BY = ", ".join(_ORDER)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(128 + sum(l_quantity::INT - 25) OVER (
  PARTITION BY l_orderkey ORDER BY {_BY} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS level FROM lineitem""")
def running_level(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER, (F.col("l_quantity").cast("int") - 25).alias("diff"))
    levels = fit.running_level(cells, _ORDER, ["l_orderkey"])
    return levels.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "level")


@query(f"""WITH p AS (SELECT l_orderkey, l_quantity::INT AS value, sum(l_suppkey % 4 + 1) OVER (
  PARTITION BY l_orderkey ORDER BY {_BY} ROWS UNBOUNDED PRECEDING) - 1 AS place FROM lineitem),
k AS (SELECT * FROM p WHERE place < 16), o AS (SELECT l_orderkey, count(*) AS placed FROM k GROUP BY ALL)
SELECT o.l_orderkey, o.placed, string_agg(coalesce(k.value, 0)::VARCHAR, ',' ORDER BY i) AS vals
FROM o, range(0, 16) r(i) LEFT JOIN k ON k.l_orderkey = o.l_orderkey AND k.place = i GROUP BY ALL""")
def expand_runs(spark, sf_dir):
    events = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *_ORDER, (F.col("l_suppkey") % 4).alias("run"), F.col("l_quantity").cast("int").alias("value"))
    dense = fit.expand_runs(events, ["l_orderkey"], _ORDER, n=16)
    vals = F.array_join(F.transform("values", lambda v: v.cast("string")), ",")
    return dense.select("l_orderkey", "placed", vals.alias("vals"))


@query("""WITH m AS (SELECT p_brand AS table_id, p_type || p_name AS code, avg(p_size) AS mean, bool_or(p_size = 25) AS z
  FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY mean, code) AS rank FROM m)
SELECT table_id, code, round(mean, 6) AS mean, rank::INT AS rank,
  (rank - min(CASE WHEN z THEN rank END) OVER (PARTITION BY table_id))::INT AS label FROM r""")
def rank_labels(spark, sf_dir):
    obs = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("table_id"), F.concat("p_type", "p_name").alias("code"), F.col("p_size").alias("value"))
    return fit.rank_label(obs, 25).withColumn("mean", F.round("mean", 6))


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_returnflag, round_even(l_extendedprice / 1000, 0) AS v FROM lineitem)
SELECT l_suppkey, l_returnflag, count(*) AS distinct_values,
  CASE WHEN count(*) >= 2 THEN round_even(8.0::DOUBLE * (max(v) - min(v)) / (count(*) - 1), 0)::BIGINT END AS scale
FROM d GROUP BY ALL""")
def step_scale(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") / 1000)
    return fit.step_scale(items, "v", ["l_suppkey", "l_returnflag"])


@query("""WITH s AS (SELECT l_orderkey, count(*) AS positions, count(DISTINCT l_linenumber) AS distinct_positions,
  min(l_linenumber) AS lo, max(l_linenumber) AS hi, bool_or(l_linenumber = 0) AS zero FROM lineitem GROUP BY ALL),
t AS (SELECT *, unnest([1, 2, 0]) AS "offset", unnest([1, 2, 3]) AS k FROM s),
c AS (SELECT *, positions = distinct_positions AND NOT ("offset" = 0 AND zero) AS clean FROM t)
SELECT l_orderkey, "offset", positions, distinct_positions, clean,
  clean AND hi - lo + 1 = distinct_positions AND lo + "offset" = 1 AS complete,
  clean AND k = min(CASE WHEN clean THEN k END) OVER (PARTITION BY l_orderkey) AS chosen FROM c""")
def permutation_check(spark, sf_dir):
    return fit.is_permutation(table(spark, sf_dir, "lineitem"), "l_linenumber", ["l_orderkey"])


@query("""SELECT q::INT AS q, d::INT AS d, t::INT AS t, n::INT AS n FROM range(1, 51) a(q), range(0, 11) b(d), range(0, 9) c(t),
  range(1, 8) e(n) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity::INT = q AND round(l_discount * 100)::INT = d
  AND round(l_tax * 100)::INT = t AND l_linenumber = n)""")
def sweep_coverage(spark, sf_dir):
    swept = fit.sweep(spark, q=list(range(1, 51)), d=list(range(11)), t=list(range(9)), n=list(range(1, 8)))
    obs = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"),
        F.round(F.col("l_tax") * 100).cast("int").alias("t"), F.col("l_linenumber").alias("n"))
    return fit.coverage(obs, swept)


@query("""WITH q AS (SELECT least(l_quantity::INT, 31) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT q, CASE WHEN q <= 4 THEN 8 WHEN q <= 8 THEN 2 * q WHEN q <= 24 THEN q + 8 ELSE 2 * q - 16 END AS luma,
  CASE WHEN q <= 4 THEN 8 WHEN q <= 24 THEN ((q + 13) // 2)::INT ELSE q - 6 END AS chroma,
  (8 + greatest(q - 4, 0) // 2)::INT AS wmv1_luma, (8 + greatest(q - 3, 0) // 2)::INT AS wmv1_chroma,
  ((2048 + 8 + greatest(q - 4, 0) // 2) // (2 * (8 + greatest(q - 4, 0) // 2)))::INT AS start, n FROM q""")
def dc_scaler(spark, sf_dir):
    q = F.col("q")
    seen = table(spark, sf_dir, "lineitem").groupBy(F.least(F.col("l_quantity").cast("int"), F.lit(31)).alias("q")).agg(
        F.count(F.lit(1)).alias("n"))
    wmv1 = P.dc_scaler(q, "luma", "wmv1")
    return seen.select(
        "q", P.dc_scaler(q).alias("luma"), P.dc_scaler(q, "chroma").alias("chroma"), wmv1.alias("wmv1_luma"),
        P.dc_scaler(q, "chroma", "wmv1").alias("wmv1_chroma"), P.default_predictor(wmv1).alias("start"), "n")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)::INT) AS a FROM embeddings)
SELECT vec_id, array_to_string(list_transform([{zig}], lambda i: a[i + 1]), ',') AS zigzag,
  array_to_string(list_transform([{alt}], lambda i: a[i + 1]), ',') AS alternate FROM e""".format(
    zig=", ".join(map(str, P.SCAN_ORDERS["zigzag"])), alt=", ".join(map(str, P.SCAN_ORDERS["wmv1_inter"]))))
def array_reorder(spark, sf_dir):
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", ints.alias("a"))

    def text(name: str):
        return F.array_join(F.transform(P.reorder(F.col("a"), P.SCAN_ORDERS[name]), lambda v: v.cast("string")), ",")

    return rows.select("vec_id", text("zigzag").alias("zigzag"), text("wmv1_inter").alias("alternate"))
