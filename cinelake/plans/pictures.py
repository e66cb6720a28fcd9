"""Picture-quality queries: each embedding is an 8x8 picture, the next one its reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.operators import quality as Q
from cinelake.plans.registry import query, table
from cinelake.sources.media import i420_planes

CLIP = 50


def _sample(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x.cast("double") * 200) + 128, F.lit(0)), F.lit(255)).cast("smallint")


def _pictures(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Samples per frame; ``shift`` renumbers the frames."""
    n = F.col("vec_id") - shift
    return table(spark, sf_dir, "embeddings").select(
        F.floor(n / CLIP).cast("string").alias("clip_id"), n.cast("int").alias("frame_no"),
        F.transform("embedding", _sample).alias("a"))


def _planes(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("a", r * 8 + 1, 8))
    return _pictures(spark, sf_dir, shift).select(
        "clip_id", "frame_no", F.lit("Y").alias("plane"), F.posexplode(lines).alias("row", "samples"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.compare_planes(_planes(spark, sf_dir), _planes(spark, sf_dir, 1))


_SAMPLES = """e AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 200) + 128, 0), 255)::INT) AS a
  FROM embeddings),
x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(a) AS v FROM e)"""
_ERRORS = f"""{_SAMPLES},
d AS (SELECT coalesce(g.vec_id, r.vec_id - 1) AS frame, coalesce(g.i, r.i) AS i, g.v - r.v AS d
  FROM x g FULL JOIN x r ON r.vec_id = g.vec_id + 1 AND r.i = g.i),
p AS (SELECT frame, CASE WHEN count(d) = 64 THEN sum(d * d)::BIGINT END AS se,
  CASE WHEN count(d) = 64 THEN max(abs(d))::INT END AS md FROM d GROUP BY frame)"""


@query(f"""WITH {_ERRORS} SELECT floor(frame / {CLIP})::INT::VARCHAR AS clip_id, frame::INT AS frame_no, se AS squared_error,
  md AS max_diff, round(se / 64, 6) AS mse, round(10 * log10(65025.0 / (se / 64)), 6) AS psnr,
  CASE WHEN se IS NULL THEN 'mismatch' ELSE 'ok' END AS status FROM p""")
def plane_error(spark, sf_dir):
    e = Q.plane_error(_compared(spark, sf_dir))
    return e.select("clip_id", "frame_no", "squared_error", "max_diff", F.round("mse", 6).alias("mse"),
                    F.round("psnr", 6).alias("psnr"), "status")


@query(f"""WITH {_ERRORS} SELECT frame::INT AS frame_no, ((i % 8) // 4)::INT AS bx, (i // 32)::INT AS "by",
  sum(d * d)::BIGINT AS squared_error FROM d WHERE d IS NOT NULL GROUP BY ALL HAVING sum(d * d) / 16 > 1500""")
def block_error(spark, sf_dir):
    return Q.block_error(_compared(spark, sf_dir), 4, 1500.0).select("frame_no", "bx", "by", "squared_error")


@query(f"""WITH {_ERRORS}, c AS (SELECT floor(frame / {CLIP})::INT::VARCHAR AS clip_id, frame,
  se IS NULL OR 10 * log10(65025.0 / (se / 64)) < 16.5 AS fails FROM p)
SELECT clip_id, (max(frame) - min(frame) + 1)::INT AS frames, min(CASE WHEN fails THEN frame END)::INT AS first_failure,
  (coalesce(min(CASE WHEN fails THEN frame END), max(frame) + 1) - min(frame))::INT AS exact_run FROM c GROUP BY clip_id""")
def bit_exact_run(spark, sf_dir):
    return Q.bit_exact_run(Q.plane_error(_compared(spark, sf_dir)), 16.5)


@query(f"""WITH {_SAMPLES} SELECT vec_id::INT AS frame_no, ((i % 8) // 4)::INT AS bx, (i // 32)::INT AS "by",
  round(sum(v) / 16, 6) AS mean, round((16 * sum(v * v) - sum(v) * sum(v)) / 256, 6) AS variance,
  (16 * sum(v * v) - sum(v) * sum(v)) / 256 > 700 AS coded FROM x GROUP BY ALL""")
def block_stats(spark, sf_dir):
    s = Q.block_stats(_planes(spark, sf_dir), 4, 700.0)
    return s.select("frame_no", "bx", "by", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "coded")


@query(f"""WITH {_SAMPLES}, s AS (SELECT g.vec_id, sum(abs(g.v - r.v)) AS sad FROM x g JOIN x r
  ON r.vec_id = g.vec_id + 1 AND r.i = g.i GROUP BY g.vec_id)
SELECT vec_id // 6 AS mbx, sum(CASE WHEN sad > CASE WHEN vec_id % 6 < 4 THEN 1800 ELSE 1700 END
  THEN 1 << (5 - vec_id % 6)::INT ELSE 0 END)::INT AS cbp, count(*) AS blocks FROM s GROUP BY ALL""")
def coded_pattern(spark, sf_dir):
    got = _pictures(spark, sf_dir)
    ref = _pictures(spark, sf_dir, 1).select("frame_no", F.col("a").alias("ref_samples"))
    blocks = got.join(ref, "frame_no").select(
        F.floor(F.col("frame_no") / 6).alias("mbx"), (F.col("frame_no") % 6).alias("blk"), F.col("a").alias("samples"),
        "ref_samples")
    return Q.coded_pattern(blocks, ["mbx"], 1800, 1700)


@query(f"""WITH {_SAMPLES}, k AS (SELECT vec_id, v, i, CASE WHEN i < 40 THEN 'Y' WHEN i < 52 THEN 'Cb' ELSE 'Cr' END AS plane FROM x)
SELECT vec_id::VARCHAR AS clip_id, 0 AS frame_no, plane,
  (CASE WHEN i < 40 THEN i // 5 WHEN i < 52 THEN (i - 40) // 3 ELSE (i - 52) // 3 END)::INT AS "row",
  string_agg(v::VARCHAR, ',' ORDER BY i) AS samples FROM k GROUP BY ALL""")
def raw_planes(spark, sf_dir):
    """The 64 bytes are one picture of 5x8; every fifth file goes on with part of another."""
    byte = lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")
    whole, part = F.transform("a", byte), F.transform(F.slice("a", 1, 50), byte)
    raw = F.unhex(F.array_join(F.when(F.col("frame_no") % 5 == 4, F.concat(whole, part)).otherwise(whole), ""))
    files = _pictures(spark, sf_dir).select(F.col("frame_no").alias("file_id"), raw.alias("content"))
    samples = F.array_join(F.transform("samples", lambda v: v.cast("string")), ",")
    return i420_planes(files, 5, 8).withColumn("samples", samples)


@query("""WITH g AS (SELECT l_orderkey AS clip, count(*) AS n, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem GROUP BY ALL)
SELECT CASE WHEN n IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unexpected' WHEN n <> 4 THEN 'frame_count'
  WHEN lo <> 'N' OR hi <> 'N' THEN 'dimensions' ELSE 'ok' END AS verdict, count(*) AS clips
FROM g FULL JOIN orders ON o_orderkey = clip GROUP BY ALL""")
def clip_checks(spark, sf_dir):
    width = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    frames = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("clip_id"), width.alias("width"), F.lit(8).alias("height"))
    want = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("clip_id"), F.lit(4).alias("frames"), F.lit(2).alias("width"), F.lit(8).alias("height"))
    return Q.check_clips(frames, want).groupBy("verdict").agg(F.count(F.lit(1)).alias("clips"))
