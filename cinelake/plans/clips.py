"""Packet queries on ``events``: a clip is a user, a packet an event, a sign-up an I frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import codecs as C
from cinelake.operators import frames as FR
from cinelake.plans.registry import query, table
from cinelake.session import saved, shared_dir
from cinelake.sources.tables import write_table

# event ids count all clips together, so a clip's chunk spans many ids
SPAN = 1 << 22

FOURCCS = ["DIV3", "mp43", " MP42 ", "MPG4", "wmv1", "WMV2", "XVID", "3ivd"]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    intra = F.col("event_type") == "signup"
    bad = (F.col("event_type") == "error") | (F.col("value") < 2.0)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("seq"),
        F.when(intra, "I").otherwise("P").alias("frame_type"),
        F.when(bad, "bad_qscale").otherwise("ok").alias("status"),
        F.when(intra & (F.col("value") >= 5.0), (F.floor("value") * 1024).cast("int")).alias("bit_rate"),
        (F.floor(F.col("value") * 100) + 1).cast("int").alias("size"),
    )


_PACKETS = """f AS (SELECT user_id AS file_id, event_id AS seq, ts, event_type = 'signup' AS i,
  NOT (event_type = 'error' OR value < 2.0) AS ok,
  CASE WHEN event_type = 'signup' AND value >= 5.0 THEN CAST(floor(value) * 1024 AS INTEGER) END AS rate,
  CAST(floor(value * 100) + 1 AS INTEGER) AS size FROM events)"""

_TRACKED = _PACKETS + """,
g AS (SELECT *, sum(i::INT) OVER w AS gop, sum((i AND ok)::INT) OVER b AS oki,
  last_value(CASE WHEN ok THEN seq END IGNORE NULLS) OVER b AS okseq
  FROM f WINDOW w AS (PARTITION BY file_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING),
  b AS (PARTITION BY file_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {_TRACKED},
h AS (SELECT file_id, gop, count(*) AS n, sum((NOT i)::INT) AS p,
  sum((NOT i AND coalesce(oki, 0) = 0)::INT) AS o FROM g GROUP BY file_id, gop)
SELECT file_id, CAST(sum(n) AS BIGINT) AS frames, CAST(max(gop) AS BIGINT) AS gops,
  CAST(max(CASE WHEN gop > 0 THEN p ELSE 0 END) AS BIGINT) AS longest_p_run,
  CAST(sum(o) AS BIGINT) AS no_reference FROM h GROUP BY file_id""")
def gop_profile(spark, sf_dir):
    return FR.gop_profile(packets(spark, sf_dir), SPAN)


@query(f"""WITH {_TRACKED},
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, gop ORDER BY ts, seq) - 1 AS k FROM g)
SELECT file_id, seq, CAST(gop AS BIGINT) AS gop_id, CASE WHEN gop > 0 THEN k END AS p_index,
  CASE WHEN gop > 0 THEN k % 2 = 0 END AS no_rounding,
  CASE WHEN NOT i AND coalesce(oki, 0) > 0 THEN okseq END AS ref_seq,
  CASE WHEN NOT i AND coalesce(oki, 0) = 0 THEN 'no_reference' WHEN ok THEN 'ok' ELSE 'bad_qscale' END AS status
FROM r""")
def gop_frames(spark, sf_dir):
    tracked = FR.track(packets(spark, sf_dir), SPAN)
    return tracked.select("file_id", "seq", "gop_id", "p_index", "no_rounding", "ref_seq", "status")


@query(f"""WITH {_PACKETS} SELECT file_id, seq, last_value(rate IGNORE NULLS) OVER (
  PARTITION BY file_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS bit_rate FROM f""")
def carry_forward(spark, sf_dir):
    return FR.carry_bit_rate(packets(spark, sf_dir), SPAN).select("file_id", "seq", "bit_rate")


_OFFSETS = _PACKETS + """,
o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY file_id ORDER BY ts, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM f)"""


@query(f"WITH {_OFFSETS} SELECT file_id, seq, byte_offset FROM o")
def byte_offsets(spark, sf_dir):
    return FR.offsets(packets(spark, sf_dir), chunk_rows=SPAN).select("file_id", "seq", "byte_offset")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries with key flags on sign-ups and views, only the former being intra."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("entry_no"),
        F.when(kind == "click", "01wb").otherwise("00dc").alias("chunk_id"),
        F.when(kind.isin("signup", "view"), 16).otherwise(0).alias("flags"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size"),
        (F.col("event_id") * 1000).alias("byte_offset"),
        F.when(kind == "signup", "I").otherwise("P").alias("frame_type"),
    )


@query("""WITH k AS (SELECT user_id AS file_id, event_id AS entry_no, event_type = 'signup' AS intra,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r,
  count(*) OVER (PARTITION BY user_id) AS n FROM events
  WHERE event_type IN ('signup', 'view') AND CAST(floor(value * 100) AS BIGINT) >= 1),
t AS (SELECT *, greatest(0, least(n - 1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT))) AS want FROM k),
p AS (SELECT file_id, max(n) AS key_count, max(CASE WHEN r = 0 THEN entry_no END) AS fe,
  bool_or(r = 0 AND intra) AS fi, max(CASE WHEN r = want THEN entry_no END) AS te,
  bool_or(r = want AND intra) AS ti FROM t GROUP BY file_id)
SELECT file_id, key_count, fe AS first_entry, fe * 1000 AS first_offset, CASE WHEN ti THEN te ELSE fe END AS entry_no,
  CASE WHEN ti THEN te ELSE fe END * 1000 AS byte_offset FROM p WHERE fi""")
def keyframe_at_fraction(spark, sf_dir):
    return FR.keyframe_at(_index(spark, sf_dir), 0.10, SPAN)


_WALK = _OFFSETS + """,
b AS (SELECT file_id, min(byte_offset) AS lo, max(byte_offset + 8 + size) AS hi FROM o GROUP BY file_id),
w AS (SELECT o.file_id, min_by(seq, byte_offset) AS seq, min(byte_offset) AS byte_offset FROM o JOIN b USING (file_id)
  WHERE i AND size > 0 AND byte_offset >= lo + CAST(floor((hi - lo) * 0.1::DOUBLE) AS BIGINT) GROUP BY o.file_id)"""


@query(f"WITH {_WALK} SELECT * FROM w")
def keyframe_from(spark, sf_dir):
    walked = saved(FR.offsets(packets(spark, sf_dir), chunk_rows=SPAN), "packets")
    return FR.keyframe_from(walked, 0.10, chunk_rows=SPAN)


@query(f"""WITH {_WALK},
s AS (SELECT file_id, min(byte_offset) AS byte_offset FROM o WHERE i AND size > 0 GROUP BY file_id),
k AS (SELECT o.*, row_number() OVER (PARTITION BY file_id ORDER BY seq) - 1 AS r,
  count(*) OVER (PARTITION BY file_id) AS n FROM o WHERE i OR (ok AND size > 4000)),
x AS (SELECT file_id, max(CASE WHEN r = 0 AND i THEN byte_offset END) AS first,
  max(CASE WHEN r = greatest(0, least(n - 1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT))) AND i THEN byte_offset END) AS target
  FROM k GROUP BY file_id),
f2 AS (SELECT file_id, coalesce(target, first) AS byte_offset, 1 AS rk, 'index' AS rule FROM x WHERE first IS NOT NULL
  UNION ALL SELECT file_id, byte_offset, 2, 'fraction' FROM w UNION ALL SELECT file_id, byte_offset, 3, 'first' FROM s)
SELECT file_id, min_by(byte_offset, rk) AS byte_offset, min_by(rule, rk) AS rule FROM f2 GROUP BY file_id""")
def thumbnail_pick(spark, sf_dir):
    # several rules look at the packet table, so its running offsets are written once
    walked = saved(FR.offsets(packets(spark, sf_dir), chunk_rows=SPAN), "packets")
    flagged = (F.col("frame_type") == "I") | ((F.col("status") == "ok") & (F.col("size") > 4000))
    index = walked.filter(flagged).select(
        "file_id", F.col("seq").alias("entry_no"), F.lit("00dc").alias("chunk_id"), F.lit(16).alias("flags"),
        "size", "byte_offset")
    return FR.thumbnail_packet(walked, index, 0.10, chunk_rows=SPAN)


@query("""SELECT user_id AS file_id, event_id AS seq FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3""")
def head_per_clip(spark, sf_dir):
    return FR.head_per_file(packets(spark, sf_dir), 3).select("file_id", "seq")


@query(f"""WITH {_PACKETS} SELECT CASE WHEN i THEN 'I' ELSE 'P' END AS frame_type,
  CASE WHEN ok THEN 'ok' ELSE 'bad_qscale' END AS status, count(*) AS frames FROM f GROUP BY ALL""")
def config_histogram(spark, sf_dir):
    return FR.config_histogram(packets(spark, sf_dir), "frame_type", "status")


def _fourcc(key: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in FOURCCS]), (key % len(FOURCCS)).cast("int"))


_VERSION = """CASE upper(trim([{list}][user_id % 8 + 1])) WHEN 'DIV3' THEN 'v3' WHEN 'MP43' THEN 'v3' WHEN 'MP42' THEN 'v2'
  WHEN 'MPG4' THEN 'v1' WHEN 'WMV1' THEN 'wmv1' WHEN 'WMV2' THEN 'wmv2' WHEN '3IVD' THEN 'v3' END""".format(
    list=", ".join(f"'{c}'" for c in FOURCCS))


@query(f"SELECT {_VERSION} AS version, count(*) AS packets FROM events GROUP BY ALL")
def fourcc_lookup(spark, sf_dir):
    p = packets(spark, sf_dir)
    streams = p.select("file_id").distinct().select(
        "file_id", _fourcc(F.col("file_id")).alias("fourcc"), F.lit(96).alias("width"), F.lit(64).alias("height"),
        F.lit(None).cast("binary").alias("extradata"))
    return FR.with_codec(p.select("file_id", "seq"), streams).groupBy("version").agg(F.count(F.lit(1)).alias("packets"))


def coded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose first bytes are a hash, so that every header layout meets every bit pattern."""
    head = F.unhex(F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.col("event_type"))))
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("file_id"), head.alias("head"),
        C.version_of(_fourcc(F.col("user_id"))).alias("version"))
    return C.frame_header(df.withColumn("frame_type", C.frame_type(F.col("version"), F.col("head"))))


def _bit(pos: str, n: int = 1) -> str:
    return f"((w >> (56 - ({pos}) - {n})) & {(1 << n) - 1})"


# The picture header read bit by bit from the first 56 bits of the hash.
_HEADERS = f"""e AS (SELECT event_id AS seq, {_VERSION} AS v,
  ('0x' || substr(md5(event_id::VARCHAR || ':' || event_type), 1, 14))::BIGINT AS w FROM events),
t AS (SELECT *, CASE WHEN v = 'wmv2' THEN {_bit("0")} = 0 WHEN v = 'v1' THEN {_bit("37", 2)} = 0
  ELSE {_bit("0", 2)} = 0 END AS i FROM e),
a AS (SELECT *, CASE WHEN v = 'v1' THEN {_bit("39", 5)} WHEN v = 'wmv2' AND i THEN {_bit("8", 5)}
  WHEN v = 'wmv2' THEN {_bit("1", 5)} WHEN v IS NOT NULL THEN {_bit("2", 5)} END AS q,
  CASE WHEN v = 'wmv2' AND NOT i THEN {_bit("6", 2)} END AS st,
  CASE WHEN v = 'wmv1' AND i THEN {_bit("17", 11)} * 1024 END AS rate,
  CASE WHEN v = 'v3' AND i THEN 12 WHEN v = 'v3' THEN 8 WHEN v = 'wmv1' AND i THEN 29 WHEN v = 'wmv1' THEN 8
    WHEN v = 'wmv2' AND i THEN 13 WHEN v = 'wmv2' AND {_bit("6", 2)} = 0 THEN 8 END AS p0 FROM t),
b AS (SELECT *, v = 'wmv2' AND NOT i AND st = 0 AS pw FROM a),
c AS (SELECT *, CASE WHEN pw THEN CASE WHEN {_bit("p0")} = 0 THEN 1 ELSE 2 END ELSE 0 END AS u1 FROM b),
d AS (SELECT *, CASE WHEN pw THEN p0 + u1 + 1 ELSE p0 END AS p2 FROM c),
f AS (SELECT *, CASE WHEN pw THEN {_bit("p2")} END AS ab FROM d),
g AS (SELECT *, CASE WHEN pw AND ab = 1 THEN CASE WHEN {_bit("p2 + 1")} = 0 THEN 0 WHEN {_bit("p2 + 2")} = 0 THEN 1 ELSE 2 END
    WHEN pw THEN 0 END AS abt_type,
  CASE WHEN pw THEN p2 + 1 + CASE WHEN ab = 1 THEN 1 + {_bit("p2 + 1")} ELSE 0 END ELSE p2 END AS p3 FROM f),
h AS (SELECT *, CASE WHEN v = 'wmv2' AND i THEN {_bit("p3")} END AS j,
  CASE WHEN v = 'wmv2' AND i THEN p3 + 1 ELSE p3 END AS p4 FROM g),
k AS (SELECT *, (v = 'wmv2' AND p0 IS NOT NULL) OR (v = 'wmv1' AND coalesce(rate, 0) > 51200) AS hasmb FROM h),
l AS (SELECT *, CASE WHEN hasmb THEN {_bit("p4")} WHEN v = 'wmv1' THEN 0 END AS mb,
  CASE WHEN hasmb THEN p4 + 1 ELSE p4 END AS p5 FROM k),
m AS (SELECT *, CASE WHEN p0 IS NULL OR NOT i THEN NULL WHEN coalesce(mb, 0) = 1 THEN 0 WHEN {_bit("p5")} = 0 THEN 0
    WHEN {_bit("p5 + 1")} = 0 THEN 1 ELSE 2 END AS rc,
  CASE WHEN i AND coalesce(mb, 0) = 0 THEN p5 + 1 + {_bit("p5")} ELSE p5 END AS p6 FROM l),
n AS (SELECT *, CASE WHEN p0 IS NULL THEN NULL WHEN i AND coalesce(mb, 0) = 1 THEN 0 WHEN {_bit("p6")} = 0 THEN 0
    WHEN {_bit("p6 + 1")} = 0 THEN 1 ELSE 2 END AS rl,
  CASE WHEN i AND coalesce(mb, 0) = 1 THEN p6 ELSE p6 + 1 + {_bit("p6")} END AS p7 FROM m),
hd AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN {_bit("p7")} END AS dc,
  CASE WHEN p0 IS NOT NULL AND NOT i THEN {_bit("p7 + 1")} END AS mv FROM n)"""


@query(f"""WITH {_HEADERS} SELECT seq, v AS version, CASE WHEN i THEN 'I' ELSE 'P' END AS frame_type,
  q::INT AS qscale, mb::INT AS per_mb_rl, rc::INT AS rl_chroma, rl::INT AS rl, dc::INT AS dc, mv::INT AS mv,
  rate::INT AS bit_rate FROM hd""")
def picture_headers(spark, sf_dir):
    h = F.col("header")
    names = ["qscale", "per_mb_rl", "rl_chroma", "rl", "dc", "mv", "bit_rate"]
    return coded_frames(spark, sf_dir).select("seq", "version", "frame_type", *[h[n].alias(n) for n in names])


@query(f"""WITH {_HEADERS} SELECT CASE WHEN v IS NULL THEN 'unknown_codec' WHEN q = 0 THEN 'bad_qscale'
  WHEN v = 'wmv2' AND i AND j = 1 THEN 'unsupported_j_frame'
  WHEN v IN ('wmv1', 'wmv2') AND NOT i AND mb = 1 THEN 'unsupported_per_mb_table'
  WHEN v = 'wmv2' AND NOT i AND (ab = 0 OR abt_type <> 0) THEN 'unsupported_abt'
  WHEN v = 'wmv2' AND NOT i AND st <> 0 THEN 'header_unread' ELSE 'ok' END AS status,
  v AS version, count(*) AS frames FROM hd GROUP BY ALL""")
def status_classes(spark, sf_dir):
    status = C.frame_status(F.col("version"), F.col("frame_type"), F.col("header"))
    return FR.config_histogram(coded_frames(spark, sf_dir).withColumn("status", status), "status", "version")


@query(f"""WITH {_HEADERS} SELECT seq, v AS version FROM hd WHERE rc = 1 AND rl = 2 AND dc = 1""")
def config_filter(spark, sf_dir):
    return FR.with_config(coded_frames(spark, sf_dir)).select("seq", "version")


@query(f"""WITH {_HEADERS} SELECT seq, v AS version FROM hd WHERE rc = 1 AND rl = 2 AND dc = 1""")
def config_scan(spark, sf_dir):
    """The same frames from a table written in the order of their configurations: the filter skips row groups of the scan."""
    path = shared_dir(spark, "clustered-frames")
    write_table(FR.by_config(coded_frames(spark, sf_dir)), path)
    return FR.with_config(spark.read.parquet(path)).select("seq", "version")
