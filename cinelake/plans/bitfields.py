"""Bit-level queries: the hash of a text is its packet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import bits as B
from cinelake.functions.codecs import geometry, wmv1_bit_rate, wmv2_flags
from cinelake.plans.registry import query, table


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.unhex(F.md5("text")).alias("p"))


_H = "h AS (SELECT doc_id, n_chars, md5(text) AS h, ('0x' || substr(md5(text), 1, 14))::BIGINT AS w FROM documents)"


def _f(pos: int, n: int) -> str:
    return f"((w >> {56 - pos - n}) & {(1 << n) - 1})"


@query(f"""WITH {_H} SELECT doc_id, {_f(0, 1)}::BIGINT AS a, {_f(2, 5)}::BIGINT AS b, {_f(7, 13)}::BIGINT AS c,
  {_f(3, 32)}::BIGINT AS d, ((w >> CAST(53 - n_chars % 40 AS INTEGER)) & 7)::BIGINT AS e,
  (('0x' || substr(h, 31, 2))::BIGINT << 8)::BIGINT AS past_end,
  ({_f(17, 11)} * 1024)::INT AS bit_rate FROM h""")
def bit_fields(spark, sf_dir):
    p = F.col("p")
    return _packets(spark, sf_dir).select(
        "doc_id", B.bits(p, 0, 1).alias("a"), B.bits(p, 2, 5).alias("b"), B.bits(p, 7, 13).alias("c"),
        B.bits(p, 3, 32).alias("d"), B.bits(p, (F.col("n_chars") % 40).cast("int"), 3).alias("e"),
        B.bits(p, 120, 16).alias("past_end"), wmv1_bit_rate(p).alias("bit_rate"))


def _c3(pos: str) -> str:
    return f"CASE WHEN ((w >> (55 - ({pos}))) & 1) = 0 THEN 0 WHEN ((w >> (54 - ({pos}))) & 1) = 0 THEN 1 ELSE 2 END"


@query(f"""WITH {_H}, a AS (SELECT *, {_c3("12")} AS first FROM h),
b AS (SELECT *, 12 + CASE WHEN first = 0 THEN 1 ELSE 2 END AS start FROM a)
SELECT doc_id, first::INT AS first, ({_c3("start")})::INT AS second, start::INT AS start_bit FROM b""")
def c3_fields(spark, sf_dir):
    first = _packets(spark, sf_dir).withColumn("c", B.c3(F.col("p"), 12))
    at = F.lit(12) + F.col("c.used")
    return first.select(
        "doc_id", F.col("c.value").alias("first"), B.c3(F.col("p"), at)["value"].alias("second"), at.alias("start_bit"))


def _byte(i: int) -> str:
    return f"('0x' || substr(h, {2 * i + 1}, 2))::BIGINT"


def _le(i: int, n: int) -> str:
    return " + ".join(f"({_byte(i + k)} << {8 * k})" for k in range(n))


@query(f"""WITH {_H} SELECT doc_id, ({_le(1, 2)})::INT AS u16, ({_le(2, 4)})::BIGINT AS u32,
  CASE WHEN {_byte(5)} >= 128 THEN ({_le(2, 4)}) - 4294967296 ELSE ({_le(2, 4)}) END::INT AS s32,
  CASE WHEN {_byte(13)} >= 128 THEN ({_le(6, 7)}) + (({_byte(13)} - 256) * 72057594037927936::BIGINT)
    ELSE ({_le(6, 7)}) + {_byte(13)} * 72057594037927936::BIGINT END::BIGINT AS s64,
  NULL::INT AS outside FROM h""")
def le_ints(spark, sf_dir):
    p = F.col("p")
    return _packets(spark, sf_dir).select(
        "doc_id", B.le16(p, 1).alias("u16"), B.le32(p, 2).alias("u32"), B.le32s(p, 2).alias("s32"),
        B.le64(p, 6).alias("s64"), B.le16(p, 15).alias("outside"))


_BITS = "lpad(bin(('0x' || substr(md5(text), 1, 12))::BIGINT), 48, '0') || lpad(bin(('0x' || substr(md5(text), 13, 12))::BIGINT), 48, '0')"


@query(f"""WITH s AS (SELECT doc_id, substr({_BITS}, 1, 77) AS s FROM documents)
SELECT doc_id, s AS bits, rtrim(s, '1') AS trimmed,
  array_to_string(list_filter(range(0, 75), lambda i: substr(s, i + 1, 3) = '101'), ',') AS positions FROM s""")
def bit_strings(spark, sf_dir):
    bits = _packets(spark, sf_dir).select("doc_id", B.bit_string(F.col("p"), 77).alias("bits"))
    return bits.select(
        "doc_id", "bits", B.trim_run(F.col("bits"), "1").alias("trimmed"),
        F.array_join(B.pattern_positions(F.col("bits"), "101"), ",").alias("positions"))


#: Cannot overlap itself, so splitting at it meets every occurrence.
_MARK = "0011101"


@query(f"""WITH s AS (SELECT doc_id, coalesce((encode(nullif(text, ''))::BIT)::VARCHAR, '') AS s FROM documents),
p AS (SELECT doc_id, unnest(string_split(s, '{_MARK}')) AS part, generate_subscripts(string_split(s, '{_MARK}'), 1) AS k FROM s),
q AS (SELECT doc_id, sum(length(part) + {len(_MARK)}) OVER (PARTITION BY doc_id ORDER BY k) - {len(_MARK)} AS pos,
  k = max(k) OVER (PARTITION BY doc_id) AS tail FROM p),
h AS (SELECT doc_id, count(*) AS hits, min(pos) AS first, max(pos) AS last, sum(pos) AS total FROM q WHERE NOT tail GROUP BY doc_id)
SELECT doc_id, length(s)::BIGINT AS n_bits, length(replace(s, '0', ''))::BIGINT AS ones, coalesce(hits, 0)::BIGINT AS hits,
  first::BIGINT AS first_hit, last::BIGINT AS last_hit, coalesce(total, 0)::BIGINT AS hit_sum,
  length(rtrim(s, '1'))::BIGINT AS trimmed, md5(s) AS bits_md5
FROM s LEFT JOIN h USING (doc_id)""")
def text_bits(spark, sf_dir):
    """Every bit of every whole text: how many are set, and where a marker stands at any bit offset."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("p"))
    at = F.col("found.positions")
    return docs.select("doc_id", B.bit_scan(F.col("p"), _MARK).alias("found")).select(
        "doc_id", "found.n_bits", "found.ones", F.size(at).cast("long").alias("hits"), F.get(at, F.lit(0)).alias("first_hit"),
        F.get(at, F.size(at) - 1).alias("last_hit"), F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x).alias("hit_sum"),
        "found.trimmed", F.col("found.md5").alias("bits_md5"))


@query(f"""WITH {_H}, v AS (SELECT doc_id, ({_byte(0)} % 13)::INT AS len, ({_byte(1)} * 256 + {_byte(2)})::INT AS raw,
  {_byte(3)}::INT AS b, ({_byte(4)} % 64)::INT AS cbp FROM h),
u AS (SELECT *, raw & ((1 << len) - 1) AS val FROM v)
SELECT doc_id, CASE WHEN len = 0 THEN 0 WHEN (val >> (len - 1)) & 1 = 1 THEN val ELSE -xor(val, (1 << len) - 1) END::INT AS diff,
  CASE WHEN b >= 128 THEN b - 256 ELSE b END::INT AS level, ((cbp >> 3) & 1)::INT AS third, cbp AS packed,
  CASE WHEN cbp & 3 <> 3 THEN xor(cbp, 60) ELSE cbp END::INT AS flipped FROM u""")
def coded_values(spark, sf_dir):
    p = F.col("p")
    base = _packets(spark, sf_dir).select(
        "doc_id", (B.bits(p, 0, 8) % 13).cast("int").alias("len"), B.bits(p, 8, 16).cast("int").alias("raw"),
        B.bits(p, 24, 8).cast("int").alias("b"), (B.bits(p, 32, 8) % 64).cast("int").alias("cbp"))
    val = F.col("raw").bitwiseAND(B.shift_left(F.lit(1), F.col("len")) - 1)
    cbp = F.col("cbp")
    return base.select(
        "doc_id", B.sign_magnitude(F.col("len"), val).alias("diff"), B.int8(F.col("b")).alias("level"),
        B.unpack6(cbp, 2).alias("third"), B.pack6([B.unpack6(cbp, i) for i in range(6)]).alias("packed"),
        B.complement(cbp).cast("int").alias("flipped"))


@query(f"""WITH {_H} SELECT doc_id, {_f(0, 5)}::INT AS fps, ({_f(5, 11)} * 1024)::INT AS bit_rate, {_f(16, 1)}::INT AS mspel,
  {_f(17, 1)}::INT AS loop_filter, {_f(18, 1)}::INT AS abt, {_f(19, 1)}::INT AS j_type, {_f(20, 1)}::INT AS top_left_mv,
  {_f(21, 1)}::INT AS per_mb_rl FROM h""")
def stream_flags(spark, sf_dir):
    return _packets(spark, sf_dir).select("doc_id", wmv2_flags(F.col("p")).alias("f")).select("doc_id", "f.*")


@query("""SELECT p_partkey, ((p_size * 17 + 15) // 16)::INT AS mb_cols, ((p_size * 9 + 15) // 16)::INT AS mb_rows,
  (((p_size * 17 + 15) // 16) * 16)::INT AS padded_width, ((p_size * 17 + 1) // 2)::INT AS chroma_width,
  ((p_size * 9 + 1) // 2)::INT AS chroma_height FROM part""")
def picture_geometry(spark, sf_dir):
    g = geometry(F.col("p_size") * 17, F.col("p_size") * 9)
    return table(spark, sf_dir, "part").select("p_partkey", g.alias("g")).select(
        "p_partkey", "g.mb_cols", "g.mb_rows", "g.padded_width", "g.chroma_width", "g.chroma_height")
