"""Code-table queries: parts are code entries, line items observations of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions.bits import bit_string
from cinelake.operators import codes as C
from cinelake.plans.registry import query, table


def _part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("table_id"), F.bin("p_partkey").alias("code"), F.col("p_partkey").alias("symbol"))


_PART = "c AS (SELECT p_brand AS table_id, bin(p_partkey) AS code, p_partkey AS symbol FROM part)"


@query(f"""WITH {_PART}, x AS (SELECT l.table_id, count(*) AS n FROM c l JOIN c s ON l.table_id = s.table_id
  AND s.code <> l.code AND starts_with(l.code, s.code) GROUP BY l.table_id),
m AS (SELECT *, max(length(code)) OVER (PARTITION BY table_id) AS top FROM c),
a AS (SELECT table_id, count(*) AS codes, count(DISTINCT code) AS distinct_codes, min(length(code))::INT AS min_length,
  max(length(code))::INT AS max_length, sum(1::BIGINT << (top - length(code))::INT)::BIGINT AS kraft_numerator,
  (1::BIGINT << max(top)::INT)::BIGINT AS kraft_denominator FROM m GROUP BY table_id)
SELECT a.*, codes = distinct_codes AS bijective, kraft_numerator = kraft_denominator AS complete,
  coalesce(x.n, 0) AS conflicts, coalesce(x.n, 0) = 0 AS prefix_free FROM a LEFT JOIN x USING (table_id)""")
def code_audit(spark, sf_dir):
    return C.audit(_part_codes(spark, sf_dir))


@query(f"""WITH {_PART}, m AS (SELECT *, max(length(code)) OVER (PARTITION BY table_id) AS top FROM c)
SELECT table_id, sum(1::BIGINT << (top - length(code))::INT)::BIGINT AS kraft_numerator,
  (1::BIGINT << max(top)::INT)::BIGINT AS kraft_denominator,
  sum(1::BIGINT << (top - length(code))::INT) = (1::BIGINT << max(top)::INT) AS complete FROM m GROUP BY table_id""")
def kraft_sums(spark, sf_dir):
    return C.kraft(_part_codes(spark, sf_dir))


@query(f"""WITH {_PART} SELECT DISTINCT l.table_id, s.code AS short_code, l.code AS long_code
FROM c l JOIN c s ON l.table_id = s.table_id AND s.code <> l.code AND starts_with(l.code, s.code)""")
def prefix_conflicts(spark, sf_dir):
    return C.prefix_conflicts(_part_codes(spark, sf_dir))


@query("""SELECT b.p_brand AS table_id, s::INT AS symbol FROM (SELECT DISTINCT p_brand FROM part) b, range(0, 256) r(s)
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = b.p_brand AND p.p_partkey % 256 = s)""")
def missing_symbols(spark, sf_dir):
    codes = _part_codes(spark, sf_dir).withColumn("symbol", F.col("symbol") % 256)
    return C.missing_symbols(codes, 256)


@query("""WITH c AS (SELECT p_brand AS table_id, right(lpad(bin(p_partkey), 16, '0'), 3 + p_size % 10) AS code,
  min(p_partkey) AS symbol FROM part GROUP BY ALL),
d AS (SELECT doc_id, 'Brand#' || (1 + doc_id % 25) AS table_id,
  lpad(bin(('0x' || substr(md5(text), 1, 8))::BIGINT), 32, '0') AS bits FROM documents),
m AS (SELECT d.doc_id, min(c.code) AS code, min_by(c.symbol, length(c.code)) AS symbol, count(*) AS n FROM d JOIN c
  ON c.table_id = d.table_id AND starts_with(d.bits, c.code)
  AND NOT EXISTS (SELECT 1 FROM c s WHERE s.table_id = c.table_id AND s.code <> c.code AND starts_with(c.code, s.code))
  GROUP BY d.doc_id)
SELECT d.doc_id, m.code, m.symbol FROM d LEFT JOIN m USING (doc_id)""")
def prefix_lookup(spark, sf_dir):
    width = F.lit(3) + F.col("p_size") % 10
    codes = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("table_id"), F.right(F.lpad(F.bin("p_partkey"), 16, "0"), width).alias("code"),
        F.col("p_partkey").alias("symbol"))
    probes = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("table_id"),
        bit_string(F.unhex(F.md5("text")), 32).alias("bits"))
    return C.prefix_lookup(probes, "bits", codes).select("doc_id", "code", "symbol")


def _observed(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    if status:
        items = items.filter(F.col("l_linestatus") == status)
    return items.select(
        F.col("l_returnflag").alias("table_id"), (F.col("l_suppkey") % 64).alias("symbol"),
        F.bin(F.col("l_partkey") % 97).alias("code"))


_OBS = """o AS (SELECT l_returnflag AS table_id, l_suppkey % 64 AS symbol, bin(l_partkey % 97) AS code,
  l_linestatus AS side FROM lineitem)"""
_VOTES = _OBS + """,
v AS (SELECT table_id, symbol, code, count(*) AS n FROM o GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY table_id, symbol ORDER BY n DESC, length(code), code) AS rank FROM v)"""


@query(f"WITH {_VOTES} SELECT table_id, symbol, code, n FROM k WHERE rank = 1")
def vote_majority(spark, sf_dir):
    return C.majority(C.count_votes(_observed(spark, sf_dir)))


@query(f"WITH {_VOTES} SELECT table_id, symbol, code, n, rank::INT AS rank FROM k WHERE rank <= 3")
def top_codes(spark, sf_dir):
    return C.top_codes(C.count_votes(_observed(spark, sf_dir)), 3)


@query(f"""WITH {_VOTES}, s AS (SELECT * FROM v ORDER BY symbol)
SELECT table_id, code, count(*) AS symbols, sum(n)::BIGINT AS observations,
  string_agg(symbol || ':' || n, ',' ORDER BY symbol) AS counts FROM v GROUP BY ALL HAVING count(*) > 1""")
def inconsistent_codes(spark, sf_dir):
    pairs = F.transform(
        F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return C.inconsistent(_observed(spark, sf_dir)).withColumn("counts", F.array_join(pairs, ","))


_SIDES = _OBS + """,
v AS (SELECT side, table_id, symbol, code, count(*) AS n FROM o GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY side, table_id, symbol ORDER BY n DESC, length(code), code) AS r FROM v),
a AS (SELECT table_id, symbol, code FROM k WHERE r = 1 AND side = 'O'),
b AS (SELECT table_id, symbol, code FROM k WHERE r = 1 AND side = 'F')"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    best = [C.majority(C.count_votes(_observed(spark, sf_dir, s))).drop("n") for s in ("O", "F")]
    return best[0], best[1]


@query(f"""WITH {_SIDES} SELECT table_id, symbol, a.code AS stored_code, b.code AS observed_code,
  CASE WHEN b.code IS NULL THEN 'missing' WHEN a.code IS NULL THEN 'new' WHEN a.code = b.code THEN 'match'
  ELSE 'mismatch' END AS class FROM a FULL JOIN b USING (table_id, symbol)""")
def code_diff(spark, sf_dir):
    return C.diff_codes(*_sides(spark, sf_dir))


@query(f"""WITH {_SIDES} SELECT table_id, symbol, coalesce(b.code, a.code) AS code
FROM a FULL JOIN b USING (table_id, symbol)""")
def merge_codes(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return C.merge_codes(a, b, ["table_id", "symbol"])


@query(f"""WITH {_SIDES} SELECT DISTINCT table_id, code, 'common' AS kind FROM a JOIN b USING (table_id, code)
UNION ALL SELECT DISTINCT table_id, code, 'new' FROM a ANTI JOIN b USING (table_id, code)
UNION ALL SELECT DISTINCT table_id, '', 'table' FROM a""")
def code_sets(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    new = C.new_codes(a, b).select("table_id", "code").distinct()
    tables = C.distinct_values(a, "table_id").withColumn("code", F.lit(""))
    return (
        C.common_codes(a, b).withColumn("kind", F.lit("common"))
        .unionByName(new.withColumn("kind", F.lit("new")))
        .unionByName(tables.withColumn("kind", F.lit("table")))
    )


@query(f"""WITH {_SIDES}, f AS (SELECT table_id, code FROM o WHERE side = 'F')
SELECT 'known' AS kind, table_id, code, count(*) AS n FROM f SEMI JOIN a USING (table_id, code) GROUP BY ALL
UNION ALL SELECT 'disjoint', table_id, code, count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.table_id = f.table_id
  AND (starts_with(a.code, f.code) OR starts_with(f.code, a.code))) GROUP BY ALL""")
def code_membership(spark, sf_dir):
    known, _ = _sides(spark, sf_dir)
    obs = _observed(spark, sf_dir, "F")
    kept = C.known_only(obs, known).withColumn("kind", F.lit("known")).unionByName(
        C.disjoint_from(obs, known).withColumn("kind", F.lit("disjoint")))
    return kept.groupBy("kind", "table_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_VOTES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY n DESC, length(code), code, symbol) AS r FROM v),
w AS (SELECT DISTINCT table_id, 0::BIGINT AS r, []::BIGINT[] AS symbols, []::VARCHAR[] AS codes, []::BIGINT[] AS counts FROM ranked
  UNION ALL SELECT table_id, r, CASE WHEN take THEN list_append(symbols, symbol) ELSE symbols END,
    CASE WHEN take THEN list_append(codes, code) ELSE codes END, CASE WHEN take THEN list_append(counts, n) ELSE counts END
  FROM (SELECT w.table_id, o.r, o.symbol, o.code, o.n, w.symbols, w.codes, w.counts, NOT list_contains(w.symbols, o.symbol)
      AND len(list_filter(w.codes, lambda c: starts_with(c, o.code) OR starts_with(o.code, c))) = 0 AS take
    FROM w JOIN ranked o ON o.table_id = w.table_id AND o.r = w.r + 1))
SELECT table_id, unnest(symbols) AS symbol, unnest(codes) AS code, unnest(counts) AS n
FROM w QUALIFY r = max(r) OVER (PARTITION BY table_id)""")
def resolve_votes(spark, sf_dir):
    return C.resolve_votes(C.count_votes(_observed(spark, sf_dir)))


@query("""SELECT l_returnflag AS table_id, l_linestatus AS last, l_linenumber AS run, max(l_quantity) AS max_level
FROM lineitem GROUP BY ALL""")
def max_levels(spark, sf_dir):
    rl = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("table_id"), F.col("l_linestatus").alias("last"), F.col("l_linenumber").alias("run"),
        F.col("l_quantity").alias("level"))
    return C.max_by_group(rl)


@query("""SELECT l_partkey, l_extendedprice AS error, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (
  PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def best_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_extendedprice").alias("error"), "l_orderkey", "l_linenumber")
    return C.best_candidate(rows, ["l_partkey"], "error", ["l_orderkey", "l_linenumber"])


@query("""WITH s AS (SELECT p_brand AS k, lpad(bin(p_partkey), 16, '0') AS s FROM part WHERE p_size IS NOT NULL),
g AS (SELECT p_brand, p_size, min(lpad(bin(p_partkey), 16, '0')) AS lo, max(lpad(bin(p_partkey), 16, '0')) AS hi,
  min(reverse(lpad(bin(p_partkey), 16, '0'))) AS rlo, max(reverse(lpad(bin(p_partkey), 16, '0'))) AS rhi
  FROM part GROUP BY ALL)
SELECT p_brand, p_size,
  substr(lo, 1, coalesce(list_position(list_transform(range(1, 17), lambda i: lo[i] = hi[i]), false), 17)::INT - 1) AS prefix,
  reverse(substr(rlo, 1, coalesce(list_position(list_transform(range(1, 17), lambda i: rlo[i] = rhi[i]), false), 17)::INT - 1)) AS suffix
FROM g""")
def lcp_lcs(spark, sf_dir):
    s = F.lpad(F.bin("p_partkey"), 16, "0")
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(C.lcp(s).alias("prefix"), C.lcs(s).alias("suffix"))


@query("""WITH a AS (SELECT p_size % 8 AS anchor, lpad(bin(min(p_partkey)), 6, '0') AS anchor_code FROM part GROUP BY ALL),
s AS (SELECT doc_id, n_chars % 8 AS anchor, lpad(bin(('0x' || substr(md5(text), 1, 12))::BIGINT), 48, '0') AS segment FROM documents)
SELECT doc_id, (instr(segment, anchor_code) - 1)::INT AS anchor_at, substr(segment, 1, instr(segment, anchor_code) - 1) AS code
FROM s JOIN a USING (anchor) WHERE instr(segment, anchor_code) - 1 >= 1""")
def anchor_split(spark, sf_dir):
    anchors = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 8).cast("bigint").alias("anchor")).agg(
        F.lpad(F.bin(F.min("p_partkey")), 6, "0").alias("anchor_code"))
    obs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") % 8).alias("anchor"), bit_string(F.unhex(F.md5("text")), 48).alias("segment"))
    return C.split_at_anchor(obs, anchors, ["anchor"]).select("doc_id", "anchor_at", "code")


@query("""SELECT a.doc_id, (coalesce(list_position(list_transform(list_zip(string_split(a.text, ''), string_split(b.text, '')),
  lambda p: p[1] IS NOT DISTINCT FROM p[2]), false), length(a.text) + 1) - 1)::INT AS first_diff
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def first_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return docs.select("doc_id", "text").join(after, "doc_id").select(
        "doc_id", C.first_diff(F.col("text"), F.col("next_text")).alias("first_diff"))


@query("""SELECT v FROM range(0, (SELECT max(floor(o_totalprice / 100))::BIGINT + 1 FROM orders)) r(v)
WHERE v NOT IN (SELECT floor(o_totalprice / 100)::BIGINT FROM orders)""")
def gaps(spark, sf_dir):
    prices = table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 100).alias("v"))
    return C.gaps(prices, "v", bucket=1024)
