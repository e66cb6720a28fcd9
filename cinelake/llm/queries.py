"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import (bpe, decontamination, hard_negatives, importance, mixing, ngram_join, secrets, sharding, substring_dedup, url_filter,
                          vector_dedup, warc, whitening)
from cinelake.llm.common import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

#: Rules of the URL query: host, path, action.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
N_SHARDS = 24


def vocabulary_path() -> str:
    """The public vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    out = bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


URL_SQL = r"""
WITH rules(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
  SELECT page_id, row_number() OVER () AS rn,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rn,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
hits AS (
  SELECT rn, h || p AS rule, action,
    row_number() OVER (PARTITION BY rn ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (rn)
"""


@query(URL_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query()
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; counts and digest cover the base patterns, ``spans`` all."""
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def joined(base_only: bool):
        spans = F.filter("spans", lambda s: s["kind"] != "literal") if base_only else F.col("spans")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(joined(True).cast("binary"), 256).alias("base_sha256"), joined(False).alias("spans"))


SHARD_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS s,
    coalesce(strlen(text), 0) + 8 AS size, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
c AS (
  SELECT d.* EXCLUDE (h), xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
      lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, crc_table),
m AS (
  SELECT c.*, md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || size || ':' || text_crc32)) AS k, place, sources
  FROM c JOIN (SELECT s, row_number() OVER (ORDER BY s) - 1 AS place, count(*) OVER () AS sources FROM (SELECT DISTINCT s FROM d)) USING (s)),
f AS (
  SELECT *, (row_number() OVER w - 1 + (place + 0.5::DOUBLE) / sources::DOUBLE) / count(*) OVER (PARTITION BY s) AS frac
  FROM m WINDOW w AS (PARTITION BY s ORDER BY k, doc_id, size, text_crc32)),
p AS (SELECT *, row_number() OVER (ORDER BY frac, s, k, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 24 // n)::INTEGER AS shard,
  pos - ((pos * 24 // n) * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""


@query(SHARD_SQL)
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, each with the corpus' mixture of sources."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"))
    dealt = sharding.interleave(docs, N_SHARDS, keep=("size", "text_crc32"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query()
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return ngram_join.similar(table(spark, sf_dir, "documents"))


@query()
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document after 13-word windows that an earlier document has are cut."""
    out = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


LEAK_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
bw AS (
  SELECT item_id, len(w) AS n, least(len(w), 12) AS width, ceil(least(len(w), 12) * 10 / 12) AS enough, unnest(w) AS word,
    generate_subscripts(w, 1) AS j
  FROM b),
diag AS (
  SELECT doc_id, item_id, any_value(n) AS n, any_value(width) AS width, any_value(enough) AS enough, i - j AS diagonal, list(j) AS js
  FROM dw JOIN bw USING (word) GROUP BY doc_id, item_id, i - j HAVING count(*) >= any_value(enough)),
laid AS (
  SELECT *, len(js) AS matched, list_transform(range(1, n + 1), lambda k: list_contains(js, k)::INTEGER) AS same FROM diag),
ok AS (
  SELECT * FROM laid
  WHERE len(list_filter(range(1, n - width + 2), lambda s: list_sum(same[s:s + width - 1]) >= enough)) > 0)
SELECT doc_id, item_id, arg_max(diagonal, (matched, -diagonal))::BIGINT AS diagonal, max(matched)::BIGINT AS matched,
  any_value(n)::BIGINT AS item_words
FROM ok GROUP BY doc_id, item_id
"""


@query(LEAK_SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: 10 of some 12 consecutive words of it (all but a sixth of a shorter one)."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps."""
    return importance.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of every vector."""
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


@query(WARC_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC files and back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(n) OVER () AS total, row_number() OVER by_limit AS place,
    coalesce(sum(n) OVER (by_limit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before,
    sum(w) OVER (by_limit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM s WINDOW by_limit AS (ORDER BY n * (6 // w), source NULLS LAST)),
f AS (
  SELECT *, min(CASE WHEN w * (3 * total - 4 * n_before) <= 4 * n * w_left THEN place END) OVER () AS free FROM o),
g AS (
  SELECT *, 3 * total - 4 * min(CASE WHEN place = free THEN n_before END) OVER () AS lft,
    2 * min(CASE WHEN place = free THEN w_left END) OVER () AS below
  FROM f),
t AS (
  SELECT source, n, CASE WHEN free IS NULL OR place < free THEN 2 * n ELSE w * lft END AS num,
    CASE WHEN free IS NULL OR place < free THEN 1 ELSE below END AS den,
    ('0x' || substr(md5('mix:' || CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS start
  FROM g),
r AS (
  SELECT d.doc_id, d.size, t.*, greatest(t.den * t.n, 1) AS unit,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.k, d.doc_id) AS hi
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, (hi * num) // unit + CASE WHEN ((hi * num) % unit)::DOUBLE / unit::DOUBLE + start >= 1 THEN 1 ELSE 0 END
    - ((hi - 1) * num) // unit - CASE WHEN (((hi - 1) * num) % unit)::DOUBLE / unit::DOUBLE + start >= 1 THEN 1 ELSE 0 END AS copies
  FROM r)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, num::DOUBLE / den::DOUBLE AS target,
  CASE WHEN n > 0 THEN copies * size ELSE 0 END::BIGINT AS taken
FROM c
"""


@query(MIX_SQL)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


NEGATIVE_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5
"""


@query(NEGATIVE_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label)


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
