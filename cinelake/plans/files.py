"""Queries over files that Spark writes first: media files, code tables, votes, points, the table sink."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinelake.operators import codes as C
from cinelake.plans.codetables import _VOTES, _observed, _part_codes
from cinelake.plans.registry import query, table
from cinelake.session import shared_dir
from cinelake.sources import media
from cinelake.sources import tables as S
from cinelake.sources.packed import read_packed, write_packed

#: Order keys whose points of a supplier share a file.
ORDERS_PER_FILE = 100_000


@query("SELECT p_brand AS table_id, bin(p_partkey) AS code, p_partkey::VARCHAR AS symbol FROM part")
def code_files(spark, sf_dir):
    """Code tables as canonical JSON files and back."""
    path = shared_dir(spark, "code-files")
    S.write_codes(_part_codes(spark, sf_dir), path)
    return S.read_codes(spark, path, "code_value").select("table_id", "code", "symbol")


@query(f"WITH {_VOTES} SELECT table_id, symbol::VARCHAR AS symbol, code, n FROM v")
def vote_files(spark, sf_dir):
    """Votes as nested JSON, one file per table, and back."""
    votes = C.count_votes(_observed(spark, sf_dir)).withColumn("symbol", F.col("symbol").cast("string"))
    pairs = votes.groupBy("table_id", "symbol").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("codes"))
    symbols = pairs.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "codes"))).alias("symbols"))
    path = shared_dir(spark, "vote-files")
    symbols.select(F.to_json(F.create_map("table_id", "symbols")).alias("value"), F.col("table_id").alias("file")).write.partitionBy(
        "file").text(path)
    return S.read_votes(spark, path).select("table_id", "symbol", "code", "n")


@query("""SELECT l_suppkey::VARCHAR AS table_id, l_linenumber::INT AS "left", (l_partkey % 100)::INT AS topleft, l_quantity::INT AS top,
  l_returnflag = 'R' AS from_left, (l_orderkey % 1000)::INT AS true_pred, l_linestatus AS ac_pred, count(*) AS n
FROM lineitem GROUP BY ALL""")
def point_files(spark, sf_dir):
    """Observation points as JSON arrays in packed files of bounded size, every third one cut off inside its last point, and back."""
    text = lambda c: c.cast("string")
    point = F.array(
        text(F.col("l_linenumber")), text(F.col("l_partkey") % 100), text(F.col("l_quantity").cast("int")),
        text(F.col("l_returnflag") == "R"), text(F.col("l_orderkey") % 1000), F.lit("0"), F.col("l_linestatus"),
        F.lit("1"), F.lit("2"), F.lit("f"))
    # a supplier's points go to numbered files, so that none grows with its supplier; they are shuffled as short texts
    number = F.call_function("div", F.col("l_orderkey"), F.lit(ORDERS_PER_FILE))
    arrays = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), number.alias("number")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(point)), ","), F.lit("]")).alias("array"))
    cut = F.concat(F.expr("left(array, length(array) - 1)"), F.lit(',["7","8","cut'))
    files = arrays.select(
        F.concat_ws("/", text(F.col("supplier")), F.concat(text(F.col("number")), F.lit(".json"))).alias("path"),
        F.when(F.col("number") % 3 == 0, cut).otherwise(F.col("array")).alias("content"))
    path = shared_dir(spark, "point-files")
    write_packed(files, path)
    docs = read_packed(spark, path).select(F.substring_index("path", "/", 1).alias("table_id"), F.col("content").alias("value"))
    columns = ["table_id", "left", "topleft", "top", "from_left", "true_pred", "ac_pred"]
    return S.points_of(docs).filter("_corrupt_record IS NULL").groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN starts_with(html, '<!DOCTYPE') THEN 'html' ELSE 'unknown' END AS container, page_id,
  octet_length(encode(html))::INT AS size FROM pages""")
def table_sink(spark, sf_dir):
    """Pages sniffed, written by container and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    path = shared_dir(spark, "table-sink")
    S.write_table(media.sniff(pages, extra={"html": b"<!DOCTYPE"}), path)
    return spark.read.parquet(path).select("container", "page_id", F.octet_length("content").alias("size"))


@query("""SELECT conv_id, octet_length(encode(body))::BIGINT AS length, md5(body) AS digest, 'unknown' AS container
FROM (SELECT conv_id, string_agg(turn || ':' || text, chr(10) ORDER BY turn) || chr(10) AS body FROM conversations GROUP BY conv_id)""")
def file_bytes(spark, sf_dir):
    """A text file per conversation, packed, and read as media files."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    body = F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["turn"].cast("string"), t["text"])), "\n")
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(body, F.lit("\n")).alias("content"))
    path = shared_dir(spark, "text-files")
    write_packed(files.select(F.concat(F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"), "content"), path)
    conv = F.regexp_extract("path", r"^([0-9]+)\.txt$", 1).cast("bigint")
    found = media.sniff(read_packed(spark, path))
    return found.select(conv.alias("conv_id"), "length", F.md5("content").alias("digest"), "container")


@query("""SELECT p_brand AS table_id, bin(p_partkey) AS code,
  row_number() OVER (PARTITION BY p_brand ORDER BY length(bin(p_partkey)), bin(p_partkey))::INT AS place FROM part""")
def canonical_order(spark, sf_dir):
    """Place of every code in its table's canonical order, counted along the sorted rows."""
    ordered = C.canonical(_part_codes(spark, sf_dir)).withColumn("row", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("table_id").orderBy("row"))
    return ordered.select("table_id", "code", place.alias("place"))
