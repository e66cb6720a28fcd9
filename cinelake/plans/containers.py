"""Container queries: files are built from table texts as column expressions, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions.bits import le_bytes
from cinelake.operators import reassembly as R
from cinelake.operators import frames as FR
from cinelake.operators.frames import reconcile_index
from cinelake.plans import builders as B
from cinelake.plans.registry import digest, query, table
from cinelake.session import shared_dir
from cinelake.sources import asf, avi, media, ranged
from cinelake.sources.records import media_records
from cinelake.sources.tables import codes_from_text, from_base64, from_hex
from cinelake.streaming.frames import stream_frames

LINE_CODEC = b"DIV3"
ASF_STEP = 4096
WMV_STEP = 256
OBJECT_SPACING = 1 << 20
CONVERSATIONS_PER_FILE = 64
STAGED_FILES = 4
DOCS_PER_ARCHIVE = 512
ARCHIVE_RANGE = 128 << 10


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda s: s.cast("binary"))


def avi_files(spark: SparkSession, sf_dir: str, with_index: bool = False) -> DataFrame:
    """One AVI file per document, one video chunk per line of text."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), _lines(F.col("text")).alias("lines"))
    chunks = F.transform("lines", lambda b: B.chunk("00dc", b))
    if not with_index:
        return docs.select("file_id", B.avi_file(F.lit(LINE_CODEC), chunks).alias("content"))
    docs = docs.withColumn("sizes", F.transform("lines", F.octet_length))
    # every seventh size is written one too large
    def entry(size: Column, before: Column) -> Column:
        return F.concat(F.lit(b"00dc"), B.int_le(16, 4), le_bytes(before, 4), le_bytes(size + (size % 7 == 0).cast("int"), 4))

    # one pass that carries the offset along
    start = F.struct(F.lit(4).alias("at"), F.array().cast("array<binary>").alias("entries"))
    walked = F.aggregate("sizes", start, lambda acc, n: F.struct(
        (acc["at"] + 8 + n + n % 2).alias("at"), F.array_append(acc["entries"], entry(n, acc["at"])).alias("entries")))
    index = B.chunk("idx1", B.join_bytes(walked["entries"]))
    return docs.select("file_id", B.avi_file(F.lit(LINE_CODEC), chunks, index).alias("content"))


_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)"""


@query(f"""WITH {_LINES} SELECT doc_id AS file_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seq,
  octet_length(encode(line))::INT AS size, md5(hex(encode(line))) AS digest, false AS truncated
FROM l WHERE line <> ''""")
def avi_round_trip(spark, sf_dir):
    packets = avi.avi_packets(avi_files(spark, sf_dir), with_payload=True)
    return packets.select("file_id", "seq", "size", digest(F.col("payload")).alias("digest"), "truncated")


@query("""SELECT doc_id AS file_id, 'DIV3' AS fourcc, 'v3' AS version, 96 AS width, 64 AS height, 'ok' AS status
FROM documents""")
def avi_headers(spark, sf_dir):
    return avi.avi_streams(avi_files(spark, sf_dir)).select("file_id", "fourcc", "version", "width", "height", "status")


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, octet_length(encode(line)) AS n FROM l)
SELECT doc_id AS file_id, CASE WHEN n = 0 THEN 'index_only' WHEN n % 7 = 0 THEN 'size_mismatch' ELSE 'match' END AS class,
  count(*) AS entries FROM s GROUP BY ALL""")
def index_reconcile(spark, sf_dir):
    walked = media_records(avi_files(spark, sf_dir, with_index=True), stream_no=None)
    merged = reconcile_index(walked.index, walked.packets)
    return merged.groupBy("file_id", "class").agg(F.count(F.lit(1)).alias("entries"))


_FRAMES = _LINES + """,
f AS (SELECT doc_id AS file_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seq,
  ('0x' || substr(hex(encode(line)), 1, 2))::BIGINT AS b FROM l WHERE line <> ''),
t AS (SELECT file_id, seq, b < 64 AS i, (b >> 1) & 31 AS q FROM f),
g AS (SELECT *, q > 0 AS ok, sum(i::INT) OVER w AS gop, sum((i AND q > 0)::INT) OVER p AS oki,
  last_value(CASE WHEN q > 0 THEN seq END IGNORE NULLS) OVER p AS okseq FROM t
  WINDOW w AS (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING),
  p AS (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT file_id, seq, CASE WHEN i THEN 'I' ELSE 'P' END AS frame_type, q::INT AS qscale, gop::BIGINT AS gop_id,
  CASE WHEN gop > 0 THEN row_number() OVER (PARTITION BY file_id, gop ORDER BY seq) - 1 END AS p_index,
  CASE WHEN NOT i AND coalesce(oki, 0) > 0 THEN okseq END AS ref_seq,
  CASE WHEN NOT i AND coalesce(oki, 0) = 0 THEN 'no_reference' WHEN ok THEN 'ok' ELSE 'bad_qscale' END AS status FROM g"""


@query(f"WITH {_FRAMES}")
def file_frames(spark, sf_dir):
    """From file bytes to tracked frames; a line's first byte decides its type and quantiser."""
    walked = media_records(avi_files(spark, sf_dir))
    frames = FR.frames_table(walked.packets, walked.streams, written=True)
    return frames.select(
        "file_id", "seq", "frame_type", F.col("header.qscale").alias("qscale"), "gop_id", "p_index", "ref_seq", "status")


@query(f"WITH {_FRAMES}")
def stream_files(spark, sf_dir):
    """The same frames from a stream of files in several micro-batches: walked, classified and tracked in one running query."""
    files = avi_files(spark, sf_dir)
    staged = max(STAGED_FILES, files.rdd.getNumPartitions())  # as many as tasks read the texts, half of them per micro-batch
    files = files.repartition(staged, "file_id")
    path = shared_dir(spark, "staged-files")
    files.write.parquet(path)
    arriving = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", staged // 2).parquet(path)
    return stream_frames(arriving, "file-frames").select(
        "file_id", "seq", "frame_type", F.col("header.qscale").alias("qscale"), "gop_id", "p_index", "ref_seq", "status")


def avi_archives(spark: SparkSession, sf_dir: str) -> str:
    """AVI files on disk, each of the lines of many documents, written by Spark as text files of binary rows.

    An empty JUNK chunk is the line separator. Stated sizes are the largest there are, as in files that were streamed.
    """
    docs = table(spark, sf_dir, "documents").withColumn("file_no", F.call_function("div", F.col("doc_id"), F.lit(DOCS_PER_ARCHIVE)))
    lines = docs.select("file_no", "doc_id", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    packets = lines.select("file_no", "doc_id", "place", B.chunk("00dc", F.col("line")).alias("row"))
    unknown = B.int_le(0xFFFFFFFE, 4)
    opening = F.concat(F.lit(b"RIFF"), unknown, F.lit(b"AVI "), B.avi_header(F.lit(LINE_CODEC), 96, 64), F.lit(b"LIST"), unknown, F.lit(b"movi"))
    heads = docs.select("file_no").distinct().select("file_no", F.lit(None).alias("doc_id"), F.lit(0).alias("place"), opening.alias("row"))
    rows = packets.unionByName(heads).repartition("file_no").sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first(), "place")
    path = shared_dir(spark, "archives")
    rows.select("file_no", F.col("row").cast("string")).write.option("lineSep", "JUNK\0\0\0\0").partitionBy("file_no").text(path)
    return path


@query(f"""WITH {_LINES}, n AS (SELECT *, doc_id // {DOCS_PER_ARCHIVE} AS file_no FROM l WHERE line <> '')
SELECT file_no, row_number() OVER (PARTITION BY file_no ORDER BY doc_id, k) - 1 AS seq, octet_length(encode(line))::INT AS size,
  md5(hex(encode(line))) AS digest, false AS truncated, 'v3' AS version FROM n""")
def ranged_packets(spark, sf_dir):
    """Packets of files that several tasks read at once, range by range."""
    files = ranged.list_files(spark, avi_archives(spark, sf_dir)).withColumn(
        "file_id", F.regexp_extract("path", "file_no=([0-9]+)", 1).cast("bigint"))
    packets = ranged.ranged_packets(ranged.file_ranges(files, ARCHIVE_RANGE), with_payload=True)
    bound = FR.with_codec(packets, ranged.ranged_streams(files))
    return bound.select(F.col("file_id").alias("file_no"), "seq", "size", digest(F.col("payload")).alias("digest"), "truncated", "version")


def asf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ASF file per document, its text one media object."""
    pieces = B.object_pieces(F.col("text").cast("binary"), F.lit(7), ASF_STEP)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), B.asf_file(pieces, ASF_STEP, b"WMV2").alias("content"))


def wmv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ASF file per document, every line a media object; numbers are one byte and come round again."""
    pieces = F.flatten(F.transform(_lines(F.col("text")), lambda b, k: B.object_pieces(b, k % 256, WMV_STEP)))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), B.asf_file(pieces, WMV_STEP, LINE_CODEC).alias("content"))


@query(f"WITH {_FRAMES}")
def wmv_frames(spark, sf_dir):
    """The frames of the same lines, carried by ASF files."""
    walked = media_records(wmv_files(spark, sf_dir))
    frames = FR.frames_table(R.object_packets(walked.fragments), walked.streams)
    return frames.select(
        "file_id", "seq", "frame_type", F.col("header.qscale").alias("qscale"), "gop_id", "p_index", "ref_seq", "status")


@query("""SELECT doc_id AS file_id, 7::BIGINT AS object_no, octet_length(encode(text))::INT AS size,
  md5(hex(encode(text))) AS digest FROM documents WHERE text <> ''""")
def asf_round_trip(spark, sf_dir):
    whole = R.reassemble(asf.asf_fragments(asf_files(spark, sf_dir)))
    return whole.select("file_id", "object_no", "size", digest(F.col("payload")).alias("digest"))


@query(f"""SELECT doc_id AS file_id, 'WMV2' AS fourcc, 'wmv2' AS version, 96 AS width, 1 AS stream_no,
  {ASF_STEP + 32}::BIGINT AS packet_size, 'ok' AS status FROM documents""")
def asf_headers(spark, sf_dir):
    return asf.asf_streams(asf_files(spark, sf_dir)).select(
        "file_id", "fourcc", "version", "width", "stream_no", "packet_size", "status")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'avi' WHEN 1 THEN 'asf' ELSE CASE
  WHEN starts_with(html, '<!DOCTYPE') THEN 'html' ELSE 'unknown' END END AS container FROM pages""")
def sniff(spark, sf_dir):
    html = F.col("html").cast("binary")
    kind = F.col("page_id") % 3
    content = (
        F.when(kind == 0, F.concat(F.lit(b"RIFF"), le_bytes(F.octet_length(html), 4), F.lit(b"AVI "), html))
        .when(kind == 1, F.concat(F.lit(asf.HEADER), html))
        .otherwise(html)
    )
    pages = table(spark, sf_dir, "pages").select("page_id", content.alias("content"))
    return media.sniff(pages, extra={"html": b"<!DOCTYPE"}).select("page_id", "container")


@query(f"""WITH {_LINES} SELECT doc_id AS file_id, k - 1 AS record_no, octet_length(encode(line))::BIGINT AS size,
  CASE WHEN line <> '' THEN md5(hex(encode(line))) END AS digest FROM l""")
def record_stream(spark, sf_dir):
    def record(b: Column) -> Column:
        return F.concat(le_bytes(F.octet_length(b), 4), b)

    streams = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), B.join_bytes(F.transform(_lines(F.col("text")), record)).alias("content"))
    return media.length_prefixed(streams).select("file_id", "record_no", "size", digest(F.col("payload")).alias("digest"))


@query("""SELECT doc_id, notation, octet_length(encode(text))::INT AS size, md5(hex(encode(text))) AS digest
FROM documents, (VALUES ('base64'), ('hex')) t(notation)""")
def packet_literals(spark, sf_dir):
    """Every text as a literal in either notation, decoded again."""
    raw = F.col("text").cast("binary")
    literals = table(spark, sf_dir, "documents").select("doc_id", F.base64(raw).alias("base64"), F.lower(F.hex(raw)).alias("hex"))

    def decoded(notation: str, packet: Column) -> DataFrame:
        return literals.select(
            "doc_id", F.lit(notation).alias("notation"), F.octet_length(packet).alias("size"), digest(packet).alias("digest"))

    return decoded("base64", from_base64(F.col("base64"))).unionByName(decoded("hex", from_hex(F.col("hex"))))


@query("""SELECT p_partkey, bin(p_partkey) AS code, p_size::INT AS a, -p_partkey::INT AS b FROM part""")
def text_codes(spark, sf_dir):
    entry = F.concat(F.lit('x := {"'), F.bin("p_partkey"), F.lit('":  {'), F.col("p_size").cast("string"), F.lit(", -"),
                     F.col("p_partkey").cast("string"), F.lit("},"))
    zero = F.when(F.col("p_partkey") == 0, F.regexp_replace(entry, "-0", "0")).otherwise(entry)
    return codes_from_text(table(spark, sf_dir, "part").select("p_partkey", zero.alias("value")))


# ---- fragments: a conversation is a media object, a turn a fragment


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").cast("binary").alias("payload"),
        F.octet_length("text").cast("int").alias("size"))
    totals = turns.groupBy("conv_id").agg(F.sum("size").alias("total"))
    return turns.join(totals, "conv_id")


def _declared() -> Column:
    """Every fifth conversation wants a byte more than it has; the others give up to two bytes away."""
    return F.when(F.col("conv_id") % 5 == 4, F.col("total") + 1).otherwise(F.col("total") - F.col("conv_id") % 3)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique object numbers, fragments arriving last turn first."""
    return _turns(spark, sf_dir).select(
        F.lit(1).cast("bigint").alias("file_id"),
        (F.col("conv_id") * 64 + 63 - F.col("turn")).alias("packet_no"),
        F.lit(0).alias("payload_no"),
        F.col("conv_id").alias("object_no"),
        (F.col("turn") * OBJECT_SPACING).alias("offset"),
        _declared().alias("object_size"), "size", "payload")


def reused_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 64 conversations; eight object numbers used over and over, and an object that never fills swallows its successor."""
    return _turns(spark, sf_dir).select(
        F.call_function("div", F.col("conv_id"), F.lit(CONVERSATIONS_PER_FILE)).alias("file_id"),
        (F.col("conv_id") * 64 + F.col("turn")).alias("packet_no"),
        F.lit(0).alias("payload_no"),
        (F.col("conv_id") % 8).alias("object_no"),
        (F.col("turn") * OBJECT_SPACING).alias("offset"),
        _declared().alias("object_size"), "size", "payload")


_TURNS = """c AS (SELECT *, octet_length(encode(text)) AS sz, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id) AS total
  FROM conversations),
d AS (SELECT *, CAST(CASE WHEN conv_id % 5 = 4 THEN total + 1 ELSE total - conv_id % 3 END AS BIGINT) AS declared FROM c)"""


@query(f"""WITH {_TURNS} SELECT conv_id AS object_no, max(declared)::INT AS size,
  md5(substr(hex(encode(string_agg(text, '' ORDER BY turn))), 1, 2 * max(declared))) AS digest
FROM d GROUP BY conv_id HAVING max(total) >= max(declared)""")
def reassemble_text(spark, sf_dir):
    return R.reassemble(fragments(spark, sf_dir)).select("object_no", "size", digest(F.col("payload")).alias("digest"))


@query(f"""WITH {_TURNS} SELECT conv_id AS object_no, count(*) AS fragments, max(total)::BIGINT AS bytes,
  max(declared) AS object_size FROM d GROUP BY conv_id HAVING max(total) < max(declared)""")
def incomplete_objects(spark, sf_dir):
    return R.incomplete(fragments(spark, sf_dir)).select("object_no", "fragments", "bytes", "object_size")


_REUSED = f"""{_TURNS},
fr AS (SELECT conv_id // {CONVERSATIONS_PER_FILE} AS file_id, conv_id % 8 AS object_no, conv_id * 64 + turn AS pk, turn, text, sz, declared,
  row_number() OVER (PARTITION BY conv_id // {CONVERSATIONS_PER_FILE}, conv_id % 8 ORDER BY conv_id, turn) AS rn FROM d),
walk AS (SELECT DISTINCT file_id, object_no, 0::BIGINT AS rn, 0::BIGINT AS episode, 0::BIGINT AS bytes, 0::BIGINT AS done FROM fr
  UNION ALL SELECT fr.file_id, fr.object_no, fr.rn, w.episode + CASE WHEN w.done > 0 THEN 1 ELSE 0 END,
    CASE WHEN w.done > 0 THEN 0 ELSE w.bytes END + fr.sz,
    CASE WHEN CASE WHEN w.done > 0 THEN 0 ELSE w.bytes END + fr.sz >= fr.declared THEN fr.declared ELSE 0 END
  FROM walk w JOIN fr ON fr.file_id = w.file_id AND fr.object_no = w.object_no AND fr.rn = w.rn + 1),
ep AS (SELECT file_id, object_no, w.episode, max(done) AS size, max(pk) AS emit_packet,
  string_agg(text, '' ORDER BY turn, pk) AS body FROM walk w JOIN fr USING (file_id, object_no, rn) GROUP BY file_id, object_no, w.episode
  HAVING max(done) > 0)
SELECT file_id, object_no, episode, size::INT AS size, emit_packet, md5(substr(hex(encode(body)), 1, 2 * size)) AS digest FROM ep"""


@query(f"WITH RECURSIVE {_REUSED}")
def reassemble_reused(spark, sf_dir):
    whole = R.reassemble(reused_fragments(spark, sf_dir), reuse=True)
    return whole.select("file_id", "object_no", "episode", "size", "emit_packet", digest(F.col("payload")).alias("digest"))
