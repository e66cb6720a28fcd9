"""WARC archives: written by Spark's text writer, read back in splits and verified along the chain of record boundaries.

A record is text up to its closing blank lines, which are the writer's line separator, so the files are plain WARC and
come with Spark's commit protocol on any file system. Reading splits files at the version line, wherever it stands:
every occurrence is a candidate record, also those inside payloads. A candidate's header says where its record ends, which gives
an edge from its offset to its successor's. Only candidates that the first byte of the file reaches are records.

Offsets are running sums of piece lengths. Stretches in which every candidate points to the next one are
contracted first (in a sound file without the version line in a payload that is the whole file), then pointer jumping
doubles the reach over what is left, so rounds grow with the logarithm of the breaks. All that takes part is a few
numbers per candidate; pieces, with their texts, are written once and regrouped by record at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.session import saved, shared_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: File names that the driver hands to the reader.
MAX_PATHS = 1000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four of base 32."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), DIGITS32, BASE32)


def header_lines(**fields: Column | str) -> Column:
    parts = []
    for name, value in fields.items():
        parts += [F.lit(name.replace("_", "-") + ": "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n")]
    return F.concat(*parts)


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: a record per row, without the closing blank lines.

    Of rows with equal payloads of ``min_bytes`` or more, that with the least id is a response and the others revisit it;
    smaller payloads are all responses. A null payload is empty. Rows that repeat the least id with the same payload are
    responses too. A null id is written empty and never referred to if another row has the payload; a null
    URL is written empty, and line ends in URLs are percent-encoded.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload"), "digest": base32_sha1(F.col("payload").cast("binary"))})
    first = rows.groupBy("digest", "n").agg(F.min("id").alias("first"))
    rows = rows.join(first, ["digest", "n"])
    revisit = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), header_lines(
        Content_Type="text/html; charset=utf-8", Content_Length=F.col("n").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(revisit, header_lines(WARC_Refers_To=urn("first"), WARC_Profile=PROFILE)).otherwise(F.lit(""))
    head = F.concat(F.lit(MAGIC), header_lines(
        WARC_Type=kind, WARC_Record_ID=urn("id"), WARC_Date=date, WARC_Target_URI=url,
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")), Content_Type="application/http;msgtype=response",
        Content_Length=F.octet_length(block).cast("string")), refers, F.lit("\r\n"))
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "none", **options) -> None:
    """WARC files (one per partition) in the folder ``path``; ``gzip`` files are smaller but read by one task each."""
    records(pages, **options).write.option("lineSep", END).option("compression", compression).text(path)


def field(head: Column, name: str) -> Column:
    """A header field's value, null where it is missing. Only line feeds end lines (``d``), as records are split by CRLF."""
    found = F.regexp_extract(head, rf"(?imd)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What stands between the version lines of every file, in reading order (``block``, ``seq``)."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")


def measured(parts: DataFrame, *more: str | Column) -> DataFrame:
    """Place, length and header figures of every piece: a few numbers."""
    head = F.substring_index("value", END, 1)
    size = field(head, "Content-Length")
    return parts.select(
        "file", "block", "seq", F.octet_length("value").cast("long").alias("n"), F.octet_length(head).cast("long").alias("h"),
        F.when(size.rlike(r"^[0-9]{1,18}$"), size).cast("long").alias("size"), *more)


def candidates(narrow: DataFrame) -> DataFrame:
    """Per measured piece: ``offset`` of its version line, ``next`` (the offset its header leads to, null without a sound header)."""
    order = Window.partitionBy("file").orderBy("block", "seq")
    before = F.coalesce(F.sum(F.col("n") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = narrow.withColumn("offset", before - len(MAGIC))
    sound = F.col("size").isNotNull() & (F.col("h") < F.col("n"))
    following = F.when(sound, F.col("offset") + len(MAGIC) + F.col("h") + len(END) + F.col("size") + len(END))
    return placed.withColumn("next", following)


def reachable(found: DataFrame) -> DataFrame:
    """``file``, ``run``, ``entry``: the stretches of candidates that the file's first byte reaches, and where it enters them.

    ``found`` has ``file``, ``offset``, ``next`` and ``run``.
    """
    runs = found.groupBy("file", "run").agg(F.max_by("next", "offset").alias("exit"))
    target = found.select("file", F.col("run").alias("to"), F.col("offset").alias("exit"))
    jump = saved(runs.join(target, ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("entry")), "jumps")
    reach = saved(found.filter("offset = 0").select("file", "run", F.col("offset").alias("entry")), "reach")
    n = reach.count()
    while True:
        new = reach.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), jump["entry"])
        reach = saved(reach.union(new).distinct(), "reach")
        grown = reach.count()
        if grown == n:
            return reach
        n = grown
        after = jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        jump = saved(jump.join(after, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("entry2").alias("entry")), "jumps")


def parsed(text: Column) -> dict[str, Column]:
    """Fields of a record, from its text after the version line."""
    head = F.substring_index(text, END, 1)
    body = F.substring(text.cast("binary"), F.octet_length(head) + len(END) + 1, field(head, "Content-Length").cast("int"))
    http = F.substring_index(body.cast("string"), END, 1)
    kind = field(head, "WARC-Type")
    return {
        "type": kind, "record_id": field(head, "WARC-Record-ID"), "uri": field(head, "WARC-Target-URI"),
        "refers_to": field(head, "WARC-Refers-To"), "payload_digest": field(head, "WARC-Payload-Digest"),
        "http_bytes": field(http, "Content-Length").cast("long"),
        "payload": F.when(kind != "revisit", F.substring(body, F.octet_length(http) + len(END) + 1, F.octet_length(body))),
    }


def verified(placed: DataFrame) -> DataFrame:
    """``file``, ``offset``, ``next`` of the candidates that the first byte of their file reaches."""
    order = Window.partitionBy("file").orderBy("offset")
    real = placed.filter("offset >= 0 AND next IS NOT NULL").select("file", "offset", "next")
    linked = F.coalesce(F.lag("next").over(order) == F.col("offset"), F.lit(False))
    numbered = real.withColumn("new", (~linked).cast("int")).withColumn("run", F.sum("new").over(order)).drop("new")
    numbered = saved(numbered, "warc-runs")
    reach = reachable(numbered)
    return numbered.join(reach, ["file", "run"]).filter("offset >= entry").select("file", "offset", "next")


def read_archives(spark: SparkSession, path: str | list[str], files: DataFrame | None = None) -> DataFrame:
    """One row per verified record: ``file``, ``offset``, ``type``, ``record_id``, ``uri``, ``refers_to``, ``payload_digest`` (as
    stated), ``http_bytes`` (payload length as its HTTP header states it) and ``payload`` (null for revisits).

    Records behind a break in the chain (a damaged header, a file that does not begin with a record) are left
    out. Empty files and folders give no rows. With ``files`` (column ``file``) only those are read.
    """
    parts = pieces(spark, path)
    parts = saved(parts if files is None else parts.join(files, "file", "left_semi"), "warc-pieces")
    placed = saved(candidates(measured(parts)), "warc-candidates")
    true = verified(placed)
    # pieces of a record: its own and the false candidates behind it, up to its end
    marked = placed.select("file", "block", "seq", "offset").join(true.withColumnRenamed("next", "end"), ["file", "offset"], "left")
    back = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({
        "record": F.last(F.when(F.col("end").isNotNull(), F.col("offset")), True).over(back), "until": F.last("end", True).over(back)})
    marked = marked.filter("record IS NOT NULL AND offset < until").select("file", "block", "seq", "offset", "record")
    whole = parts.join(marked, ["file", "block", "seq"]).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
    rows = whole.select("file", F.col("record").alias("offset"), text.alias("text"))
    return rows.select("file", "offset", *[c.alias(k) for k, c in parsed(F.col("text")).items()])


def summaries() -> dict[str, Column]:
    """Payload length and digest in place of the payload: of a response as read, of a revisit as it states them."""
    return {
        "payload_bytes": F.coalesce(F.octet_length("payload").cast("long"), F.col("http_bytes")),
        "payload_digest": F.coalesce(base32_sha1(F.col("payload")), F.regexp_replace("payload_digest", "^sha1:", "")),
    }


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """``read_archives`` with ``payload_bytes`` and ``payload_digest`` as read instead of payloads.

    Every piece is summed up where it is read, as if it were a record. In a file whose candidates all turn out to
    be records that is the result, and no text is ever written or moved; only files with a false candidate are read again whole.
    """
    fields = parsed(F.col("value"))
    read = pieces(spark, path).withColumns(fields)
    kept = [k for k in fields if k not in ("payload", "payload_digest")]
    placed = saved(candidates(measured(read, *kept, *[c.alias(k) for k, c in summaries().items()])), "warc-summaries")
    true = saved(verified(placed), "warc-records")
    # a file begins with one empty piece; any other piece has to be a record
    counts = placed.groupBy("file").agg(F.sum(((F.col("offset") >= 0) | (F.col("n") > 0)).cast("long")).alias("pieces"))
    sound = counts.join(true.groupBy("file").agg(F.count("*").alias("records")), "file", "left")
    sound = saved(sound.select("file", (F.coalesce("records", F.lit(0)) == F.col("pieces")).alias("sound")), "warc-files")
    columns = ["file", "offset", *kept, "payload_bytes", "payload_digest"]
    good = placed.join(true.select("file", "offset"), ["file", "offset"]).join(sound.filter("sound").select("file"), "file")
    broken = sound.filter("NOT sound").select("file")
    again = [r[0] for r in broken.limit(MAX_PATHS + 1).collect()]  # file names, as the reader takes them
    if not again:
        return good.select(*columns)
    # with very many such files the folder is read as it is, and the others' pieces are left out
    whole = read_archives(spark, again) if len(again) <= MAX_PATHS else read_archives(spark, path, broken)
    whole = whole.withColumns(summaries())
    return good.select(*columns).unionByName(whole.select(*columns))


def page_number(urn: Column) -> Column:
    """The id in a record's urn, null if it has none."""
    number = F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(number != "", number).cast("long")


def round_trip(pages: DataFrame, compression: str = "gzip", **options) -> DataFrame:
    """Write the pages as WARC files into the shared folder and read them back: a row per record.

    Lengths and digests of responses are those of the payloads read; revisits state those of the response they refer to.
    """
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path, compression=compression, **options)
    return read_summaries(pages.sparkSession, path).select(
        page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page_number(F.col("refers_to")).alias("refers_to"))
