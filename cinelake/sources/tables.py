"""Code tables, votes and observation points from JSON and text; packet literals; sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinelake.sources.walk import walk_records



def text_entry(numbers: int = 2) -> str:
    """Pattern of one code-table entry in source text: a quoted code, then that many integers in braces."""
    quoted_code, integer, blank = '"([01]+)"', r"(-?\d+)", r"\s*"
    inside = ("," + blank).join([integer] * numbers)
    return f"{quoted_code}:{blank}\\{{{blank}{inside}{blank}\\}}"



def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file (a file is one value): table_id and value.

    The table is that of a ``table_id=`` folder, as the sink writes it, else the file name without suffix.
    """
    files = spark.read.option("wholetext", "true").text(path)
    if "table_id" in files.columns:
        return files.select(F.col("table_id").cast("string"), "value")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(name.alias("table_id"), "value")


def _checked(docs: DataFrame, schema: str) -> DataFrame:
    """Parse; a malformed or truncated file keeps its text in ``_corrupt_record``."""
    parsed = docs.withColumn("parsed", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return parsed.withColumn("_corrupt_record", F.when(F.col("parsed").isNull(), F.col("value"))).drop("value")


def read_codes(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Code tables: table_id, code, symbol, parts (the symbol's numbers), _corrupt_record.

    shape: ``code_value`` {code: value}, ``symbol_code`` {"run,level,last" or "CC_YYYY": code},
    ``code_pair`` {code: [kind, value]}.
    """
    if shape not in ("code_value", "symbol_code", "code_pair"):
        raise ValueError("shape is 'code_value', 'symbol_code' or 'code_pair'")
    rows = _checked(_documents(spark, path), "map<string,string>").select(
        "table_id", "_corrupt_record", F.explode_outer("parsed").alias("key", "value")
    )
    code, symbol = ("value", "key") if shape == "symbol_code" else ("key", "value")
    bare = F.regexp_replace(F.col(symbol), r'[\[\]"\s]', "")
    return rows.select(
        "table_id", F.col(code).alias("code"), bare.alias("symbol"),
        F.split(bare, "[,_]").alias("parts"), "_corrupt_record",
    )


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """Votes from {table: {symbol: {code: n}}}: table_id, symbol, code, n, _corrupt_record."""
    docs = _checked(_documents(spark, path), "map<string,map<string,map<string,bigint>>>")
    tables = docs.select("_corrupt_record", F.explode_outer("parsed").alias("table_id", "symbols"))
    symbols = tables.select("_corrupt_record", "table_id", F.explode_outer("symbols").alias("symbol", "codes"))
    return symbols.select("table_id", "symbol", F.explode_outer("codes").alias("code", "n"), "_corrupt_record")


#: What matters to nesting: whole strings, and brackets outside of them.
_NESTING = re.compile(rb'"(?:[^"\\]|\\.)*+"|[\[\]{}]', re.S)
_BLANK = b" \t\r\n,"
#: Points as writers make them: strings of bounded length without escapes, commas and brackets, so that text between
#: quotes is no separator. They need no parser; all else goes by nesting.
_STRING = rb'"[^"\\,\[\]\x00-\x1f]{0,64}+"'
_POINT = rb"\[" + _STRING + rb"(?:," + _STRING + rb"){0,31}+\]"
_POINTS = re.compile(_POINT + rb"(?:," + _POINT + rb")*+")


def _elements(data: bytes) -> Iterator[tuple]:
    """Elements of a JSON array by bracket depth: (point, element, None) for each whole one, of which one is null, and
    (None, None, text) for what cannot be one.

    A cut array gives all elements before the cut, and its tail; text that is no array comes out whole.
    """
    start = len(data) - len(data.lstrip())
    if data[start : start + 1] != b"[":
        yield None, None, data
        return
    depth, at = 1, start + 1
    if line := _POINTS.match(data, at):
        try:
            text = line[0].decode()
        except UnicodeDecodeError:
            pass
        else:
            for point in text[2:-2].split('"],["'):
                yield point.split('","'), None, None
            at = line.end()
    for m in _NESTING.finditer(data, at):
        kind = m[0][:1]
        if kind in b"[{":
            depth += 1
        elif kind in b"]}":
            depth -= 1
            if depth == 1:
                yield None, data[at : m.end()].lstrip(_BLANK), None
                at = m.end()
            elif depth == 0:
                tail = data[at : m.start()].strip(_BLANK) + data[m.end() :].strip()
                if tail:
                    yield None, None, tail
                return
    tail = data[at:].strip(_BLANK)
    yield None, None, tail or b"["


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Observation points from files that are arrays of ten-element arrays, as named columns."""
    return points_of(_documents(spark, path))


def points_of(docs: DataFrame) -> DataFrame:
    """Points of JSON documents (``table_id``, ``value``). An array is cut into its elements, so what stands before the end of a
    cut file counts; the cut-off tail, and elements that are no points, keep their text in ``_corrupt_record``."""
    found = walk_records(docs.withColumn("value", F.col("value").cast("binary")), _elements,
                         StructType.fromDDL("point array<string>, element binary, rest binary"), ("table_id",), "value")
    text = F.col("element").cast("string")
    point = F.coalesce(F.col("point"), F.from_json(text, "array<string>"))
    rows = found.select("table_id", point.alias("p"), F.coalesce(F.col("rest").cast("string"), F.when(point.isNull(), text)).alias("_corrupt_record"))
    types = {
        "left": "int", "topleft": "int", "top": "int", "from_left": "boolean", "true_pred": "int",
        "blk": "int", "ac_pred": "string", "mx": "int", "my": "int", "frame": "string",
    }
    return rows.select(
        "table_id", *[F.get("p", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(types.items())],
        "_corrupt_record",
    )


def codes_from_text(df: DataFrame, text: str = "value", pattern: str | None = None) -> DataFrame:
    """Entries of a code table found in text: code, a, b (the three groups of ``pattern``), next to the row's other columns."""
    pattern = pattern or text_entry()
    found = F.arrays_zip(*[
        F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i)).alias(n)
        for i, n in ((1, "code"), (2, "a"), (3, "b"))
    ])
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.explode(found).alias("e")).select(
        *keep, F.col("e.code").alias("code"), F.col("e.a").cast("int").alias("a"), F.col("e.b").cast("int").alias("b")
    )


def from_base64(col: Column) -> Column:
    """Packet bytes from a base64 literal."""
    return F.unbase64(col)


def from_hex(col: Column) -> Column:
    return F.unhex(col)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("container",), mode: str = "error") -> None:
    """Parquet dataset, partitioned by those of ``partition_by`` the table has."""
    by = [c for c in partition_by if c in df.columns]
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def codes_json(codes: DataFrame) -> DataFrame:
    """One canonical JSON object {code: symbol} per table, ordered by (length, code)."""
    entry = F.struct(F.length("code").alias("n"), "code", F.col("symbol").cast("string").alias("symbol"))
    ordered = F.array_sort(F.collect_list(entry))
    pairs = F.transform(ordered, lambda e: F.struct(e["code"], e["symbol"]))
    unique = codes.groupBy("table_id", "code").agg(F.min("symbol").alias("symbol"))
    return unique.groupBy("table_id").agg(F.to_json(F.map_from_entries(pairs)).alias("value"))


def write_codes(codes: DataFrame, path: str, mode: str = "error") -> None:
    """Code tables as canonical JSON text, one folder per table."""
    codes_json(codes).write.mode(mode).partitionBy("table_id").text(path)
