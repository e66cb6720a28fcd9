"""Files read in byte ranges: several tasks walk one file, which may be larger than a row can be.

``binaryFile`` rows hold whole files, 2 GB at most. Here Spark only lists the files; a row is a range of one, and a task reads
that range by blocks. ASF packets have one size, so a range knows where its packets start. AVI chunks only follow from the one
before: a range guesses the first chunk header in it, and the guesses are then held against where the walk of the ranges
before really ends. Ranges that guessed wrongly are walked again from the right place, until all agree; the result is
always that of one walk from front to back.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinelake.operators.lookup import lookup_join
from cinelake.session import saved
from cinelake.sources import asf, avi
from cinelake.sources.walk import walk_records

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
BLOCKS_KEPT = 4
#: Chunk headers in a row that make a guess; a wrong one costs a second walk of its range, never a row.
GUESS_HEADERS = 64
MOST_TASKS = 20_000
_KEY = ["file_id", "range_no"]

# fixed values: chunk ids of media lists
_CHUNK_ID = re.compile(rb"[0-9]{2}[a-z]{2}|ix[0-9]{2}|LIST|JUNK|rec ")
_ANY_CHUNK_ID = re.compile(rb"(?=" + _CHUNK_ID.pattern + rb")")

Opener = Callable[[str], BinaryIO]


def open_path(path: str) -> BinaryIO:
    """A seekable file for a path as Spark gives it: local ones by themselves, others through Arrow's file systems."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_file(name)


class FileBytes:
    """A file that is sliced like bytes; the blocks a slice needs are read when it is asked for."""

    def __init__(self, file: BinaryIO, size: int, block: int = BLOCK_BYTES):
        self.file, self.size, self.block = file, size, block
        self.blocks: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self.size

    def _read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(stop - start)

    def _block(self, n: int) -> bytes:
        if n not in self.blocks:
            self.blocks[n] = self._read(n * self.block, min((n + 1) * self.block, self.size))
            if len(self.blocks) > BLOCKS_KEPT:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(n)
        return self.blocks[n]

    def __getitem__(self, key: slice) -> bytes:
        start, stop, _ = key.indices(self.size)
        if stop <= start:
            return b""
        first, last = start // self.block, (stop - 1) // self.block
        if last - first > 1:
            return self._read(start, stop)
        found = self._block(first) if first == last else self._block(first) + self._block(last)
        return found[start - first * self.block : stop - first * self.block]


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under ``path``: file_id, path, length. Nothing of them is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.xxhash64("path").alias("file_id"), "path", "length")


def file_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of files (file_id, path, length), dealt over tasks: range_no, start, stop beside them. Empty files have none."""
    if range_bytes < 1:
        raise ValueError("a range has at least one byte")
    n = F.ceil(F.col("length") / range_bytes).cast("int")
    start = F.col("range_no").cast("bigint") * range_bytes
    cut = files.filter("length > 0").select("file_id", "path", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("range_no"))
    ranges = cut.withColumns({"start": start, "stop": F.least(start + range_bytes, F.col("length"))})
    return _dealt(ranges)


def _dealt(ranges: DataFrame) -> DataFrame:
    """A range's row is thin, so adaptive execution would put all of them into one task; a number given is kept.

    Every ``RANGE_BYTES`` of all ranges make a task, and smaller tables fill the cores.
    """
    n, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(n, max(cores, -(-size // RANGE_BYTES)), MOST_TASKS)), *_KEY)


def _first_header(data: FileBytes, start: int, stop: int, end: int) -> int | None:
    """The first place in a range from which well-formed chunk headers follow each other."""
    refuted: set[int] = set()
    for low in range(start, stop, data.block):
        for m in _ANY_CHUNK_ID.finditer(data[low : min(low + data.block, stop) + 3]):
            at, chain = low + m.start(), []
            while at < stop and at + 8 <= end and len(chain) < GUESS_HEADERS:
                if at in refuted or not _CHUNK_ID.fullmatch(data[at : at + 4]):
                    refuted.update(chain)
                    break
                chain.append(at)
                at = avi.chunk_end(data, at)
                if at > end + 1:  # runs out of the media list: only a cut-off last chunk does, which the next turn finds
                    refuted.update(chain)
                    break
            else:
                if chain:
                    return chain[0]
    return None


def _span(*more: str) -> F.Column:
    return F.struct("path", "length", "start", "stop", *more).alias("span")


def _opened(span: dict, opener: Opener) -> FileBytes:
    return FileBytes(opener(span["path"]), span["length"])


def ranged_streams(files: DataFrame, opener: Opener = open_path) -> DataFrame:
    """One row per AVI or ASF file, as ``avi_streams`` and ``asf_streams`` give them; only the header's blocks are read."""

    def walk(span: dict) -> Iterator[tuple]:
        data = _opened(span, opener)
        with data.file:
            yield from avi._describe(data)
            for *common, packet_size, data_offset, status in asf._describe(data):
                yield (*common, None, None, status)

    spans = file_ranges(files, 1 << 62).select("file_id", _span())
    return avi.finish_streams(walk_records(spans, walk, StructType.fromDDL(avi.STREAM_FIELDS), ("file_id",), "span"))


def ranged_fragments(ranges: DataFrame, with_payload: bool = False, stream_no: int | None = -1, opener: Opener = open_path) -> DataFrame:
    """Fragments of the ASF files of ``file_ranges``, as ``asf_fragments`` gives them. A packet belongs to the range it starts in."""

    def walk(span: dict) -> Iterator[tuple]:
        data = _opened(span, opener)
        with data.file:
            yield from asf._fragment_walk(stream_no, with_payload, span["start"], span["stop"])(data)

    out = walk_records(ranges.select("file_id", _span()), walk, StructType.fromDDL(asf.FRAGMENT_FIELDS), ("file_id",), "span")
    return out if with_payload else out.drop("payload")


_RANGE = "media_start bigint, media_end bigint, entry bigint, exit bigint, packets bigint"


def _walked(ranges: DataFrame, turn: int, stream_no: int | None, with_payload: bool, max_size: int | None, opener: Opener) -> DataFrame:
    """Walk AVI ranges from ``entry``, or from a guess in turn 0: packets, and a row of where each range was entered and left."""

    def walk(span: dict) -> Iterator[tuple]:
        data = _opened(span, opener)
        with data.file:
            media, wanted = avi.media_list(data, stream_no)
            if media is None:
                return
            (first, end), start, stop = media, span["start"], span["stop"]
            entry, leave, n = span["entry"], None, 0
            if turn == 0 and start <= first < stop:
                entry = first
            elif turn == 0 and first < start < end:
                entry = _first_header(data, start, stop, end)
            if entry is not None:
                packets = avi.media_packets(data, entry, end, stop, wanted, with_payload, max_size)
                while True:
                    try:
                        packet = next(packets)
                    except StopIteration as done:
                        leave = done.value
                        break
                    yield None, packet
                    n += 1
            yield (first, end, entry, leave, n), None

    schema = StructType().add("walked", StructType.fromDDL(_RANGE)).add("packet", StructType.fromDDL(avi.PACKET_FIELDS))
    found = walk_records(ranges.select(*_KEY, _span("entry")), walk, schema, _KEY, "span")
    return saved(found.withColumn("turn", F.lit(turn)), "ranges")


def _placed(walks: DataFrame, ranges: DataFrame) -> DataFrame:
    """The last walk of every range, with the entry it should have had and the packets of the ranges before it.

    A file's ranges are rows of one window: one for every ``RANGE_BYTES`` of it.
    """
    last = walks.filter("walked IS NOT NULL").groupBy(*_KEY).agg(F.max("turn").alias("turn"), F.max_by("walked", "turn").alias("w"))
    rows = last.select(*_KEY, "turn", "w.*").join(ranges.select(*_KEY, "path", "length", "start", "stop"), _KEY)
    before = Window.partitionBy("file_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda c: (c >= F.col("start")) & (c < F.col("stop"))
    first, reached = F.col("media_start"), F.max("exit").over(before)
    due = F.when(inside(first), first).when(inside(reached) & (reached + 8 <= F.col("media_end")), reached)
    return rows.withColumns({"due": due, "before": F.coalesce(F.sum("packets").over(before), F.lit(0))})


def ranged_packets(ranges: DataFrame, with_payload: bool = False, stream_no: int | None = avi.VIDEO_STREAM, max_size: int | None = None,
                   opener: Opener = open_path) -> DataFrame:
    """Packets of the AVI files of ``file_ranges``, as ``avi_packets`` gives them.

    A chunk belongs to the range its header starts in and is read to its end, so one may be larger than a range. Each turn
    puts at least the first wrong range of a file right; with chunks smaller than ranges one or two turns do.
    """
    ranges = saved(ranges, "file-ranges")
    start = _dealt(ranges.withColumn("entry", F.lit(None).cast("bigint")))
    walks = _walked(start, 0, stream_no, with_payload, max_size, opener)
    turn = 0
    while True:
        placed = saved(_placed(walks, ranges), "placed-ranges")
        wrong = placed.filter(~F.col("due").eqNullSafe(F.col("entry"))).withColumn("entry", F.col("due"))
        if wrong.isEmpty():
            break
        turn += 1
        walks = walks.unionByName(_walked(_dealt(wrong), turn, stream_no, with_payload, max_size, opener))
    valid = placed.filter("packets > 0").select(*_KEY, "turn", "before")
    kept = lookup_join(walks.filter("packet IS NOT NULL"), valid, [*_KEY, "turn"])
    out = kept.select("file_id", "packet.*", "before").withColumn("seq", F.col("seq") + F.col("before")).drop("before")
    return out if with_payload else out.drop("payload")
