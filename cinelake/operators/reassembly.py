"""Media objects from their fragments.

An object is complete once its fragments' bytes add up to its declared size (duplicates count);
fragments are then put in offset order (arrival breaks ties) and cut to that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cinelake.operators.lookup import lookup_join, shuffled
from cinelake.operators.scan import CHUNK_ROWS, Running, chunk_of, ordered_scan
from cinelake.session import saved

OBJECT = ["file_id", "object_no"]
ARRIVAL = ["packet_no", "payload_no"]
# bytes of an object that picture headers need
HEAD_BYTES = 12
# data packets per chunk of the narrow scans; a packet holds at most 63 payloads
CHUNK_PACKETS = CHUNK_ROWS // 64
# reused numbers share out a file's packets, so a piece of one number spans more of them
PIECE_PACKETS = 1 << 18


def _arrival() -> Column:
    return F.struct(*ARRIVAL)


def object_status(fragments: DataFrame, chunk_packets: int = CHUNK_PACKETS) -> DataFrame:
    """Per object: bytes seen, declared size (the latest one stated), completeness, last needed fragment.

    Reads no payloads; the few numbers per fragment are written out once, because ``fragments`` may come
    straight from a walk through whole files. Totals are a plain aggregate. ``cut`` is null unless the bytes
    exceed the size; fragments after it in (offset, arrival) order add nothing to the object. Only such
    objects, of which a sound file has none, are scanned in order.
    """
    narrow = saved(fragments.select(*OBJECT, *ARRIVAL, "offset", "object_size", "size"), "fragment-sizes")
    order = ["offset", *ARRIVAL]
    stated = F.when(F.col("object_size") > 0, F.struct(*ARRIVAL, F.col("object_size")))
    totals = saved(narrow.groupBy(*OBJECT).agg(
        F.count(F.lit(1)).alias("fragments"),
        F.sum(F.col("size").cast("bigint")).alias("bytes"),
        F.max(stated)["object_size"].alias("object_size"),
        F.max(_arrival()).alias("completed"),
    ), "objects")
    over = totals.filter("bytes > object_size").select(*OBJECT, F.col("object_size").alias("final_size"))
    ranked = ordered_scan(
        lookup_join(narrow, over, OBJECT),
        OBJECT,
        order,
        {"start": Running("sum_before", F.col("size").cast("bigint"))},
        chunk=[F.col("offset"), chunk_of("packet_no", chunk_packets)],
    )
    last = ranked.filter("start < final_size").groupBy(*OBJECT).agg(F.max(F.struct(*order)).alias("last"))
    return totals.join(shuffled(last), OBJECT, "left").select(
        *OBJECT,
        "fragments",
        "bytes",
        "object_size",
        F.coalesce(F.col("bytes") >= F.col("object_size"), F.lit(False)).alias("complete"),
        F.when(F.col("bytes") > F.col("object_size"), F.col("last")).alias("cut"),
        "completed",
    )


def _assemble(fragments: DataFrame, keys: list[str], size: Column, extra: list[Column] = ()) -> DataFrame:
    """Concatenate each group's payloads in (offset, arrival) order and cut to the size.

    Groups hold only the bytes an object needs, so none outgrows its declared size by more than a
    fragment. Zero-length fragments carry nothing and are left out.
    """
    joined = F.expr("listagg(payload) WITHIN GROUP (ORDER BY offset, packet_no, payload_no)")
    return (
        fragments.filter(F.col("size") > 0)
        .groupBy(*keys)
        .agg(joined.alias("payload"), size.alias("_size"), *extra)
        .withColumn("payload", F.substring(F.col("payload"), F.lit(1), F.col("_size").cast("int")))
        .withColumn("size", F.octet_length("payload"))
        .drop("_size")
    )


def reassemble(fragments: DataFrame, reuse: bool = False, chunk_packets: int | None = None) -> DataFrame:
    """Complete objects: file_id, object_no, payload, size.

    With ``reuse`` an object number may name a new object once the previous one is complete; rows
    then also carry ``episode`` (the n-th object of that number) and ``emit_packet`` /
    ``emit_payload``, the arrival that completed it, which is the output order.
    """
    if reuse:
        return _reassemble_reused(fragments, chunk_packets or PIECE_PACKETS)
    status = object_status(fragments, chunk_packets or CHUNK_PACKETS)
    # Only objects that do not come out exact need a rule of their own: incomplete ones are dropped
    # and over-full ones cut before any payload is shuffled.
    odd = status.filter(~F.col("complete") | F.col("cut").isNotNull()).select(
        *OBJECT, F.col("complete"), F.col("cut"), F.col("object_size").alias("final_size")
    )
    tagged = lookup_join(fragments, odd, OBJECT, "left", computed=True)
    here = F.struct("offset", *ARRIVAL)
    kept = tagged.filter(
        F.coalesce(F.col("complete"), F.lit(True)) & (F.col("cut").isNull() | (here <= F.col("cut")))
    )
    size = F.coalesce(F.max("final_size"), F.max("object_size"))
    return _assemble(kept, OBJECT, size)


def incomplete(fragments: DataFrame, reuse: bool = False, chunk_packets: int | None = None) -> DataFrame:
    """Objects that never reached their size (or never stated one): fragments and bytes seen."""
    columns = [*OBJECT, "fragments", "bytes", "object_size"]
    if not reuse:
        return object_status(fragments, chunk_packets or CHUNK_PACKETS).filter(~F.col("complete")).select(*columns)
    open_ones = episodes(fragments, chunk_packets or PIECE_PACKETS).filter(~F.col("complete"))
    return open_ones.groupBy(*OBJECT, "episode").agg(
        F.count(F.lit(1)).alias("fragments"),
        F.sum("size").alias("bytes"),
        F.max(F.when(F.col("object_size") > 0, F.struct(*ARRIVAL, "object_size")))["object_size"].alias("object_size"),
    ).select(*columns)


def object_packets(fragments: DataFrame, chunk_packets: int = PIECE_PACKETS) -> DataFrame:
    """Complete objects as packets for ``frames_table``: file_id, seq, byte_offset, size, head.

    ``seq`` counts objects in the order in which they are completed; numbers may be reused. Needs each
    fragment's ``head`` (its first bytes), never a payload. An object has no one place in its file, so
    ``byte_offset`` is null.
    """
    done = episodes(fragments, chunk_packets).filter("complete")
    heads = fragments.select("file_id", *ARRIVAL, "offset", F.when(F.col("offset") < HEAD_BYTES, F.col("head")).alias("head"))
    objects = done.join(shuffled(heads), ["file_id", *ARRIVAL]).groupBy(*OBJECT, "episode").agg(
        F.expr("listagg(head) WITHIN GROUP (ORDER BY offset, packet_no, payload_no)").alias("head"),
        F.max("final_size").cast("int").alias("size"),
        F.max("emit.packet_no").alias("emit_packet"), F.max("emit.payload_no").alias("emit_payload"))
    numbered = ordered_scan(
        objects, ["file_id"], ["emit_packet", "emit_payload"], {"seq": Running("sum_before", F.lit(1).cast("bigint"))},
        chunk_rows=chunk_packets)
    return numbered.select(
        "file_id", "seq", F.lit(None).cast("bigint").alias("byte_offset"), "size",
        F.substring("head", 1, HEAD_BYTES).alias("head"))


@dataclass
class Pending:
    """Bookkeeping of the object currently open under one number. Holds no payload."""

    episode: int = 0
    bytes: int = 0
    declared: int = 0

    def add(self, size: int, object_size: int) -> int:
        """Count one fragment; returns the object's size when it completes it, else 0."""
        self.bytes += size
        if object_size > 0:
            self.declared = object_size
        if 0 < self.declared <= self.bytes:
            done = self.declared
            self.episode, self.bytes, self.declared = self.episode + 1, 0, 0
            return done
        return 0


_STATE = ["in_bytes", "in_declared"]
_FOLD_IN = [*OBJECT, "piece", *ARRIVAL, "object_size", "size", *_STATE]
_FOLDED = (
    StructType()
    .add("file_id", "long").add("object_no", "long").add("piece", "long")
    .add("packet_no", "long").add("payload_no", "integer").add("object_size", "long").add("size", "integer")
    .add("in_bytes", "long").add("in_declared", "long")
    .add("local", "long").add("done_size", "long").add("out_bytes", "long").add("out_declared", "long")
)
_PIECE = [*OBJECT, "piece"]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the objects of each piece of a sorted partition; state is three integers."""
    schema = to_arrow_schema(_FOLDED)
    key, pending = None, Pending()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        results: list[list[int]] = [[], [], [], []]
        names = (*_PIECE, "size", "object_size", *_STATE)
        for *here, size, object_size, in_bytes, in_declared in zip(*(batch.column(n).to_pylist() for n in names)):
            if here != key:
                key, pending = here, Pending(0, in_bytes, in_declared)
            local = pending.episode
            done = pending.add(size, object_size)
            for values, v in zip(results, (local, done, pending.bytes, pending.declared)):
                values.append(v)
        arrays = [batch.column(n).cast(schema.field(n).type) for n in _FOLD_IN]
        arrays += [pa.array(values, pa.int64()) for values in results]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _pieces(narrow: DataFrame, chunk_packets: int) -> DataFrame:
    """Cut each number's fragments into pieces of bounded length, where possible before an offset of 0:
    there an object most likely begins."""
    rows = narrow.withColumn("_chunk", chunk_of("packet_no", chunk_packets))
    starts = rows.groupBy(*OBJECT, "_chunk").agg(
        F.min(_arrival()).alias("_first"), F.min(F.when(F.col("offset") == 0, _arrival())).alias("_begin")
    )
    lowest = F.min("_chunk").over(Window.partitionBy(*OBJECT))
    start = F.when(F.col("_chunk") == lowest, F.col("_first")).otherwise(F.coalesce("_begin", "_first"))
    cut = starts.select(*OBJECT, "_chunk", start.alias("_start"))
    piece = F.when(_arrival() >= F.col("_start"), F.col("_chunk")).otherwise(F.col("_chunk") - 1)
    return rows.join(shuffled(cut), [*OBJECT, "_chunk"]).withColumn("piece", piece).drop("_chunk", "_start")


def _fold_pieces(rows: DataFrame) -> DataFrame:
    ordered = rows.select(*_FOLD_IN).repartition(*_PIECE).sortWithinPartitions(*_PIECE, *ARRIVAL)
    return saved(ordered.mapInArrow(_fold, _FOLDED), "episodes")


def episodes(fragments: DataFrame, chunk_packets: int = PIECE_PACKETS) -> DataFrame:
    """Which object each fragment belongs to when numbers are reused; no payloads.

    Where one object ends decides where the next begins, so a number's fragments are folded in
    arrival order - but not in one task. All pieces are folded at once, each as if an object began
    with it. Where the piece before in fact left an object open, the piece is folded again from that
    state, until every piece starts as the one before ended. Well-formed files need no second round;
    any file ends in the state a fold from front to back would give.
    """
    narrow = fragments.select(*OBJECT, *ARRIVAL, "offset", "object_size", "size")
    pieces = saved(_pieces(narrow, chunk_packets), "pieces")
    zero = F.lit(0).cast("bigint")
    folded = _fold_pieces(pieces.withColumns({"in_bytes": zero, "in_declared": zero}))
    run = Window.partitionBy(*OBJECT).orderBy("piece")
    while True:
        last = F.max(F.struct(*ARRIVAL, "out_bytes", "out_declared"))
        ends = folded.groupBy(*_PIECE).agg(
            last.alias("last"), F.sum((F.col("done_size") > 0).cast("bigint")).alias("objects"),
            *[F.max(c).alias(c) for c in _STATE],
        )
        chain = saved(ends.select(
            *_PIECE, *_STATE,
            F.coalesce(F.lag("last.out_bytes").over(run), zero).alias("want_bytes"),
            F.coalesce(F.lag("last.out_declared").over(run), zero).alias("want_declared"),
            F.coalesce(F.sum("objects").over(run.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("before"),
        ), "piece-states")
        stale = chain.filter(
            (F.col("in_bytes") != F.col("want_bytes")) | (F.col("in_declared") != F.col("want_declared"))
        ).select(*_PIECE, F.col("want_bytes").alias("in_bytes"), F.col("want_declared").alias("in_declared"))
        if stale.isEmpty():
            break
        again = _fold_pieces(lookup_join(pieces, stale, _PIECE))
        folded = saved(lookup_join(folded, stale.select(*_PIECE), _PIECE, "left_anti").unionByName(again), "episodes")
    numbered = folded.join(shuffled(chain.select(*_PIECE, "before")), _PIECE).withColumn("episode", F.col("local") + F.col("before"))
    per = numbered.groupBy(*OBJECT, "episode").agg(
        F.max("done_size").alias("final_size"), F.max(_arrival()).alias("emit")
    )
    return (
        numbered.select(*OBJECT, *ARRIVAL, "object_size", "size", "episode")
        .join(shuffled(per), [*OBJECT, "episode"])
        .withColumn("complete", F.col("final_size") > 0)
    )


def _reassemble_reused(fragments: DataFrame, chunk_packets: int) -> DataFrame:
    done = episodes(fragments, chunk_packets).filter("complete").select(
        "file_id", *ARRIVAL, "episode", "final_size",
        F.col("emit.packet_no").alias("emit_packet"), F.col("emit.payload_no").alias("emit_payload"),
    )
    tagged = fragments.join(shuffled(done), ["file_id", *ARRIVAL])
    emits = [F.max("emit_packet").alias("emit_packet"), F.max("emit_payload").alias("emit_payload")]
    return _assemble(tagged, [*OBJECT, "episode"], F.max("final_size"), emits)
