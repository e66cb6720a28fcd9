"""Everything a container holds in one walk: stream headers, packets, index and fragments as tagged records.

Each file is read and walked once. The records are written once to the shared folder, and the tables that jobs work on are
column-pruned views of them, so no view walks a file again. Files that are no container give no records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinelake.session import saved
from cinelake.sources import asf, avi
from cinelake.sources.walk import walk_records

STREAM, PACKET, INDEX, FRAGMENT = "stream", "packet", "index", "fragment"

#: Fields of a stream record: those of AVI files, then those that only ASF files have.
_STREAM = f"{avi.STREAM_FIELDS}, packet_size bigint, data_offset bigint"
_FIELDS = {STREAM: _STREAM, PACKET: avi.PACKET_FIELDS, INDEX: avi.INDEX_FIELDS, FRAGMENT: asf.FRAGMENT_FIELDS}
_KINDS = list(_FIELDS)


def _schema() -> StructType:
    out = StructType().add("kind", "string")
    for kind, fields in _FIELDS.items():
        out.add(kind, StructType.fromDDL(fields))
    return out


def _tagged(kind: str, fields: tuple) -> tuple:
    return (kind, *(fields if k == kind else None for k in _KINDS))


def _walker(stream_no: int | None, with_payload: bool, max_size: int | None):
    packets = avi._packet_walk(stream_no, with_payload, max_size)
    fragments = asf._fragment_walk(stream_no, with_payload)

    def walk(data: bytes) -> Iterator[tuple]:
        if avi.is_avi(data):
            for row in avi._describe(data):
                yield _tagged(STREAM, (*row, None, None))
            for row in packets(data):
                yield _tagged(PACKET, row)
            for row in avi._index_blob(data):
                yield _tagged(INDEX, row)
            return
        for row in asf._describe(data):
            *common, packet_size, data_offset, status = row
            yield _tagged(STREAM, (*common, None, None, status, packet_size, data_offset))
        for row in fragments(data):
            yield _tagged(FRAGMENT, row)

    return walk


@dataclass(frozen=True)
class Records:
    """Views of one written walk."""

    table: DataFrame
    with_payload: bool

    def view(self, kind: str) -> DataFrame:
        out = self.table.filter(F.col("kind") == kind).select("file_id", f"{kind}.*")
        return out if self.with_payload or "payload" not in out.columns else out.drop("payload")

    @property
    def streams(self) -> DataFrame:
        """Stream headers, as ``avi_streams`` and ``asf_streams`` give them (both containers' columns)."""
        return avi.finish_streams(self.view(STREAM))

    @property
    def packets(self) -> DataFrame:
        """Packets of AVI files, as ``avi_packets`` gives them."""
        return self.view(PACKET)

    @property
    def index(self) -> DataFrame:
        """Index entries of AVI files, as ``avi_index`` gives them."""
        return avi.index_entries(self.view(INDEX))

    @property
    def fragments(self) -> DataFrame:
        """Fragments of ASF files, as ``asf_fragments`` gives them."""
        return self.view(FRAGMENT)


def media_records(files: DataFrame, with_payload: bool = False, stream_no: int | None = avi.VIDEO_STREAM,
                  max_size: int | None = None) -> Records:
    """Walk AVI and ASF files (file_id, content) once and write what they hold.

    ``stream_no`` is the stream whose packets or fragments count: the file's video stream by default, None for all.
    Payloads are left out unless asked for. Null contents give no records.
    """
    table = walk_records(files, _walker(stream_no, with_payload, max_size), _schema())
    return Records(saved(table, "records"), with_payload)
