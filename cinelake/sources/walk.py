"""Flat-map over BINARY rows for layouts whose next record starts where the previous one ends."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# an output batch closes at whichever limit comes first
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20


def _bytes_in(record: tuple) -> int:
    return sum(len(x) if isinstance(x, bytes) else _bytes_in(x) if isinstance(x, tuple) else 0 for x in record)


def walk_records(
    df: DataFrame,
    walk: Callable[[bytes], Iterable[tuple]],
    schema: StructType,
    keep: Sequence[str] = ("file_id",),
    content: str = "content",
) -> DataFrame:
    """Apply ``walk`` to each ``content`` value and emit its tuples next to the kept columns.

    ``walk`` sees one value at a time and yields tuples matching ``schema``; output leaves in small
    Arrow batches, so a long file never sits in Python as a whole table. Input batches are bounded by
    ``spark.sql.files.maxPartitionBytes`` of file content (or one larger file) when ``df`` is a file scan.
    """
    keep = list(keep)
    full = StructType([df.schema[k] for k in keep] + list(schema))
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(col, type=f.type) for col, f in zip(zip(*rows), arrow)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            kept = [batch.column(i) for i in range(len(keep))]
            values = batch.column(len(keep))
            for i in range(batch.num_rows):
                value = values[i].as_py()
                if value is None:
                    continue
                head = tuple(k[i].as_py() for k in kept)
                for record in walk(value):
                    rows.append(head + record)
                    size += _bytes_in(record) + 64
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    return df.select(*keep, content).mapInArrow(run, full)
