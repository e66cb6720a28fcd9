"""Groups of pictures, references and bit rates tracked per stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_FRAME = ["seq", "frame_type", "status", "bit_rate"]
OUTPUT = (
    StructType()
    .add("file_id", "long").add("seq", "long").add("frame_type", "string").add("status", "string")
    .add("gop_id", "long").add("p_index", "long").add("no_rounding", "boolean")
    .add("bit_rate", "integer").add("ref_seq", "long")
)
_STATE = (
    "next_seq bigint, earliest bigint, gop_id bigint, distance bigint, bit_rate int, ref_seq bigint, decoded boolean"
)
_WAITING = "seq bigint, frame_type string, status string, bit_rate int"


def _int_or_none(v: Any) -> int | None:
    """A nullable integer column arrives as floats with NaN."""
    return None if v is None or pd.isna(v) else int(v)


class GopTracker(StatefulProcessor):
    """One small record per stream; frames ahead of the next expected ``seq`` wait in a list.

    The list is only appended to until the frame it waits for has come, then read once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", _STATE)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved = self.at.get()
        next_seq, earliest, gop, distance, rate, ref, decoded = saved if saved else (0, None, 0, 0, None, None, False)
        fresh = {}
        for pdf in rows:
            for seq, ftype, status, bit_rate in zip(*(pdf[c] for c in _FRAME)):
                fresh[int(seq)] = (ftype, status, _int_or_none(bit_rate))
        out = []
        while True:
            if earliest is not None and earliest <= next_seq:
                for seq, *frame in self.waiting.get():
                    fresh.setdefault(seq, tuple(frame))
                self.waiting.clear()
                earliest = None
            frame = fresh.pop(next_seq, None)
            if frame is None:
                break
            ftype, status, bit_rate = frame
            found = None
            if ftype == "I":
                gop, distance = gop + 1, 0
                rate = rate if bit_rate is None else bit_rate
            elif ftype == "P":
                distance += 1
                if decoded:
                    found = ref
                else:
                    status = "no_reference"
            index = distance if gop and ftype != "empty" else None
            rounding = None if index is None else index % 2 == 0
            out.append((key[0], next_seq, ftype, status, gop, index, rounding, rate, found))
            if status == "ok":
                decoded = decoded or ftype == "I"
                ref = next_seq
            next_seq += 1
        early = [(seq, *frame) for seq, frame in fresh.items() if seq > next_seq]  # earlier ones are repeats
        if early:
            self.waiting.appendList(early)
            first = min(e[0] for e in early)
            earliest = first if earliest is None else min(earliest, first)
        self.at.update((next_seq, earliest, gop, distance, rate, ref, decoded))
        if out:
            pdf = pd.DataFrame(out, columns=OUTPUT.names)
            nullable = {"p_index": "Int64", "bit_rate": "Int32", "ref_seq": "Int64", "no_rounding": "boolean"}
            yield pdf.astype(nullable)

    def close(self) -> None:
        pass


def stream_gops(frames: DataFrame) -> DataFrame:
    """Streaming twin of ``frames.track``: same columns, frames emitted in ``seq`` order per file.

    ``seq`` counts each file's frames from 0; a frame that arrives early waits until the ones before
    it are there. Needs file_id, seq, frame_type, status and bit_rate.
    """
    typed = frames.selectExpr("file_id", "seq", "frame_type", "status", "cast(bit_rate as int) bit_rate")
    return typed.groupBy("file_id").transformWithStateInPandas(
        statefulProcessor=GopTracker(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
