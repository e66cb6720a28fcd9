"""Media objects assembled as their fragments arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from cinelake.operators.reassembly import Pending

OUTPUT = (
    StructType()
    .add("file_id", "long").add("object_no", "long").add("episode", "long")
    .add("emit_packet", "long").add("emit_payload", "integer")
    .add("payload", "binary").add("size", "integer").add("status", "string")
)


class Assembler(StatefulProcessor):
    """State per (file, object number): the open object's counters and its fragments.

    With a time limit, an object untouched for that long leaves with status ``evicted`` and no payload.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "episode bigint, bytes bigint, declared bigint, deadline bigint")
        self.parts = handle.getListState("parts", "offset bigint, packet_no bigint, payload_no int, payload binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved = self.open.get()
        pending = Pending(*saved[:3]) if saved else Pending()
        deadline = saved[3] if saved else 0
        arrived = []
        for pdf in rows:
            arrived += list(zip(pdf["packet_no"], pdf["payload_no"], pdf["offset"], pdf["object_size"], pdf["payload"]))
        arrived.sort(key=lambda a: a[:2])
        stored = saved is not None and pending.bytes > 0  # fragments of the open object already in state
        fresh, out = [], []
        for packet, number, offset, object_size, body in arrived:
            fresh.append((int(offset), int(packet), int(number), bytes(body)))
            episode = pending.episode
            done = pending.add(len(body), int(object_size))
            if done:
                parts = [tuple(p) for p in self.parts.get()] if stored else []
                stored = False
                self.parts.clear()
                parts = sorted(parts + fresh, key=lambda p: p[:3])
                payload = b"".join(bytes(p[3]) for p in parts)[:done]
                out.append((*key, episode, int(packet), int(number), payload, len(payload), "complete"))
                fresh = []
        fresh = [p for p in fresh if p[3]]
        if fresh:
            self.parts.appendList(fresh)
        if self.ttl_ms is not None:
            if deadline:
                self.handle.deleteTimer(deadline)
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms if pending.bytes else 0
            if deadline:
                self.handle.registerTimer(deadline)
        self.open.update((pending.episode, pending.bytes, pending.declared, deadline))
        if out:
            yield pd.DataFrame(out, columns=OUTPUT.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        saved = self.open.get()
        if saved and saved[1]:
            self.parts.clear()
            self.open.update((saved[0] + 1, 0, 0, 0))
            row = (*key, saved[0], None, None, None, saved[1], "evicted")
            frame = pd.DataFrame([row], columns=OUTPUT.names)
            yield frame.astype({"emit_packet": "Int64", "emit_payload": "Int32"})

    def close(self) -> None:
        pass


def stream_reassemble(fragments: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming twin of ``reassemble(fragments, reuse=True)``, plus a ``status``.

    Fragments of one micro-batch are taken in arrival order; an object may span any number of
    micro-batches. ``ttl_ms`` evicts objects that stay incomplete, which would otherwise stay in
    state for good.
    """
    typed = fragments.selectExpr(
        "file_id", "object_no", "packet_no", "payload_no", "offset", "object_size", "payload")
    return typed.groupBy("file_id", "object_no").transformWithStateInPandas(
        statefulProcessor=Assembler(ttl_ms), outputStructType=OUTPUT, outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
