import os
import random

import pandas as pd

import builders as B
from cinelake.operators import frames as FR
from cinelake.operators import reassembly as R
from cinelake.sources import avi, media
from cinelake.streaming import gops, ingest, reassembly
from cinelake.streaming.run import drain
from test_reassembly import SCHEMA as FRAGMENTS
from test_reassembly import make
from test_scan import SCHEMA as FRAMES
from test_scan import make_frames


def staged(spark, rows, schema, path, parts):
    """Write the parts one after another, so that the file source takes them in this order."""
    path = str(path)
    for n, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if os.path.getmtime(full) > 2e6:
                os.utime(full, (1e6 + n, 1e6 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_gops_equal_batch_twin(spark, tmp_path):
    rows = make_frames(7, 60)
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    stream = staged(spark, rows, FRAMES, tmp_path / "in", [order[:50], order[50:60], order[60:]])
    got = drain(gops.stream_gops(stream), "gops")
    cols = gops.OUTPUT.names
    want = FR.track(spark.createDataFrame(rows, FRAMES)).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))


def test_reassembly_equals_batch_twin(spark, tmp_path):
    rows = make(5, True)
    order = sorted(range(len(rows)), key=lambda i: rows[i][1:3])
    n = len(order)
    stream = staged(spark, rows, FRAGMENTS, tmp_path / "in", [order[: n // 3], order[n // 3 : n // 2], order[n // 2 :]])
    got = drain(reassembly.stream_reassemble(stream), "objects")
    cols = ["file_id", "object_no", "episode", "emit_packet", "emit_payload", "payload", "size"]
    want = R.reassemble(spark.createDataFrame(rows, FRAGMENTS), reuse=True).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))


class FakeState:
    def __init__(self):
        self.value, self.items, self.timers = None, [], set()

    def getValueState(self, *_):  # one object plays the handle and both states
        return FakeState()

    getListState = getValueState

    def get(self):
        return iter(self.items) if self.items else self.value

    def update(self, value):
        self.value = value

    def appendList(self, values):
        self.items += values

    def clear(self):
        self.items = []

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_eviction():
    """A stream with timers never drains, so the processor is driven by hand."""
    clock = FakeState()
    a = reassembly.Assembler(ttl_ms=50)
    a.init(clock)
    columns = ["packet_no", "payload_no", "offset", "object_size", "payload"]
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=columns)])
    assert list(a.handleInputRows((1, 7), frame((0, 0, 0, 10, b"abc")), clock)) == []
    assert clock.timers == {1050}
    gone = list(a.handleExpiredTimer((1, 7), clock, None))[0].iloc[0]
    assert (gone["status"], gone["size"], gone["episode"]) == ("evicted", 3, 0)
    done = list(a.handleInputRows((1, 7), frame((1, 0, 0, 2, b"de")), clock))[0].iloc[0]
    assert (done["status"], done["payload"], done["episode"]) == ("complete", b"de", 1)


def test_packets_equal_batch_twin(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        movi = b"".join(B.chunk(b"00dc", bytes([i, k] * (k + 1))) for k in range(4))
        (tmp_path / "in" / f"{i}.avi").write_bytes(B.avi(B.strl(fmt=B.strf(8, 8)), movi))
    path = str(tmp_path / "in")
    got = drain(ingest.stream_packets(spark, path, with_payload=True, max_files_per_trigger=2), "packets")
    want = avi.avi_packets(media.media_files(spark, path), with_payload=True)
    assert got.count() == 12
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
