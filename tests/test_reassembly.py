import random

import pytest
from pyspark.sql import functions as F

from cinelake.operators import lookup
from cinelake.operators import reassembly as R

SCHEMA = ("file_id long, packet_no long, payload_no int, object_no long, offset long, object_size long, size int, "
          "payload binary")


def simulate(rows):
    """Arrival by arrival, one object number at a time."""
    pending, out = {}, []
    for f, pk, pl, obj, off, total, size, body in sorted(rows, key=lambda r: r[:3]):
        o = pending.setdefault((f, obj), [[], 0])
        o[0].append((off, bytes(body)))
        if total > 0:
            o[1] = total
        if o[1] and sum(len(b) for _, b in o[0]) >= o[1]:
            joined = b"".join(b for _, b in sorted(o[0], key=lambda x: x[0]))
            out.append((f, obj, (pk, pl), joined[: o[1]]))
            del pending[f, obj]
    return out, pending


def make(seed, reuse):
    rng = random.Random(seed)
    rows, packet = [], 0
    for f in range(2):
        for n in range(40):
            obj = rng.randrange(4) if reuse else n
            size = rng.randrange(1, 60)
            body = rng.randbytes(size)
            cuts = sorted({0, size, *[rng.randrange(size + 1) for _ in range(3)]})
            parts = [(a, body[a:b]) for a, b in zip(cuts, cuts[1:])]
            kind = rng.random()
            if kind < 0.2:
                parts.append(rng.choice(parts))  # duplicate
            elif kind < 0.35:
                parts.pop()  # never complete
            rng.shuffle(parts)
            for i, (off, b) in enumerate(parts):
                stated = size if i == 0 or rng.random() < 0.7 else 0
                rows.append((f, packet, rng.randrange(3), obj, off, stated, len(b), bytearray(b)))
                packet += 1
    return rows


def test_unique_numbers(spark):
    # every fragment belongs to the object, also those after completion
    rows = make(1, False)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, F.rand(2))
    groups = {}
    for r in sorted(rows, key=lambda r: r[:3]):
        groups.setdefault((r[0], r[3]), []).append(r)
    want, open_ = {}, set()
    for k, rs in groups.items():
        sizes = [r[5] for r in rs if r[5] > 0]
        total = sum(r[6] for r in rs)
        if sizes and total >= sizes[-1]:
            want[k] = b"".join(bytes(r[7]) for r in sorted(rs, key=lambda r: r[4]))[: sizes[-1]]
        else:
            open_.add(k)
    got = {(r.file_id, r.object_no): bytes(r.payload) for r in R.reassemble(df, chunk_packets=5).collect()}
    assert got == want
    left = R.incomplete(df, chunk_packets=5).collect()
    assert {(r.file_id, r.object_no) for r in left} == open_


@pytest.mark.parametrize("seed,chunk", [(2, 1 << 12), (3, 30)])
def test_reused_numbers(spark, seed, chunk):
    rows = make(seed, True)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, F.rand(2))
    want, pending = simulate(rows)
    got = R.reassemble(df, reuse=True, chunk_packets=chunk).orderBy("file_id", "emit_packet", "emit_payload").collect()
    assert [(r.file_id, r.object_no, (r.emit_packet, r.emit_payload), bytes(r.payload)) for r in got] == sorted(
        want, key=lambda w: (w[0], w[2]))
    left = {(r.file_id, r.object_no): (r.fragments, r.bytes) for r in R.incomplete(df, reuse=True, chunk_packets=chunk).collect()}
    assert left == {k: (len(v[0]), sum(len(b) for _, b in v[0])) for k, v in pending.items()}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_past_the_broadcast_limit(spark, how):
    probe = spark.range(200).select((F.col("id") % 7).alias("k"), "id")
    table = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, v string")
    small = sorted(map(tuple, lookup.lookup_join(probe, table, ["k"], how).collect()), key=str)
    large = lookup.lookup_join(probe, table, ["k"], how, max_rows=2)
    assert "Broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, large.collect()), key=str) == small
