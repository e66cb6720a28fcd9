"""Packed files, cut observation files, and streams that go on from an earlier run."""

import hashlib
import json
import os

from cinelake.operators import reassembly as R
from cinelake.session import shared_dir
from cinelake.sources import packed
from cinelake.sources import tables as S
from cinelake.streaming import reassembly
from cinelake.streaming.run import drain

POINT = '["1","2","3","true","5","0","x","1","2","f]"]'


def test_packed_files_come_back_whole(spark):
    contents = {f"a/{i}.bin": os.urandom(i * 37 % 900) for i in range(200)} | {"empty": b"", "none": None, "é/long": b"0123456789" * 5000}
    files = spark.createDataFrame(list(contents.items()), "path string, content binary").repartition(5)
    path = shared_dir(spark, "packed")
    packed.write_packed(files, path, chunk_bytes=256)
    got = {r.path: (r.length, bytes(r.content)) for r in packed.read_packed(spark, path).collect()}
    assert got == {k: (len(v or b""), v or b"") for k, v in contents.items()}
    parts = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(parts) <= 4  # by bytes, not by names
    one = packed.read_packed(spark, path).filter("path = 'é/long'")
    assert "EqualTo(path,é/long)" in one._jdf.queryExecution().executedPlan().toString()
    assert [hashlib.md5(bytes(r.content)).hexdigest() for r in one.collect()] == [hashlib.md5(contents["é/long"]).hexdigest()]


def points(spark, values):
    docs = spark.createDataFrame(list(enumerate(values)), "table_id int, value string")
    out = {}
    for r in S.points_of(docs).collect():
        out.setdefault(r.table_id, []).append((r.left, r.frame, r._corrupt_record))
    return out


def test_points_before_a_cut_count(spark):
    whole = (1, "f]", None)
    got = points(spark, [
        f"[{POINT},{POINT}]", f"[{POINT}, {POINT},[\"7\",\"8\",\"cut", f"[{POINT},{POINT}", "[]", "[", "{\"a\": 1}", "", None, f"[{POINT}] tail",
        f"[{POINT}, 5, {POINT}]", f' [ {POINT}\n,\n{POINT} ]\n', f'[["1","2"],{{"a":[1]}},{POINT}]'])
    assert got[0] == [whole, whole] and got[10] == [whole, whole]
    assert got[1] == [whole, whole, (None, None, '["7","8","cut')]
    assert got[2] == [whole, whole, (None, None, "[")]
    assert 3 not in got and 7 not in got and got[4] == [(None, None, "[")]
    assert got[5] == [(None, None, '{"a": 1}')] and got[6] == [(None, None, "")]
    assert got[8] == [whole, (None, None, "tail")]
    assert sorted(got[11], key=str) == sorted([(1, None, None), (None, None, '{"a":[1]}'), whole], key=str)
    assert sum(x == whole for x in got[9]) == 1 and any(x[2] for x in got[9])  # an element that is no array is no point


def test_plain_points_need_no_parser(spark):
    """Strings that look like separators, escapes and odd bytes still go by nesting."""
    got = list(S._elements(b'[["a",""],["b"],["c",","],["],["],["d\\n"],["e'))
    assert got == [
        (["a", ""], None, None), (["b"], None, None), (None, b'["c",","]', None), (None, b'["],["]', None), (None, b'["d\\n"]', None),
        (None, None, b'["e')]
    assert list(S._elements(b'[["\xff"]]')) == [(None, b'["\xff"]', None)]
    plain = [[str(k), "2", "3", "false", "5", "0", "é", "1", "2", "f"] for k in range(3000)]
    found = points(spark, [json.dumps(plain, separators=(",", ":")), json.dumps(plain)])  # compact, then with blanks
    assert found[0] == found[1] == [(k, "f", None) for k in range(3000)]


def test_objects_span_runs_of_one_stream(spark, tmp_path):
    rows = [(1, p, 0, p % 2, 10 * (p // 2), 6, 2, bytes([65 + p] * 2)) for p in range(12)]
    schema = "file_id long, packet_no long, payload_no int, object_no long, offset long, object_size long, size int, payload binary"
    base, path = shared_dir(spark, "objects"), str(tmp_path / "in")
    for k in range(0, 12, 4):
        spark.createDataFrame(rows[k : k + 4], schema).write.mode("append").parquet(path)
        out = drain(reassembly.stream_reassemble(spark.readStream.schema(schema).parquet(path)), "objects", base)
    columns = ["object_no", "episode", "emit_packet", "payload"]
    want = R.reassemble(spark.createDataFrame(rows, schema), reuse=True).select(*columns).collect()
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, want)) and len(want) == 4
