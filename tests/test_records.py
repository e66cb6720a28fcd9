"""One walk over containers, and streams of whole files and of frames as micro-batches."""

import random

import builders as B
from cinelake.operators import frames as FR
from cinelake.session import shared_dir
from cinelake.sources import asf, avi
from cinelake.sources.records import media_records
from cinelake.streaming import frames as SF
from cinelake.streaming import gops
from test_scan import SCHEMA as FRAMES
from test_scan import make_frames
from test_streaming import staged

FILES = "file_id long, content binary"
VIDS = B.strl(handler=b"DIV3", fmt=B.strf(96, 64, b"DIV3"))
SOUND = B.strl(kind=b"auds", handler=b"\0\0\0\0")


def containers():
    index = B.chunk(b"idx1", b"01dc" + B.le(16, 4) + B.le(4, 4) + B.le(3, 4) + b"00wb" + B.le(0, 4) + B.le(16, 4) + B.le(2, 4))
    second = B.avi(SOUND + VIDS, B.chunk(b"01dc", b"\x08abc") + B.chunk(b"00wb", b"so") + B.chunk(b"01dc", b"\x48d"), tail=index)
    first = B.avi(VIDS, B.chunk(b"00dc", b"\x09xyz" * 5) + B.chunk(b"00dc", b"") + B.chunk(b"00dc", b"\x49"))
    wmv = B.asf_file([B.packet([B.frag(size=5, body=b"hello")], 64), B.packet([B.frag(obj=1, size=3, body=b"abc"), B.frag(2, obj=9, size=1, body=b"z")], 64)], 64)
    return [first, second, wmv, b"junk", None, first[:-3], b"RIFF\0\0\0\0AVI "]


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


def test_views_equal_the_single_walks(spark):
    files = spark.createDataFrame(list(enumerate(containers())), FILES)
    for stream_no in (-1, None, 0, 1):
        walked = media_records(files, with_payload=True, stream_no=stream_no)
        assert rows_of(walked.packets) == rows_of(avi.avi_packets(files, True, stream_no))
        assert rows_of(walked.fragments) == rows_of(asf.asf_fragments(files, stream_no))
    assert rows_of(walked.index) == rows_of(avi.avi_index(files))
    common = sorted(set(avi.avi_streams(files).columns) & set(asf.asf_streams(files).columns))
    single = avi.avi_streams(files).select(common).unionByName(asf.asf_streams(files).select(common))
    assert rows_of(walked.streams.select(common)) == rows_of(single)
    thin = media_records(files)
    assert "payload" not in thin.packets.columns + thin.fragments.columns


def test_the_video_stream_comes_from_the_header(spark):
    files = spark.createDataFrame(list(enumerate(containers()[:2])), FILES)
    got = {r.file_id: (r.chunk_id, r.size) for r in avi.avi_packets(files).filter("seq = 0").collect()}
    assert got == {0: ("00dc", 20), 1: ("01dc", 4)}
    frames = FR.frames_table(avi.avi_packets(files), avi.avi_streams(files)).collect()
    assert sorted((r.file_id, r.seq, r.frame_type) for r in frames) == [(0, 0, "I"), (0, 1, "P"), (1, 0, "I"), (1, 1, "P")]


def test_all_views_walk_a_file_once(spark):
    walked_files = spark.sparkContext.accumulator(0)
    content = containers()[1]

    def counted(batches):
        for batch in batches:
            walked_files.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([(i, content) for i in range(20)], FILES).mapInArrow(counted, FILES)
    walked = media_records(files)
    frames = FR.frames_table(walked.packets, walked.streams, written=True)
    assert frames.count() == 40 and walked.index.count() == 40 and walked_files.value == 20


def test_stream_of_files_equals_batch(spark, tmp_path):
    rows = [(i, c) for i, c in enumerate(containers() * 3)]
    parts = [range(0, 8), range(8, 9), range(9, len(rows))]
    base = shared_dir(spark, "frames")
    got = SF.stream_frames(staged(spark, rows, FILES, tmp_path / "in", parts), "frames", base)
    files = spark.createDataFrame(rows, FILES)
    want = FR.frames_table(*SF._sources(files))
    columns = ["file_id", "seq", "frame_type", "header", "gop_id", "p_index", "ref_seq", "status"]
    assert rows_of(got, columns) == rows_of(want, columns) and want.count() > 10
    assert got.select("batch").distinct().count() == 3 if "batch" in got.columns else True


def test_tracked_batches_equal_batch_twin(spark, tmp_path):
    rows = make_frames(7, 60)
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    parts = [order[:50], order[50:60], order[60:100] + order[:5], order[100:]]
    got = SF.track_batches(staged(spark, rows, FRAMES, tmp_path / "in", parts), "gops")
    columns = gops.OUTPUT.names
    want = FR.track(spark.createDataFrame(rows, FRAMES)).select(*columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_tracking_goes_on_where_it_stopped(spark, tmp_path):
    rows = [r for r in make_frames(3, 40) if r[0] == make_frames(3, 40)[0][0]]
    half = len(rows) // 2
    base = shared_dir(spark, "gops")
    SF.track_batches(staged(spark, rows, FRAMES, tmp_path / "in", [range(half)]), "gops", base)
    got = SF.track_batches(staged(spark, rows, FRAMES, tmp_path / "in", [range(half, len(rows))]), "gops", base)
    columns = gops.OUTPUT.names
    assert rows_of(got, columns) == rows_of(FR.track(spark.createDataFrame(rows, FRAMES)).select(*columns), columns)


def test_streams_of_avi_files_fold_no_objects_and_stage_by_input(spark, sf_dir, monkeypatch):
    from cinelake.plans import containers as C

    assert SF._sources(C.avi_files(spark, sf_dir))[3] and not SF._sources(C.wmv_files(spark, sf_dir))[3]
    paths = []
    monkeypatch.setattr(C, "shared_dir", lambda *a: paths.append(shared_dir(*a)) or paths[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "16k")
        assert C.stream_files(spark, sf_dir).count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    staged = spark.read.parquet(paths[0]).inputFiles()
    assert len(staged) > C.STAGED_FILES
