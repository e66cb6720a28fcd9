"""Files read in ranges give what one walk over the whole file gives."""

import random

import builders as B
import pytest
from cinelake.sources import asf, avi, media, ranged
from test_records import VIDS, containers, rows_of


def noisy_avi(seed, n=40):
    """Chunks whose payloads hold chunk headers of their own, a grouping list, other streams, and one chunk over several ranges."""
    rng = random.Random(seed)
    fake = B.chunk(b"00dc", b"\x01" * 6) * 20
    chunks = []
    for i in range(n):
        body = rng.choice([rng.randbytes(rng.randrange(60)), fake, fake[3:], b"LIST" * 9, b"00dc\xff\xff\xff\x7f" * 3, b""])
        chunks.append(B.chunk(rng.choice([b"00dc", b"00db", b"01wb", b"JUNK", b"????"]), body))
    chunks.insert(n // 2, B.chunk(b"00dc", fake * 6))
    chunks.insert(n // 3, B.chunk(b"LIST", b"rec " + B.chunk(b"00dc", b"in a list")))
    return B.avi(VIDS, b"".join(chunks))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("ranged")
    noisy = [noisy_avi(i) for i in range(3)]
    wmv = B.asf_file([B.packet([B.frag(obj=i % 7, size=5, body=b"hello")], 64) for i in range(40)], 64)
    contents = [c for c in containers() if c is not None] + noisy + [noisy[0][:-700], wmv, wmv[:-10], b""]
    for i, c in enumerate(contents):
        (base / f"{i:02d} name.bin").write_bytes(c)
    return str(base)


@pytest.mark.parametrize("range_bytes", [700, 2500])
def test_ranges_equal_the_whole_walk(spark, folder, range_bytes):
    whole = media.media_files(spark, folder)
    ranges = ranged.file_ranges(ranged.list_files(spark, folder), range_bytes)
    assert ranges.groupBy("file_id").count().filter("count >= 3").count() >= 3
    for stream_no, payload in ((-1, True), (None, False)):
        got = ranged.ranged_packets(ranges, payload, stream_no)
        assert rows_of(got) == rows_of(avi.avi_packets(whole, payload, stream_no))
        got = ranged.ranged_fragments(ranges, payload, stream_no)
        assert rows_of(got) == rows_of(asf.asf_fragments(whole, stream_no, payload))


def test_a_size_limit_ends_the_file_in_all_ranges(spark, folder):
    ranges = ranged.file_ranges(ranged.list_files(spark, folder), 1500)
    want = avi.avi_packets(media.media_files(spark, folder), max_size=2000)
    assert rows_of(ranged.ranged_packets(ranges, max_size=2000)) == rows_of(want)


def test_streams_read_only_headers(spark, folder):
    files = media.media_files(spark, folder)
    got = ranged.ranged_streams(ranged.list_files(spark, folder))
    columns = sorted(set(avi.avi_streams(files).columns) & set(asf.asf_streams(files).columns))
    want = avi.avi_streams(files).select(columns).unionByName(asf.asf_streams(files).select(columns))
    assert rows_of(got, columns) == rows_of(want, columns)


def test_no_files_and_bad_sizes(spark, folder):
    none = ranged.list_files(spark, folder).filter("length < 0")
    assert ranged.ranged_packets(ranged.file_ranges(none)).count() == 0
    with pytest.raises(ValueError):
        ranged.file_ranges(none, 0)


def test_file_bytes_slices_like_bytes(tmp_path):
    data = random.Random(5).randbytes(1000)
    path = tmp_path / "x"
    path.write_bytes(data)
    with ranged.open_path(f"file:{path}") as f:
        view = ranged.FileBytes(f, len(data), block=64)
        rng = random.Random(6)
        for _ in range(500):
            a, b = rng.randrange(1100), rng.randrange(1100)
            assert view[a:b] == data[a:b]
        assert view[:4] == data[:4] and view[990:] == data[990:] and len(view) == 1000 and len(view.blocks) <= ranged.BLOCKS_KEPT
