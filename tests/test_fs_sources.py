"""Byte-range chunk reader and shard discovery through the pyarrow filesystem layer."""

from tokenmill.sources import corpus as C
from tokenmill.sources import fs


def test_read_byte_chunks(spark, tmp_path):
    text = "abcdefghij" * 37 + "xyz"
    p = tmp_path / "big.txt"
    p.write_text(text)
    for start, end in [(0, None), (5, 200), (0, 90)]:
        got = sorted((r["chunk_idx"], r["text"]) for r in C.read_byte_chunks(spark, str(p), start, end, 64).collect())
        stop = len(text) if end is None else end
        want = [(i, text[start + i * 64: min(start + (i + 1) * 64, stop)]) for i in range((stop - start + 63) // 64)]
        assert got == want


def test_fs_uri_and_plain_paths(tmp_path):
    d = tmp_path / "d"
    fs.makedirs(str(d))
    for name in ["b.arrow", "a.arrow", "x.txt"]:
        with fs.open_output(str(d / name)) as f:
            f.write(b"1")
    assert [p.rsplit("/", 1)[-1] for p in fs.list_files(str(d))] == ["a.arrow", "b.arrow", "x.txt"]
    uri = "file://" + str(d)
    assert [p.rsplit("/", 1)[-1] for p in fs.list_files(uri)] == ["a.arrow", "b.arrow", "x.txt"]
    assert all(p.startswith("file://") for p in fs.list_files(uri))
    assert fs.exists(uri + "/a.arrow") and not fs.exists(uri + "/zzz")
