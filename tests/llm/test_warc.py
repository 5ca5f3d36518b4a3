"""ZIP-packaged WARC: round trips, ZIP64 directories, edge rows."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quillscope.llm import warc as WZ


def test_round_trip(spark):
    big, small_ = "é" * 60, "x" * 99
    rows = [(5, "u", big), (3, "u v\nw", big), (9, None, big), (None, "n", big), (7, "s", small_), (8, "s", small_), (1, "e", None), (2, "e", ""),
            (11, "k: v", "a: b\r\n\r\nc"), (12, "l", "long " * 100_000), (12, "l", "long " * 100_000), (None, "m", "null ids " * 20), (None, "m", "null ids " * 20)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in WZ.round_trip(pages).collect()), key=str)
    want = [(3, 120, "response", None), (5, 120, "revisit", 3), (9, 120, "revisit", 3), (None, 120, "revisit", 3)]
    want += [(7, 99, "response", None), (8, 99, "response", None), (1, 0, "response", None), (2, 0, "response", None), (11, 9, "response", None)]
    want += [(12, 500000, "response", None)] * 2 + [(None, 180, "response", None)] * 2
    assert got == sorted(want, key=str)
    assert WZ.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back_and_packages_roll(spark, monkeypatch, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    manifest = WZ.write_archives(pages, str(tmp_path))
    assert manifest.agg({"records": "sum"}).first()[0] == 60 and manifest.count() == 2
    with zipfile.ZipFile(manifest.first()["archive"].removeprefix("file:")) as z:  # an ordinary reader agrees
        assert z.testzip() is None and z.namelist() == [WZ.DATA, WZ.INDEX]
    got = {r["page"]: (r["url"], bytes(r["payload"]).decode()) for r in WZ.read_archives(manifest).collect()}
    assert got == {str(i): (u, h) for i, u, h in rows}


def _zip64(members):
    """A ZIP whose directory keeps every size, place and count in ZIP64 fields."""
    out, directory = io.BytesIO(), b""
    for name, data in members:
        at, n = out.tell(), name.encode()
        out.write(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(data), len(data), len(n), 3) + n + b"abc" + data)
        extra = struct.pack("<2H4s", 0x9999, 4, b"zzzz") + struct.pack("<2H3Q", 1, 24, len(data), len(data), at)
        directory += struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra), 2, 0, 0, 0, 0xFFFFFFFF) + n + extra + b"cc"
    at = out.tell()
    out.write(directory)
    end = out.tell()
    out.write(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), len(directory), at))
    out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
    comment = b"a comment with PK\x05\x06 inside"
    out.write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment)
    return out.getvalue()


def test_zip64_directory_is_read():
    raw = _zip64([("archive/é.bin", b"hello"), ("b", b"world!")])
    f = io.BytesIO(raw)
    members = WZ.central_directory(f, len(raw))
    assert [(m.name, m.size) for m in members] == [("archive/é.bin", 5), ("b", 6)]
    at = WZ.data_offset(f, members[1])
    assert raw[at : at + 6] == b"world!"


def test_bad_packages_are_errors():
    with pytest.raises(ValueError):
        WZ.central_directory(io.BytesIO(b"not a zip"), 9)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x", b"a" * 1000)
    raw = out.getvalue()
    (m,) = WZ.central_directory(io.BytesIO(raw), len(raw))
    with pytest.raises(ValueError):
        WZ.data_offset(io.BytesIO(raw), m)


def test_two_archives_and_other_index_names(tmp_path):
    import gzip

    parts = {"archive/a.warc.gz": b"first|second", "archive/b.warc.gz": b"third"}
    plain = b'com,h)/ 2024 {"offset": "0", "length": "5", "filename": "a.warc.gz"}\n{"offset": 6, "length": 6, "filename": "archive/a.warc.gz"}\n'
    packed = gzip.compress(b'{"offset": 0, "length": 5, "filename": "b.warc.gz"}\n')
    path = str(tmp_path / "two.wacz")
    with zipfile.ZipFile(path, "w") as z:
        for name, data in {**parts, "indexes/one.cdx": plain, "indexes/two.cdx.gz": packed, "indexes/two.idx": b'k {"offset": 0, "length": 9, "filename": "two.cdx.gz"}\n'}.items():
            z.writestr(name, data)
    raw = open(path, "rb").read()
    assert [raw[a : a + n] for a, n in WZ.locate(path)] == [b"first", b"second", b"third"]
    other = str(tmp_path / "other.wacz")
    for names in (["archive/x.warc.gz"], ["archive/x.warc.gz", "archive/y.warc.gz"]):
        with zipfile.ZipFile(other, "w") as z:
            for name in names:
                z.writestr(name, b"record")
            z.writestr("indexes/index.cdxj", b'{"offset": 2, "length": 4}')
        if len(names) == 1:
            assert [open(other, "rb").read()[a : a + n] for a, n in WZ.locate(other)] == [b"cord"]
        else:
            with pytest.raises(ValueError):
                list(WZ.locate(other))


def test_records_are_dealt_to_many_tasks_and_paths_are_qualified(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 40) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    manifest = WZ.write_archives(pages, str(tmp_path))
    (archive,) = [r["archive"] for r in manifest.collect()]
    assert archive.startswith("file:/")
    out = WZ.read_archives(manifest)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert out.select(F.spark_partition_id()).distinct().count() > 1 and out.count() == 300
    plain = spark.createDataFrame([(archive.removeprefix("file:"),)], "archive string")  # without a scheme: the default file system
    assert WZ.read_archives(plain).count() == 300
