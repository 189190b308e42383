import hashlib
import io
import struct
import zipfile

import pytest

from pyspark.sql import functions as F

from palimpsest.llm import warc, zips

ROWS = [
    (1, "http://a.example/", "x" * 1000),
    (2, "http://b.example/\r\n", "x" * 1000),
    (3, None, "x" * 999),
    (4, "u", "x" * 999),
    (5, "u", None),
    (6, "u", ""),
    (7, "u", "é" * 500 + "\r\n\r\nWARC/1.1"),
    (8, "u", "x" * 1000),
    (8, "u", "x" * 1000),
    (None, "u", "x" * 1000),
    (None, "u", "only " * 300),
    (9, "u", "long " * 400_000),
]


def brute(rows):
    best = {}
    for page_id, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if page_id is None else page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 1000 and (-1 if page_id is None else page_id) < best[html or ""]
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best[html or ""] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("zip64", "archive_bytes"), [(False, warc.ARCHIVE_BYTES), (True, 300)])
def test_round_trip(spark, zip64, archive_bytes):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    archives = warc.write(df, zip64=zip64, archive_bytes=archive_bytes)
    got = warc.read(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    for r in archives.collect():
        with warc.open_for_reading(r.path) as file, zipfile.ZipFile(io.BytesIO(file.read())) as other:
            assert other.testzip() is None and other.namelist() == [warc.DATA, warc.INDEX]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(df)).count() == 0


def test_reads_archives_of_another_writer():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as pack:
        pack.writestr("é.txt", b"stored bytes")
        pack.writestr("packed", b"z" * 99, zipfile.ZIP_DEFLATED)
        pack.comment = b"has " + zips.END + b" within" + bytes(30)
    reader = zips.Reader(raw, len(raw.getvalue()))
    member = reader.members["é.txt"]
    assert reader.whole(member) == b"stored bytes"
    assert reader.range_of(member, reader.start_of(member), 7, 5) == b"bytes"
    with pytest.raises(zips.FormatError):
        reader.start_of(reader.members["packed"])
    with pytest.raises(zips.FormatError):
        reader.range_of(member, reader.start_of(member), 8, 5)


def test_large_forms():
    raw = io.BytesIO()
    pack = zips.Writer(raw, zip64=True)
    pack.add("a", b"one")
    pack.add("b", b"two")
    pack.close()
    assert zips.END64 in raw.getvalue() and struct.pack("<I", zips.MOST32) in raw.getvalue()
    reader = zips.Reader(raw, len(raw.getvalue()))
    assert [reader.whole(m) for m in reader.members.values()] == [b"one", b"two"]


@pytest.mark.parametrize("cut", [0, 10, 50])
def test_cut_archives_are_refused(cut):
    raw = io.BytesIO()
    pack = zips.Writer(raw)
    pack.add("a", b"one")
    pack.close()
    data = raw.getvalue()[:-22][:cut] if cut else b""
    with pytest.raises(zips.FormatError):
        zips.Reader(io.BytesIO(data), len(data))


def test_archives_are_read_by_many_tasks(spark):
    rows = spark.createDataFrame([(i, f"http://h/{i}", "x" * 50 + str(i)) for i in range(64)], "page_id long, url string, html string").repartition(8)
    read = warc.read(warc.write(rows))
    assert len(read.select(F.spark_partition_id().alias("p")).distinct().collect()) > 1
    assert read.count() == 64
