"""WARC records in ZIP-packaged archives: written by the tasks that hold the pages, read by ranges.

An archive is a ZIP file of stored members: ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdxj``, a line for each record with its place. Reading parses the ZIP directory, then the index, and
fetches each record by its range; nothing is extracted.

Of equal payloads of at least ``revisit_bytes`` the one with the largest page_id is a response and the others are
revisits without payload. Payloads are equal if their length, SHA-1 and SHA-256 are: different ones with one SHA-1 are public. Only digests are
shuffled to find the groups of more than one; these come back by a join: payloads stay in their task as long as the table of groups
is small enough to be broadcast, and are shuffled once if not.

Archives go to the shared folder under names of their own; a table of those that were finished is written last, so
archives of lost or repeated tasks are never read.

Defined results: a null payload is empty; a null page_id is smaller than any other and its revisits refer to no page;
repeated rows of the largest page_id are responses each; an empty table gives no archives and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import zips
from .common import lean, scratch, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Of an archive's records, compressed, before the next archive begins.
ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 1_000
#: Tasks that read archives, at most; each then reads several.
MAX_TASKS = 20_000
#: Pages have no time of capture.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "none") else int(name)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """``refers_to``: a revisit's response, as a tuple of one; None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to else http + payload
    head = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(),
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to[0])}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers (names in lower case), and a response's payload (None for others)."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise zips.FormatError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(head["content-length"])]
    return head, block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def open_for_reading(path: str):
    files, inner = pafs.FileSystem.from_uri(path)
    return files.open_input_file(inner)


class _Archive:
    """Records gathered for one archive."""

    def __init__(self, folder: str, zip64: bool):
        self.path, self.zip64, self.data, self.lines = f"{folder}/{uuid.uuid4().hex}.wacz", zip64, bytearray(), []

    def add(self, record: bytes, page_id: int | None, url: str | None, kind: str) -> None:
        packed = _gzip(record)
        self.lines.append(f"{_urn(page_id)} " + json.dumps({"url": url, "type": kind, "offset": len(self.data), "length": len(packed)}))
        self.data += packed

    def close(self) -> tuple[str, int, int]:
        files, inner = pafs.FileSystem.from_uri(self.path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        with files.open_output_stream(inner) as out:
            pack = zips.Writer(out, self.zip64)
            pack.add(DATA, self.data)
            pack.add(INDEX, "\n".join(self.lines).encode())
            pack.close()
            return self.path, len(self.lines), pack.at


def write(pages: DataFrame, folder: str | None = None, *, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write archives; returns the table (path, records, bytes) of them."""
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    long = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest", F.unhex(F.sha2("payload", 256)).alias("whole"), F.octet_length("payload").alias("size"))
    groups = written(long.agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("__digest"), "whole", "size", "response", F.lit(True).alias("many")), "payloads")
    same = (rows.digest == F.col("__digest")) & (F.octet_length(rows.payload) == F.col("size")) & (F.unhex(F.sha2(rows.payload, 256)) == F.col("whole"))
    joined = rows.join(groups, same, "left").select("page_id", "url", "payload", "digest", "response", (F.col("many") & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = _Archive(folder, zip64), []
        for batch in batches:
            for page_id, url, payload, digest, response, revisit in zip(*batch.columns, strict=True):
                page_id, url, revisit = page_id.as_py(), url.as_py(), bool(revisit.as_py())
                record = build_record(page_id, url, payload.as_py().encode(), digest.as_py(), (response.as_py(),) if revisit else None)
                archive.add(record, page_id, url, "revisit" if revisit else "response")
                if len(archive.data) >= archive_bytes:
                    done.append(archive.close())
                    archive = _Archive(folder, zip64)
        if archive.lines:
            done.append(archive.close())
        path, n, size = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["path", "records", "bytes"])

    return written(joined.mapInArrow(lean(pack), "path string, records long, bytes long"), "archives")


def read_archive(file, size: int) -> Iterator[tuple]:
    """Records of one archive, in the order of its index; each by a range of its own."""
    pack = zips.Reader(file, size)
    data = pack.members[DATA]
    start = pack.start_of(data)
    for line in pack.whole(pack.members[INDEX]).decode().split("\n"):
        if not line:
            continue
        entry = json.loads(line.partition(" ")[2])
        head, payload = parse_record(zlib.decompress(pack.range_of(data, start, entry["offset"], entry["length"]), 31))
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
        n = int(head["warc-payload-length"])
        if payload is not None and (len(payload) != n or hashlib.sha1(payload).digest() != digest):
            raise zips.FormatError(f"payload of {head['warc-record-id']} differs from its digest")
        yield _page_of(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], _page_of(head.get("warc-refers-to")), n, digest.hex(), payload


def read(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Records of the archives in the column ``path``; ``payloads``: whether to return these too."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_for_reading(path) as file:
                    for row in read_archive(file, file.size()):
                        rows.append(row if payloads else (*row[:-1], None))
                        held += row[4]
                        if len(rows) >= 5_000 or payloads and held > 32 << 20:
                            yield emit(rows)
                            rows, held = [], 0
                yield emit(rows)

    # The rows that name archives are tiny: dealt to a number of tasks of its own, adaptive execution doesn't merge them into one.
    tasks = min(MAX_TASKS, max(1, 2 * archives.count()))
    return archives.select("path").repartition(tasks, "path").mapInArrow(lean(unpack), READ)
