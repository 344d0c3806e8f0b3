"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a skippable frame at the end of the file is the seek table (the
sizes of all frames), so a reader gets any frame by two range reads. An index maps record identifiers to
(file, frame, offset in the frame). A page whose payload another page also has is a revisit of it, if the
payload has ``REVISIT_BYTES`` or more.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_path, open_fs, stored, write_file

REVISIT_BYTES = 1000
#: bytes of records in a frame, and of records in a file
FRAME_BYTES, FILE_BYTES, LEVEL = 1 << 18, 1 << 28, 3
# fixed values: the seekable format's magic numbers
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_FOOT = struct.Struct("<IBI")
_ZONE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: the date of all records; the pages carry none
DATE = "1970-01-01T00:00:00Z"
_CONTROL = re.compile("[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_ZONE, f'page/{page_id}/{digest if page_id is None else ""}')}>"


def _headers(pairs) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; control characters and spaces in the address are percent-encoded."""
    uri = None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    revisit = refers_to is not None
    block = http if revisit else http + payload
    return (
        b"WARC/1.1\r\n"
        + _headers([
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Profile", _PROFILE if revisit else None),
            ("WARC-Refers-To", record_id(refers_to) if revisit else None),
            ("X-Page-Id", page_id),
            ("X-Refers-To-Page", refers_to),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", len(block)),
        ])
        + b"\r\n" + block + b"\r\n\r\n"
    )


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, position after the record)."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return headers, data[start:stop], stop + 4


class BundleWriter:
    """Chunks of a bundle; ``places`` gets (frame, offset, length) of each record."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def add(self, rec: bytes) -> tuple[tuple[int, int, int], bytes]:
        """The record's place, and the bytes to write now."""
        place = len(self.frames), self.held, len(rec)
        self.waiting.append(rec)
        self.held += len(rec)
        self.total += len(rec)
        return place, self.flush() if self.held >= FRAME_BYTES else b""

    def flush(self) -> bytes:
        if not self.waiting:
            return b""
        frame = self.packer.compress(b"".join(self.waiting))
        self.frames.append((len(frame), self.held))
        self.waiting, self.held = [], 0
        return frame

    def end(self) -> bytes:
        last = self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + _FOOT.pack(len(self.frames), 0, SEEKABLE)
        return last + struct.pack("<II", SKIPPABLE, len(table)) + table


class Bundle:
    """A bundle read by ranges."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        n, flags, magic = _FOOT.unpack(self.f.read_at(_FOOT.size, size - _FOOT.size))
        if magic != SEEKABLE or flags:
            raise ValueError(f"no seek table: {uri}")
        table = self.f.read_at(8 * n, size - _FOOT.size - 8 * n)
        self.places, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            self.places.append((at, packed, plain))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.places[k]
        out = self.unpacker.decompress(self.f.read_at(packed, at))
        if len(out) != plain:
            raise ValueError("a frame isn't as long as the seek table says")
        return out

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(frame), offset)[:2]

    def close(self) -> None:
        self.f.close()


def _writer(folder: str):
    def run(batches):
        part, number, out, rows, chunks = TaskContext.get().partitionId(), 0, None, [], []

        def done():
            # a name of this attempt: the index that Spark keeps names the files of the attempts that it kept
            uri = f"{folder}/part-{part:06d}-{number:03d}-{uuid.uuid4().hex[:12]}.warc.zst"
            write_file(uri, [*chunks, out.end()])
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch(
                [pa.array(cols[0], kinds[0]), pa.array(cols[1], kinds[1]), pa.array([uri] * len(rows)), *(pa.array(c, k) for c, k in zip(cols[2:], kinds[2:]))],
                names=["page_id", "record_id", "uri", "frame", "offset", "n_bytes"],
            )

        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                out = out or BundleWriter()
                place, chunk = out.add(record(page_id, url, html or b"", digest, refers_to))
                rows.append((page_id, record_id(page_id, digest), *place))
                if chunk:
                    chunks.append(chunk)
                if out.total >= FILE_BYTES:
                    yield done()
                    number, out, rows, chunks = number + 1, None, [], []
        if out:
            yield done()

    return run


def write_bundles(pages: DataFrame) -> DataFrame:
    """Write every row of ``pages`` as a record; gives the index (page_id, record_id, uri, frame, offset, n_bytes)."""
    x = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("html"))
    x = x.withColumn("digest", F.sha1("html"))
    equal = x.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last_id"))
    equal = stored(equal.where("n > 1 and last_id is not null").select("digest", "last_id"), "equal-payloads")
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last_id")), F.col("last_id"))
    x = x.join(equal, "digest", "left").select("page_id", "url", "html", "digest", refers_to.alias("refers_to"))
    folder = new_path(pages.sparkSession, "warc")
    return stored(x.mapInArrow(_writer(folder), "page_id long, record_id string, uri string, frame long, offset long, n_bytes long"), "warc-index")


def _described(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a payload that is there is checked."""
    http = block.index(b"\r\n\r\n") + 4
    size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", block[:http])[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(block) - http != size or hashlib.sha1(block[http:]).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} doesn't match its digest")
    number = lambda k: int(headers[k]) if k in headers else None
    return number("X-Page-Id"), size, digest, kind, number("X-Refers-To-Page")


def _found(batches):
    """(row, headers, block) of records at their places (page_id, record_id, uri, frame, offset, n_bytes), which stand
    together by file and frame: a file's seek table is read once, a frame unpacked once."""
    bundle, now, at, data = None, None, -1, b""
    for b in batches:
        for row in b.to_pylist():
            if row["uri"] != now:
                if bundle:
                    bundle.close()
                bundle, now, at = Bundle(row["uri"]), row["uri"], -1
            if row["frame"] != at:
                at, data = row["frame"], bundle.frame(row["frame"])
            headers, block, end = parse_record(data, row["offset"])
            if headers["WARC-Record-ID"] != row["record_id"] or end - row["offset"] != row["n_bytes"]:
                raise ValueError(f"{now}, frame {at}, offset {row['offset']}: not the record {row['record_id']}")
            yield row, headers, block
    if bundle:
        bundle.close()


_DESCRIBED = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _reader(batches):
    rows = []
    for _, headers, block in _found(batches):
        rows.append(_described(headers, block))
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip((n for n, _ in _DESCRIBED), r)) for r in rows], pa.schema(_DESCRIBED))
            rows = []
    yield pa.RecordBatch.from_pylist([dict(zip((n for n, _ in _DESCRIBED), r)) for r in rows], pa.schema(_DESCRIBED))


def _by_place(index: DataFrame) -> DataFrame:
    """Places of records, those of a frame together in a task."""
    x = index.select("page_id", "record_id", "uri", "frame", "offset", "n_bytes")
    return x.repartition("uri", "frame").sortWithinPartitions("uri", "frame", "offset")


def read_bundles(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the index, each read at its
    frame and offset, where its identifier is checked."""
    return _by_place(index).mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, payload) of the response records of ``wanted``'s page_ids, each by its own frame."""

    def run(batches):
        for row, headers, block in _found(batches):
            if headers["WARC-Type"] == "response":
                yield pa.record_batch([pa.array([row["page_id"]], pa.int64()), pa.array([block[block.index(b"\r\n\r\n") + 4 :]], pa.binary())], names=["page_id", "payload"])

    found = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    return _by_place(found).mapInArrow(run, "page_id long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as seekable bundles and describe every record from what is read back.

    Null html is an empty payload. Of equal payloads of 1000 bytes or more the rows with the largest page_id
    are responses (repeated rows each), all others revisit it; rows without page_id revisit it too, unless no
    equal row has one. A null address leaves its header out. A payload of any length is one record, whose frame
    is as long as it takes. Columns besides page_id, url and html are ignored; no rows, no files.
    """
    return read_bundles(write_bundles(pages))
