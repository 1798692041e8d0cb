"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a skippable frame that maps record identifiers to (frame, offset in
the frame, length), and with the seek table of the public seekable format. Any record is read by
decompressing one frame. Records whose payload has appeared elsewhere are revisit records.

Scale: bundles are rows (name, content) of a table in shared storage, so executors need no common local folder. One shuffle joins
each record with the representative of its digest (a grouped maximum, combined before the shuffle); writing and reading are map passes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import cut

#: Fixed values of the public seekable format: magic numbers of skippable frames and of the footer.
SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1


def record_bytes(ident: str, url: str, kind: str, digest: str, payload: bytes, size: int, refers: str | None, date: str) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {json.dumps(url)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*head, f"Content-Length: {len(payload)}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the place after the record at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    body = data[end + 4 : end + 4 + int(head["Content-Length"])]
    return head, body, end + 8 + len(body)


class BundleWriter:
    def __init__(self, frame_bytes: int, level: int = 3):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.index: dict[str, list[int]] = {}
        self.done, self.open = bytearray(), bytearray()

    def add(self, ident: str, record: bytes) -> None:
        self.index[ident] = [len(self.frames), len(self.open), len(record)]
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.zstd.compress(bytes(self.open))
            self.frames.append((len(frame), len(self.open)))
            self.done += frame
            self.open = bytearray()

    def finish(self) -> bytes:
        self._close()
        index = self.zstd.compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        return bytes(self.done) + struct.pack("<II", INDEX_FRAME, len(index)) + index + struct.pack("<II", SEEK_FRAME, len(table)) + table


class Bundle:
    def __init__(self, data: bytes):
        n, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        table = len(data) - 9 - 8 * n
        self.data, self.at, self.index_at = data, [], 0
        for c, d in struct.iter_unpack("<II", data[table : table + 8 * n]):
            self.at.append((self.index_at, c, d))
            self.index_at += c

    def frame(self, i: int) -> bytes:
        at, c, d = self.at[i]
        return zstandard.ZstdDecompressor().decompress(self.data[at : at + c], max_output_size=d)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.at)):
            data, at = self.frame(i), 0
            while at < len(data):
                head, body, at = parse_record(data, at)
                yield head, body

    def index(self) -> dict[str, list[int]]:
        _, size = struct.unpack_from("<II", self.data, self.index_at)
        return json.loads(zstandard.ZstdDecompressor().decompress(self.data[self.index_at + 8 : self.index_at + 8 + size]))

    def read(self, ident: str) -> tuple[dict[str, str], bytes]:
        """One record by its identifier: one frame is decompressed."""
        f, at, _ = self.index()[ident]
        return parse_record(self.frame(f), at)[:2]


def with_representatives(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("body"))))
    best = rows.where(F.octet_length("body") >= min_bytes).groupBy("digest").agg(F.max("id").alias("rep"))
    return rows.join(best, "digest", "left")


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 1 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows (name, content, n_records): bundles with a record for each row of pages. Store them before reading them back.

    Of the records with equal payloads of min_bytes or more, that with the largest id is a response and the others are revisits of it; smaller
    ones are responses. Null payloads are empty. Repeated rows give records of the same identifier. Null ids are written as -0.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        w, n, seq = BundleWriter(frame_bytes), 0, 0
        row = lambda: pa.RecordBatch.from_pydict({"name": [f"part-{part:05d}-{seq:05d}.warc.zst"], "content": [w.finish()], "n_records": [n]}, schema=schema)
        for b in cut(batches, "body"):
            for i, url, body, digest, rep in zip(*(b.column(c).to_pylist() for c in ("id", "url", "body", "digest", "rep"))):
                payload = body.encode("utf-8", "surrogatepass")
                ident = "-0" if i is None else str(i)
                first = rep is None or i is None or rep == i
                text = base64.b32encode(digest).decode()
                w.add(ident, record_bytes(ident, url, "response" if first else "revisit", text, payload if first else b"", len(payload), None if first else str(rep), date))
                n += 1
                if len(w.done) >= bundle_bytes:
                    yield row()
                    w, n, seq = BundleWriter(frame_bytes), 0, seq + 1
        if n:
            yield row()

    schema = pa.schema([("name", pa.string()), ("content", pa.binary()), ("n_records", pa.int64())])
    return with_representatives(pages, id_col, url_col, payload_col, min_bytes).mapInArrow(run, "name string, content binary, n_records long")


def read_bundles(bundles: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record of bundles: name, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null unless asked for).

    Sizes and digests of responses are those of the payload read; a digest that differs from its header raises.
    """
    cols = "name string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    schema = pa.schema([("name", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])

    def number(x):
        x = x.removeprefix("<urn:page:").removesuffix(">")
        return None if x == "-0" else int(x)

    def run(batches):
        for b in cut(batches, "content"):
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                out = []
                for h, body in Bundle(content).records():
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        size, told, digest = len(body), digest, base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if told != digest:
                            raise ValueError(f"{name}: damaged payload of {h['WARC-Record-ID']}")
                    refers = h.get("WARC-Refers-To")
                    out.append((name, number(h["WARC-Record-ID"]), json.loads(f'"{h["WARC-Target-URI"]}"'), size, digest, h["WARC-Type"], number(refers) if refers else None, body.decode("utf-8", "surrogatepass") if payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return bundles.select("name", "content").mapInArrow(run, cols)
