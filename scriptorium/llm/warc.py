"""WARC: seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about `frame_bytes`
bytes; a bundle ends with a seek table in a skippable frame (compressed and decompressed
size of every frame, and a footer), so any frame can be read by itself and any
standard decompressor reads the whole. The manifest maps a record's id to its bundle,
its frame and its offset inside the frame.

Equal payloads are stored once: the record with the largest page_id is a response,
the others are revisits that refer to it. Bundles are written by the executors
through pyarrow's file systems into a folder all of them share, under a name of
the task's attempt, and count only if the manifest names them, so a lost task leaves no
half-written bundle behind in any result.

Defined results: null html is empty; pages with equal payload and equal, largest page_id
are all responses; a null page_id is smaller than any other (all null: all
responses); an empty table gives an empty manifest; null url is written as urn:none;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, small_batches, stash

_MANIFEST = "page_id long, bundle string, frame int, frame_offset long, frame_bytes long, offset long, length long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"
#: Magic numbers of the seekable format (fixed values).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def file_system(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    digits = record_id[len("<urn:page:") : -1]
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record; its HTTP head has the payload's full length also where the payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; a response's digest is computed from its payload."""
    head, block = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"][len("sha1:") :]
    if fields["WARC-Type"] == "response" and (len(payload) != length or _digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "url": fields["WARC-Target-URI"],
        "payload": payload.decode() if fields["WARC-Type"] == "response" else None,
    }


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class BundleWriter:
    """Writes one bundle; records come back with their frame and offset once their frame is closed."""

    def __init__(self, stream, frame_bytes: int, level: int = 3):
        import zstandard

        self.stream, self.limit = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.waiting, self.at = bytearray(), [], 0

    def add(self, key, raw: bytes) -> list[tuple]:
        self.waiting.append((key, len(self.buffer), len(raw)))
        self.buffer += raw
        return self.flush() if len(self.buffer) >= self.limit else []

    def flush(self) -> list[tuple]:
        """(key, frame, frame's offset, frame's bytes, offset, length) of the records in the open frame."""
        if not self.waiting:
            return []
        data = self.compressor.compress(bytes(self.buffer))
        self.stream.write(data)
        out = [(key, len(self.frames), self.at, len(data), offset, length) for key, offset, length in self.waiting]
        self.frames.append((len(data), len(self.buffer)))
        self.at += len(data)
        self.buffer, self.waiting = bytearray(), []
        return out

    def close(self) -> list[tuple]:
        out = self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        return out


def seek_table(stream) -> list[tuple[int, int, int, int]]:
    """(offset, bytes, decompressed offset, decompressed bytes) of each frame, from the bundle's footer."""
    size = stream.size()
    stream.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 8 * frames)
    entries = struct.unpack(f"<{2 * frames}I", stream.read(8 * frames))
    out, at, plain = [], 0, 0
    for a, b in zip(entries[::2], entries[1::2]):
        out.append((at, a, plain, b))
        at, plain = at + a, plain + b
    return out


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html with `refers_to` and `revisit`.

    Only digests of payloads that occur more than once are joined, so a page without a copy
    needs no partner; a very common payload's pages are dealt over tasks by the skew join.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_sha1", F.sha1(F.col("html").cast("binary")))
    digests = rows.where(F.octet_length("html") >= least_bytes).groupBy("_sha1").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    common = digests.where((F.col("_n") > 1) & F.col("_last").isNotNull()).select("_sha1", "_last")
    joined = rows.join(common, "_sha1", "left").drop("_sha1")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("_last")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, least_bytes: int = 0) -> DataFrame:
    """Write bundles into `folder` and return the manifest (itself a stored table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        writer, name, count = None, "", 0

        def rows(entries: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*entries)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays.insert(1, pa.array([name] * len(entries), pa.string()))
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _MANIFEST.split(", ")])

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{count:04d}.warc.zst"
                    stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer, count = BundleWriter(stream, frame_bytes), count + 1
                payload = html.encode()
                if done := writer.add(page_id, record(page_id, url, payload, _digest(payload), refers_to, revisit)):
                    yield rows(done)
                    if writer.at >= bundle_bytes:
                        writer.close()
                        stream.close()
                        writer = None
        if writer is not None:
            if done := writer.close():
                yield rows(done)
            stream.close()

    small_batches(pages.sparkSession, 256)
    return stash(decided(pages, least_bytes).mapInArrow(run, _MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records that the manifest names; neighbouring records share one read of their frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, base = file_system(folder)
        plain, stream, table = zstandard.ZstdDecompressor(), None, []
        opened, frame, data = None, None, b""
        for batch in batches:
            for part in (batch.slice(k, 128) for k in range(0, len(batch), 128)):
                found = []
                for _, bundle, number, at, size, offset, length in zip(*(c.to_pylist() for c in part.columns)):
                    if bundle != opened:
                        if stream:
                            stream.close()
                        stream, opened, frame = fs.open_input_file(f"{base}/{bundle}"), bundle, None
                        table = seek_table(stream)
                    if number != frame:
                        if table[number][:2] != (at, size):
                            raise ValueError(f"seek table of {bundle} and manifest differ")
                        stream.seek(at)
                        data, frame = plain.decompressobj().decompress(stream.read(size)), number
                        if len(data) != table[number][3]:
                            raise ValueError(f"frame {number} of {bundle} is damaged")
                    found.append(parse(data[offset : offset + length]))
                kinds = {"long": pa.int64(), "string": pa.string()}
                fields = [x.split() for x in _RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds[k]) for n, k in fields], names=[n for n, _ in fields])
        if stream:
            stream.close()

    small_batches(manifest.sparkSession, 256)
    return manifest.mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to bundles in the shared folder and read them back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder, least_bytes=least_bytes), folder)
