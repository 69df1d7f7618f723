"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is a run
of frames and, in a skippable frame at its end, the seek table of the public
seekable format (sizes of each frame, number of frames, magic number). The
bundles are rows of a written table (bundle_id, content, entries): Spark's
commit protocol makes them whole or absent, on any file system. ``entries``
maps each record to its frame and its place in the frame, so that one record is
read by decompressing one frame.

Of pages with equal payloads of at least ``least`` bytes, the one with the
smallest page_id is a response record and the others are revisit records that
refer to it; smaller payloads are always responses.

Nulls and edges: a null html is an empty payload; a null url leaves out the
target URI (control characters in a url are percent-encoded); a page without id
is written without it, and refers to the smallest id of its payload if there is
one; repeated rows of the smallest id are all responses.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import written

#: Magic numbers of the public seekable format: skippable frame, seek table.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 17, 1 << 23
ENTRY = "record_id: string, page_id: long, frame: int, frame_offset: long, frame_bytes: long, record_offset: long, record_bytes: long"
LAYOUT = f"bundle_id string, content binary, entries array<struct<{ENTRY}>>"
RECORD = "page_id long, record_type string, refers_to long, uri string, payload binary, payload_bytes long, payload_digest string"


def decisions(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, uri, payload, payload_digest, payload_bytes, refers_to (null for responses)."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # only payloads that come again are joined: the table of them is small beside the pages
    again = (own.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
             .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return own.join(again, "payload_digest", "left").withColumn("refers_to", refers).drop("_first")


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id, uri, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    response = refers_to is None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if response else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri))
    if not response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, decompressed bytes) of each frame, from the end of a bundle."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    sizes, out, at = struct.iter_unpack("<II", content[-9 - 8 * n: -9]), [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


class _Bundle:
    """Frames so far, and the records of the frame that is being filled."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self):
        self.frames, self.sizes, self.entries, self.open, self.plain, self.filled = [], [], [], [], 0, 0

    def add(self, page_id, record: bytes) -> None:
        self.entries.append([record_name(page_id), page_id, len(self.frames), None, None, self.filled, len(record)])
        self.open.append(record)
        self.filled += len(record)
        if self.filled >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed, at, k = self.packer.compress(b"".join(self.open)), sum(s[0] for s in self.sizes), len(self.frames)
            for e in reversed(self.entries):
                if e[2] != k:
                    break
                e[3:5] = at, len(packed)
            self.frames.append(packed)
            self.sizes.append((len(packed), self.filled))
            self.plain += self.filled
            self.open, self.filled = [], 0

    def take(self, bundle_id: str) -> pd.DataFrame:
        self.close_frame()
        names = [x.split(":")[0].strip() for x in ENTRY.split(",")]
        out = pd.DataFrame({"bundle_id": [bundle_id], "content": [b"".join(self.frames) + seek_table(self.sizes)],
                            "entries": [[dict(zip(names, e, strict=True)) for e in self.entries]]})
        self.clear()
        return out


def write_bundles(records: DataFrame, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """The written table of bundles of ``records`` (as from decisions())."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, bundle = TaskContext.get().partitionId(), 0, _Bundle()
        none = lambda x: None if pd.isna(x) else int(x)
        for b in batches:
            for page_id, uri, payload, digest, size, refers in zip(b.page_id, b.uri, b.payload, b.payload_digest, b.payload_bytes, b.refers_to, strict=True):
                bundle.add(none(page_id), _record(none(page_id), uri, bytes(payload), digest, size, none(refers), date))
                if bundle.plain >= BUNDLE_BYTES:
                    yield bundle.take(f"{task:06d}-{n:06d}")
                    n += 1
        if bundle.entries:
            yield bundle.take(f"{task:06d}-{n:06d}")

    slim = records.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    return written(slim.select("page_id", "uri", "payload", "payload_digest", "payload_bytes", "refers_to").mapInPandas(run, LAYOUT), "warc-bundles")


def index(bundles: DataFrame) -> DataFrame:
    """One row for each record: where it lies."""
    return bundles.select("bundle_id", F.inline("entries"))


def _parse(record: bytes) -> tuple:
    """A row of RECORD from one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda name: None if name is None or name == record_name(None) else int(name.rsplit(":", 1)[1].rstrip(">"))
    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].split(":", 1)[1], int(fields["X-Payload-Length"])
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
    return number(fields["WARC-Record-ID"]), kind, number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), payload, size, digest


def _rows(parsed: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(parsed, columns=[x.split()[0] for x in RECORD.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records, frame by frame by the seek tables; each response's payload is checked against its digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for content, entries in zip(b.content, b.entries, strict=True):
                by_frame: dict[int, list] = {}
                for e in entries:
                    by_frame.setdefault(e["frame"], []).append(e)
                for k, (at, packed, plain) in enumerate(read_seek_table(content)):
                    frame = unpack.decompress(content[at: at + packed], max_output_size=plain)
                    yield _rows([_parse(frame[e["record_offset"]: e["record_offset"] + e["record_bytes"]]) for e in by_frame.get(k, [])])

    return bundles.select("content", "entries").mapInPandas(run, RECORD)


def fetch(bundles: DataFrame, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of the ids in ``wanted``: only their frames are decompressed."""
    places = index(bundles).join(wanted.select(F.col(id_col).alias("page_id")).distinct(), "page_id", "left_semi")
    jobs = bundles.select("bundle_id", "content").join(
        places.groupBy("bundle_id").agg(F.collect_list(F.struct("frame_offset", "frame_bytes", "record_offset", "record_bytes")).alias("places")), "bundle_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for content, spots in zip(b.content, b.places, strict=True):
                frames: dict[int, bytes] = {}
                for p in spots:
                    at = p["frame_offset"]
                    if at not in frames:
                        frames[at] = unpack.decompress(content[at: at + p["frame_bytes"]])
                yield _rows([_parse(frames[p["frame_offset"]][p["record_offset"]: p["record_offset"] + p["record_bytes"]]) for p in spots])

    return jobs.select("content", "places").mapInPandas(run, RECORD)
