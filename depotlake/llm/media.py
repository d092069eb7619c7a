"""Media columns in Ogg containers: writing, and reading back with all of the format's checks.

A payload is cut into blocks of 576 samples of 8 bits. Even blocks go to one logical stream, odd ones to another, each
with a PCM header packet; their pages alternate. Reading verifies each page's checksum, rejoins packets from lacing
values across pages, separates the logical streams by serial number, and derives each packet's time from the granule
positions. Pages that fail are counted and left out, as are packets that lost a part.

Null texts are an empty payload, which is stored as one block of padding; equal texts give equal files; repeated rows
are read each by itself; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from depotlake.llm.common import per_batch, table

BLOCK, RATE, PAD = 576, 8000, b"\xff"
#: Bytes of a block's tail whose checksum is returned.
TAIL = 32
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
PCM = struct.Struct(">8sHHIIBBHI")
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The page checksum: polynomial 04c11db7, highest bit first, from 0. It is the mirror image of zlib's of mirrored bytes."""
    mirrored = zlib.crc32(data.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRROR), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def paged(packets: list[bytes], granules: list[int], serial: int, number: int) -> Iterator[tuple[int, bytes]]:
    """Pages of 255 lacing values at most, each with the granule position of the last packet that ends on it, or -1."""
    values, ends = bytearray(), {}
    for k, p in enumerate(packets):
        values += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        ends[len(values) - 1] = granules[k]
    body, at = b"".join(packets), 0
    for start in range(0, len(values), 255):
        lacing = bytes(values[start : start + 255])
        done = [m for m in range(start, start + len(lacing)) if m in ends]
        size = sum(lacing)
        kind = (CONTINUED if start and values[start - 1] == 255 else 0) | (LAST if start + 255 >= len(values) else 0)
        granule = ends[done[-1]] if done else -1
        yield granule, page(kind, granule, serial, number, lacing, body[at : at + size])
        at, number = at + size, number + 1


def to_ogg(payload: bytes) -> bytes:
    """An Ogg file of two logical streams with the even and the odd blocks of payload."""
    base = zlib.crc32(payload)
    streams = []
    for side in (0, 1):
        serial = (base + side) & 0xFFFFFFFF
        header = PCM.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, BLOCK, 0)
        blocks = [payload[i : i + BLOCK] for i in range(side * BLOCK, len(payload), 2 * BLOCK)]
        first = page(FIRST | (0 if blocks else LAST), 0, serial, 0, bytes([len(header)]), header)
        granules = [(k + 1) * BLOCK for k in range(len(blocks))]
        streams.append((first, list(paged(blocks, granules, serial, 1))))
    out = [first for first, _ in streams]
    for k in range(max(len(pages) for _, pages in streams)):
        out += [pages[k][1] for _, pages in streams if k < len(pages)]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    order: int
    rate: int = 0
    granule: int = 0
    next_page: int = 0
    part: bytes | None = None
    packets: list[tuple[int, bytes]] = field(default_factory=list)  # granule position at the packet's start, data


@dataclass
class Contents:
    streams: dict[int, Stream]
    pages: int = 0
    bad_pages: int = 0
    lost_packets: int = 0

    def in_time(self) -> list[tuple[float, int, bytes]]:
        """Packets of all logical streams by time in seconds, then by the order in which the streams begin."""
        found = [(start / (s.rate or 1), s.order, data) for s in self.streams.values() for start, data in s.packets]
        return sorted(found, key=lambda x: x[:2])


def read_pages(data: bytes) -> Iterator[tuple[bool, int, int, int, int, bytes, bytes]]:
    """intact, kind, granule, serial, number, lacing values and body of each page; after damage, from the next capture pattern on."""
    at = data.find(b"OggS")
    while at >= 0:
        if len(data) < at + HEAD.size:
            yield False, 0, 0, 0, 0, b"", b""
            return
        _, _, kind, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        body = at + HEAD.size + n
        end = body + sum(lacing)
        whole = end <= len(data) and len(lacing) == n
        intact = whole and checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc
        yield intact, kind, granule, serial, number, lacing, data[body:end]
        at = data.find(b"OggS", end if intact else at + 4)


def from_ogg(data: bytes) -> Contents:
    out = Contents({})
    for intact, kind, granule, serial, number, lacing, body in read_pages(data):
        out.pages += 1
        if not intact:
            out.bad_pages += 1
            continue
        s = out.streams.setdefault(serial, Stream(serial, len(out.streams)))
        if number != s.next_page:  # a page is missing: what it had begun can't be ended
            out.lost_packets += 1
            s.part = None
        s.next_page = number + 1
        done, at, size = [], 0, 0
        skip = bool(kind & CONTINUED) and s.part is None
        if not kind & CONTINUED and s.part is not None:
            out.lost_packets += 1
            s.part = None
        for value in lacing:
            size += value
            if value < 255:
                piece = body[at : at + size]
                if skip:
                    skip = False
                else:
                    done.append((s.part or b"") + piece)
                s.part, at, size = None, at + size, 0
        if lacing and lacing[-1] == 255:
            s.part = None if skip else (s.part or b"") + body[at : at + size]
        if kind & FIRST and done and done[0][:8] == b"PCM     ":
            s.rate = PCM.unpack(done.pop(0))[4]
        start = granule - sum(len(p) for p in done)  # the position is that of the last packet's end
        for p in done:
            s.packets.append((start, p))
            start += len(p)
        s.granule = granule if done else s.granule
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the payload: a positive multiple of a block."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + PAD * (-len(data) % BLOCK or (0 if data else BLOCK))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the text's bytes as samples in an Ogg file."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads = [padded(t) for t in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array([n for n, _ in payloads], pa.int64()), pa.array([to_ogg(p) for _, p in payloads], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(per_batch(step), "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each packet: stream (in order of beginning), serial, start in seconds, bytes; damaged pages and their packets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(*(c.to_pylist() for c in batch.columns)):
                c = from_ogg(data or b"")
                rows = sorted((s.order, start / (s.rate or 1), s.serial, p) for s in c.streams.values() for start, p in s.packets)
                columns = [[k] * len(rows), [r[0] for r in rows], [r[2] for r in rows], [r[1] for r in rows], [r[3] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary()))], names=[key, "stream", "serial", "seconds", "packet"])

    return media.select(key, column).mapInArrow(run, f"{key} long, stream int, serial long, seconds double, packet binary")


DIGESTS = {
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
    "feature": pa.string(), "pages": pa.int64(), "bad_pages": pa.int64(),
}


def digest(data: bytes) -> tuple:
    c = from_ogg(data)
    timed = c.in_time()
    payload = b"".join(p for _, _, p in timed)
    samples = np.frombuffer(payload, np.uint8)
    ends = [s.granule / (s.rate or 1) for s in c.streams.values()]
    loud = samples.astype(np.float64) - 128 if len(samples) else np.zeros(1)
    feature = f"streams={len(c.streams)};packets={len(timed)};seconds={sum(ends):.3f};last={timed[-1][0] if timed else 0:.3f};mean={loud.mean():.3f};rms={np.sqrt((loud * loud).mean()):.3f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), feature, c.pages, c.bad_pages


def features(stored: DataFrame) -> DataFrame:
    """For each file of store(): size and hash of the payload as read back and of the file, and what the samples and times show."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [digest(m or b"") for m in batch.column(2).to_pylist()]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(DIGESTS.values())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", *DIGESTS])

    kinds = ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in DIGESTS.items())
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(per_batch(step), f"doc_id long, n_bytes long, {kinds}")


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))
