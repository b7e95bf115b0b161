"""Operator 8: Ogg media columns.

``write`` multiplexes packets of logical streams into pages with lacing values, granule positions and
checksums; ``read`` verifies every page's checksum, takes the streams apart, reassembles packets over
page bounds and derives timestamps from granule positions.  A payload is stored as packets of unsigned
8-bit samples; a second stream holds its length and the digest of its packets.

Defined results: a null text is the empty one (64 zero bytes); equal texts give equal bytes and
features, so there are no ties; very long texts are stored whole; a damaged page, a lost page or an unknown
version raises ValueError; repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.common import map_rows, table

RATE = 8000
UNIT, PACKET, PAGE_SEGMENTS = 64, 4096, 255
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))

REPORT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0, without a final inversion.

    It is the bit mirror of zlib's CRC over mirrored bytes, so it runs in C.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(_HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = struct.pack("<I", page_checksum(bytes(page)))
    return bytes(page)


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream of (packet, granule position at its end)."""
    out: list[bytes] = []
    lacing, body, granule, kind, fresh = bytearray(), bytearray(), -1, FIRST, True

    def flush(more: int, last: bool) -> None:
        nonlocal lacing, body, granule, kind
        out.append(_page(kind | (LAST if last else 0), granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, kind = bytearray(), bytearray(), -1, more

    for k, (packet, end) in enumerate(packets):
        values, at = _lacing(len(packet)), 0
        while values:
            room = PAGE_SEGMENTS - len(lacing)
            now, values = values[:room], values[room:]
            lacing += now
            body += packet[at : at + sum(now)]
            at += sum(now)
            if values:
                flush(CONTINUED, False)
        granule = end
        fresh = k == 0
        if (fresh or len(lacing) + PACKET // 255 + 1 > PAGE_SEGMENTS) and k + 1 < len(packets):
            flush(0, False)
    flush(0, True)
    return out


def write(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """All streams in one file: first pages first, then page by page in turn."""
    each = [pages(serial, packets) for serial, packets in streams.items()]
    out, depth = [p[0] for p in each], 1
    while any(len(p) > depth for p in each):
        out += [p[depth] for p in each if len(p) > depth]
        depth += 1
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: (granule position, packets complete by then) of each page that ends one
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    over: bool = False
    part: bytearray | None = None

    def seconds(self, rate: int = RATE) -> list[float]:
        return [granule / rate for granule, _ in self.marks]


def read(data: bytes) -> dict[int, Stream]:
    """The logical streams of a file, by serial number."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError(f"a page is cut off at {at}")
        magic, version, kind, granule, serial, number, checksum, segments = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page of a known version at {at}")
        lacing = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        if end > len(data):
            raise ValueError(f"a page is cut off at {at}")
        page = data[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise ValueError(f"the page at {at} is damaged")
        if bool(kind & FIRST) == (serial in streams):
            raise ValueError(f"stream {serial} has no or several first pages")
        stream = streams.setdefault(serial, Stream())
        if number != stream.pages or stream.over or bool(kind & CONTINUED) != (stream.part is not None):
            raise ValueError(f"stream {serial} lacks a page before {at}")
        stream.pages, stream.over = number + 1, bool(kind & LAST)
        begin = 27 + segments
        for value in lacing:
            stream.part = stream.part if stream.part is not None else bytearray()
            stream.part += page[begin : begin + value]
            begin += value
            if value < 255:
                stream.packets.append(bytes(stream.part))
                stream.part = None
        if granule >= 0:
            stream.marks.append((granule, len(stream.packets)))
        at = end
    for serial, stream in streams.items():
        if not stream.over or stream.part is not None:
            raise ValueError(f"stream {serial} has no last page")
    return streams


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def store(payload: bytes) -> bytes:
    """The payload as 8-bit samples in one stream, and its description in another."""
    serial = zlib.crc32(payload)
    samples = [(struct.pack("<8sIB", b"samples\0", RATE, 8), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    about = [(b"about\0", 0), (struct.pack("<QI", len(payload), serial), len(payload))]
    return write({serial: samples, serial ^ 1: about})


def restore(media: bytes) -> tuple[bytes, Stream]:
    """The payload read back, and the stream that it came from."""
    by_kind = {s.packets[0][:6]: s for s in read(media).values()}
    samples, about = by_kind[b"sample"], by_kind[b"about\0"]
    payload = b"".join(samples.packets[1:])
    size, digest = struct.unpack("<QI", about.packets[1])
    if size != len(payload) or digest != zlib.crc32(payload) or samples.marks[-1][0] != size:
        raise ValueError("the samples differ from their description")
    return payload, samples


def features(payload: bytes, stream: Stream) -> str:
    """Duration by granule position, packets, and the samples' mean, deviation, zero crossings and 8-bin histogram."""
    x = np.frombuffer(payload, np.uint8)
    n, centred = len(x), x.view(np.int8) ^ np.int8(-128)
    total = int(x.sum(dtype=np.int64))
    square = int(np.dot(x.astype(np.float64), x.astype(np.float64)))
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    bins = np.bincount(x >> 5, minlength=8)
    return f"seconds={stream.seconds()[-1]:.6f};packets={len(stream.packets) - 1};mean={total / n:.6f};deviation={max(square / n - (total / n) ** 2, 0) ** 0.5:.6f};crossings={crossings};bins={'/'.join(map(str, bins.tolist()))}"


def describe(texts: Iterable[str | None]) -> list[tuple]:
    out = []
    for text in texts:
        payload, n = payload_of(text), len((text or "").encode())
        media = store(payload)
        back, stream = restore(media)
        out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(back, stream)))
    return out


def report(docs: DataFrame) -> DataFrame:
    """Per document: its payload as read back from Ogg, the stored form's digest and features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*describe(batch.column("text").to_pylist()), strict=True)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_rows(docs.select("doc_id", "text"), "text", run, REPORT)


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
