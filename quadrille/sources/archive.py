"""Packed tileset archives (.3tz): ZIP files whose last entry indexes the others by the MD5 of their path.

``read_archives`` plans on the files' tails alone: each archive's index becomes rows, spans come from a
window over offsets, and entries are then read by range, each in a task of its own choosing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The index entry's name, and the format's signatures.
INDEX_NAME = "@3dtilesIndex1@"
_LOCAL, _CENTRAL, _END, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x07"
_DATE = 0x2199
#: Bytes of a file's tail that opening reads; entries longer than MOST_SPAN are read in two steps.
TAIL, MOST_SPAN, OVER = 512 << 10, 64 << 20, 4096
_LOCAL_HEAD, _CENTRAL_HEAD, _END_HEAD = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")


class ArchiveError(ValueError):
    pass


def normalized(path: str) -> str:
    return path.replace("\\", "/").lstrip("/")


def sort_key(hash_: bytes) -> tuple[int, int]:
    return struct.unpack("<QQ", hash_)


def _extra64(extra: bytes, rank: int) -> int | None:
    """The rank-th 64-bit value of a ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        body = extra[at + 4 : at + 4 + size]
        if len(body) < size:
            return None
        if kind == 1:
            return struct.unpack_from("<Q", body, 8 * rank)[0] if 8 * rank + 8 <= size else None
        at += 4 + size
    return None


@dataclass(frozen=True)
class End:
    at: int
    directory: int
    size: int


def find_end(tail: bytes, start: int) -> End:
    """The end record: the last signature whose comment runs to the end of the file."""
    at = len(tail) - _END_HEAD.size
    while at >= 0 and (at := tail.rfind(_END, 0, at + 4)) >= 0:
        *_, size, offset, comment = _END_HEAD.unpack_from(tail, at)
        if at + _END_HEAD.size + comment == len(tail):
            if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR64:
                record = struct.unpack_from("<Q", tail, at - 12)[0] - start
                if record < 0:
                    raise ArchiveError("the ZIP64 end record is outside of the tail")
                size, offset = struct.unpack_from("<QQ", tail, record + 40)
            return End(start + at, offset, size)
        at -= 1
    raise ArchiveError("not a ZIP file")


def find_index(tail: bytes, start: int, end: End) -> tuple[int, int]:
    """(offset, stored size) of the index, the last entry of the central directory."""
    name, stop = INDEX_NAME.encode(), end.directory + end.size - start
    at = stop - _CENTRAL_HEAD.size - len(name)
    while at >= 0 and (at := tail.rfind(_CENTRAL, 0, at + 4)) >= 0:
        _, _, _, _, method, _, _, _, packed, full, n, extra, comment, _, _, _, offset = _CENTRAL_HEAD.unpack_from(tail, at)
        body = at + _CENTRAL_HEAD.size
        if n == len(name) and not comment and body + n + extra == stop and tail[body : body + n] == name:
            if method:
                raise ArchiveError("the index is compressed")
            more = tail[body + n : body + n + extra]
            if packed == 0xFFFFFFFF and (packed := _extra64(more, full == 0xFFFFFFFF)) is None:
                raise ArchiveError("a saturated size without its ZIP64 value")
            if offset == 0xFFFFFFFF and (offset := _extra64(more, (full == 0xFFFFFFFF) + (packed > 0xFFFFFFFE))) is None:
                raise ArchiveError("a saturated offset without its ZIP64 value")
            return offset, packed
        at -= 1
    raise ArchiveError("no index")


def local_header(data: bytes) -> tuple[int, int | None, bytes, int]:
    """(method, stored size or None where it follows the data, name, bytes before the data)."""
    if len(data) < _LOCAL_HEAD.size or data[:4] != _LOCAL:
        raise ArchiveError("no local header")
    _, _, flags, method, _, _, _, packed, _, n, extra = _LOCAL_HEAD.unpack_from(data)
    head = _LOCAL_HEAD.size + n + extra
    name = data[_LOCAL_HEAD.size : _LOCAL_HEAD.size + n]
    if len(name) < n:
        raise ArchiveError("a local header is cut off")
    if packed == 0xFFFFFFFF:
        packed = _extra64(data[_LOCAL_HEAD.size + n : head], 1)
        if packed is None:
            raise ArchiveError("a saturated size without its ZIP64 value")
    elif not packed and flags & 8:
        packed = None
    return method, packed, name, head


def decoded(method: int, data: bytes) -> bytes:
    """An entry's content; checksums aren't verified, since writers leave them zero."""
    if method == 0:
        return data
    if method == 8:
        try:
            return zlib.decompress(data, -15)
        except zlib.error as error:
            raise ArchiveError(f"deflate failed: {error}") from error
    raise ArchiveError("zstandard entries aren't supported" if method == 93 else f"compression method {method} isn't supported")


def parse_index(payload: bytes) -> list[tuple[bytes, int]]:
    """(hash, offset) records, in the order of their sort key whatever order they are stored in."""
    if len(payload) % 24:
        raise ArchiveError("the index isn't whole records")
    return sorted(((payload[i : i + 16], struct.unpack_from("<Q", payload, i + 16)[0]) for i in range(0, len(payload), 24)), key=lambda r: sort_key(r[0]))


def write_3tz(files: Iterable[tuple[str, bytes, bool]], comment: bytes = b"") -> bytes:
    """An archive of (path, content, whether to deflate); equal input gives equal bytes."""
    out, entries = bytearray(), []

    def put(name: bytes, data: bytes, deflate: bool) -> int:
        at, method, packed = len(out), 0, data
        if deflate:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            method, packed = 8, packer.compress(data) + packer.flush()
        out.extend(_LOCAL_HEAD.pack(_LOCAL, 20, 0, method, 0, _DATE, 0, len(packed), len(data), len(name), 0) + name + packed)
        entries.append(_CENTRAL_HEAD.pack(_CENTRAL, 20, 20, 0, method, 0, _DATE, 0, len(packed), len(data), len(name), 0, 0, 0, 0, 0, at) + name)
        return at

    records = []
    for path, data, deflate in files:
        name = normalized(path).encode()
        records.append((hashlib.md5(name).digest(), put(name, data, deflate)))
    records.sort(key=lambda r: sort_key(r[0]))
    put(INDEX_NAME.encode(), b"".join(h + struct.pack("<Q", at) for h, at in records), False)
    directory = b"".join(entries)
    return bytes(out) + directory + _END_HEAD.pack(_END, 0, 0, len(entries), len(entries), len(directory), len(out), len(comment)) + comment


class Archive:
    """Random access to one archive through ``read(start, size)``; opening takes a tail and, for a long index, one more read."""

    def __init__(self, read, size: int) -> None:
        self.read, self.size = read, size
        start = max(0, size - TAIL)
        tail = read(start, size - start)
        self.end = find_end(tail, start)
        if self.end.directory < start:
            tail, start = read(self.end.directory, size - self.end.directory), self.end.directory
        offset, packed = find_index(tail, start, self.end)
        get = lambda a, n: tail[a - start : a - start + n] if a >= start else read(a, n)
        _, _, _, head = local_header(get(offset, _LOCAL_HEAD.size + len(INDEX_NAME) + OVER))
        self.records = parse_index(get(offset + head, packed))
        self.index_at = offset
        ordered = sorted({at for _, at in self.records}) + [offset]
        self.stop = dict(zip(ordered, ordered[1:], strict=False))

    def entry(self, path: str) -> bytes:
        name = normalized(path).encode()
        wanted = hashlib.md5(name).digest()
        for hash_, at in self.records:
            if hash_ == wanted and (found := self.at(at, name)) is not None:
                return found
        raise ArchiveError(f"no entry {path}")

    def at(self, offset: int, name: bytes | None = None) -> bytes | None:
        """The entry at an offset; None if it has another name."""
        span = self.stop[offset] - offset
        data = self.read(offset, span if span <= MOST_SPAN else _LOCAL_HEAD.size + OVER)
        method, packed, own, head = local_header(data)
        if name is not None and own != name:
            return None
        if packed is None:
            raise ArchiveError("sizes behind the data aren't supported")
        body = data[head : head + packed] if head + packed <= len(data) else self.read(offset + head, packed)
        if len(body) < packed:
            raise ArchiveError("an entry is cut off")
        return decoded(method, body)


def spans(index: DataFrame, group: str, start: str, most: int = MOST_SPAN) -> DataFrame:
    """``index`` with span, the bytes up to the next entry; null for the last and above ``most``."""
    span = F.lead(start).over(Window.partitionBy(group).orderBy(start)) - F.col(start)
    return index.withColumn("span", F.when(span <= most, span))


_ENTRIES = "archive string, path string, data binary, error string"


def read_archives(archives: DataFrame) -> DataFrame:
    """(archive, path, data, error) of all entries of rows (path, content) as binaryFile gives them.

    An entry that can't be read has its error instead of data, and so has an archive that can't be opened.
    """

    def run(batches):
        for frame in batches:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    opened = Archive(lambda a, n, c=content: bytes(c[a : a + n]), len(content))
                    for _, at in opened.records:
                        try:
                            _, _, name, _ = local_header(bytes(content[at : at + 65536 + 64]))
                            rows.append((archive, name.decode("utf-8", "replace"), opened.at(at), None))
                        except ArchiveError as error:
                            rows.append((archive, None, None, str(error)))
                except (ArchiveError, struct.error) as error:
                    rows.append((archive, None, None, str(error)))
                for i in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[i : i + 64], columns=["archive", "path", "data", "error"])

    from quadrille.ship import ship

    ship(archives.sparkSession)
    return archives.select("path", "content").mapInPandas(run, _ENTRIES)


def write_archives(entries: DataFrame, comment: bytes = b"") -> DataFrame:
    """(archive, content): one archive for each value of ``archive``, of rows (archive, path, data, deflate)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        files = frame.sort_values("path")
        content = write_3tz(((p, bytes(d), bool(z)) for p, d, z in zip(files["path"], files["data"], files["deflate"], strict=True)), comment)
        return pd.DataFrame({"archive": [frame["archive"].iloc[0]], "content": [content]})

    from quadrille.ship import ship

    ship(entries.sparkSession)
    return entries.groupBy("archive").applyInPandas(run, "archive string, content binary")


def load(spark: SparkSession, path: str) -> DataFrame:
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.3tz").load(path))
