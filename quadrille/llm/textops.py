"""Whole-batch text kernels: words, word hashes and shingles straight from Arrow's UTF-8 buffers.

Every kernel works on one concatenated byte buffer with document offsets, so the
cost per document is a few vector operations rather than a Python loop over words.
Nulls are empty texts.  Hashes are 64 bits wide and do not depend on the process; they only propose what
may be equal where a result depends on equality (operators 2 and 4 compare the words themselves).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one kernel call sees at most, except where a single text is longer.
SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
#: A-Z to a-z, nothing else.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: ``[^\x20\x09-\x0D]``
NONSPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z and all of non-ASCII.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Longest word that is hashed as rows of an array.
_LONG = 256


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes of text (or a single row)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = lut[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = offs[1:-1]
    before[cut[cut < len(data)]] = False
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time through ``mix``; long words by BLAKE2.

    Every step mixes all bits, so no pattern of bytes makes words meet (sums of powers have such patterns).
    """
    size = ends - starts
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, at, left = np.flatnonzero((size > 0) & (size <= _LONG)), starts, size
    if len(live) < len(size):
        at, left = starts[live], size[live]
    while len(live):
        chunk = eight[at]
        short = left < 8
        chunk[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
        out[live] = mix(out[live] ^ chunk)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left ^ (left >> U64(31))) * U64(0xD6E8FEB86659FD93) + right)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words from each word that has k - 1 after it; equal runs are equal wherever they stand.

    Runs of 1, 2, 4, ... words are joined, in log2(k) passes.
    """
    count = len(hashes) - k + 1
    if count <= 0:
        return np.zeros(0, U64)
    out, have, power, size = None, 0, hashes, 1
    while True:
        if k & size:
            part = power[have : have + count]
            out = part if out is None else _joined(out[:count], part)
            have += size
        if have == k:
            return out[:count]
        power = _joined(power[:-size], power[size:])
        size *= 2


def sequence_hash(hashes: np.ndarray) -> int:
    """A 64-bit hash of all of the words together, of any number."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little")


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The words' bytes."""
    if not len(starts):
        return []
    low = int(starts[0])
    raw = data[low : int(ends[-1])].tobytes()
    return [raw[a:b] for a, b in zip((starts - low).tolist(), (ends - low).tolist(), strict=True)]


def starts_of_runs(word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all k-word runs inside documents, and each document's first run (one more at the end)."""
    counts = np.maximum(np.diff(word_offs) - k + 1, 0)
    run_offs = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(run_offs[-1]) + np.repeat(word_offs[:-1] - run_offs[:-1], counts)
    return first, run_offs


def word_array(points: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """The words, as UTF-8, of text given as code points: those marked inside, cut at the marked starts."""
    some, at = points[inside], np.flatnonzero(starts)
    ends = np.cumsum(1 + (some >= 0x80) + (some >= 0x800) + (some >= 0x10000).astype(np.int64))
    raw = some.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    offs = np.concatenate([[0], ends])[np.append((np.cumsum(inside) - inside)[at], len(some))].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(raw)])


def distinct(words: pa.BinaryArray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and each word's place among them."""
    coded = words.dictionary_encode()
    _, offs, data = coded.dictionary.buffers()
    raw, offs = data.to_pybytes() if data is not None else b"", np.frombuffer(offs, np.int32).tolist()
    return [raw[a:b] for a, b in zip(offs, offs[1 : len(coded.dictionary) + 1], strict=False)], coded.indices.to_numpy()
