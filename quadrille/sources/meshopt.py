"""Decoding of compressed buffer views: vertex attributes, triangle indices, index sequences, and filters.

The vertex codec reads a block's deltas byte plane by byte plane and then sums whole planes at once.
"""

from __future__ import annotations

import numpy as np

#: Bits of a delta by group mode, for version 0 and the control modes of version 1.
_BITS = ((0, 2, 4, 8), (0, 1, 2, 4), (1, 2, 4, 8))


class MeshoptError(ValueError):
    pass


def _group(source: bytes, at: int, bits: int) -> tuple[np.ndarray, int]:
    """Sixteen deltas of some bits each; a value of all ones stands for a byte behind the group."""
    if bits == 0:
        return np.zeros(16, np.uint8), at
    if bits == 8:
        return np.frombuffer(source, np.uint8, 16, at), at + 16
    packed = np.frombuffer(source, np.uint8, 2 * bits, at)
    each = 8 // bits
    shifts = np.arange(each) * bits if bits == 1 else np.arange(each)[::-1] * bits
    out = ((packed[:, None] >> shifts) & ((1 << bits) - 1)).astype(np.uint8).reshape(-1)
    at += 2 * bits
    large = np.flatnonzero(out == (1 << bits) - 1)
    out[large] = np.frombuffer(source, np.uint8, len(large), at)
    return out, at + len(large)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> 1) ^ (0 - (x & 1)).astype(x.dtype)


def vertices(source: bytes, count: int, stride: int) -> bytes:
    if stride <= 0 or stride % 4:
        raise MeshoptError(f"a stride of {stride} isn't a multiple of 4")
    if not source or source[0] not in (0xA0, 0xA1):
        raise MeshoptError("no vertex header")
    version = source[0] & 15
    tail = stride + (stride // 4 if version else 0)
    if len(source) < 1 + tail:
        raise MeshoptError("the tail is cut off")
    base = np.frombuffer(source, np.uint8, stride, len(source) - tail).copy()
    channels = source[len(source) - tail + stride :] if version else bytes(stride // 4)
    if any(c & 3 == 3 for c in channels):
        raise MeshoptError("a reserved channel mode")
    most = max(1, min(256, (0x2000 // stride) & ~15))
    out, at = np.zeros((count, stride), np.uint8), 1
    try:
        for start in range(0, count, most):
            n = min(most, count - start)
            groups = (n + 15) // 16
            control = source[at : at + stride // 4] if version else bytes(stride // 4)
            at += stride // 4 if version else 0
            planes = np.zeros((stride, groups * 16), np.uint8)
            for k in range(stride):
                mode = control[k >> 2] >> (2 * (k & 3)) & 3
                if mode == 2:
                    continue
                if mode == 3:
                    planes[k, :n] = np.frombuffer(source, np.uint8, n, at)
                    at += n
                    continue
                bits = _BITS[mode + 1 if version else 0]
                heads, at = source[at : at + (groups + 3) // 4], at + (groups + 3) // 4
                for g in range(groups):
                    planes[k, 16 * g : 16 * g + 16], at = _group(source, at, bits[heads[g >> 2] >> (2 * (g & 3)) & 3])
            rows = np.ascontiguousarray(planes[:, :n].T)
            for c, channel in enumerate(channels):
                kind = ("<u1", "<u2", "<u4")[channel & 3]
                part = slice(4 * c, 4 * c + 4)
                deltas, first = np.ascontiguousarray(rows[:, part]).view(kind), base[part].view(kind)
                if kind == "<u4":
                    turn = channel >> 4
                    turned = (deltas >> np.uint32(turn)) | (deltas << np.uint32((32 - turn) % 32)) if turn else deltas
                    values = np.bitwise_xor.accumulate(np.concatenate([first[None], turned]), axis=0)[1:]
                else:
                    values = np.cumsum(np.concatenate([first[None], _unzigzag(deltas)]), axis=0, dtype=kind)[1:]
                out[start : start + n, part] = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(n, 4)
            base = out[start + n - 1].copy()
    except (ValueError, IndexError) as error:
        raise MeshoptError(f"the vertex data is cut off: {error}") from error
    if at != len(source) - max(tail, 24 if version else 32):
        raise MeshoptError(f"{at} bytes were read of {len(source)}")
    return out.tobytes()


def _varint(source: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = source[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128 or shift >= 35:
            return value & 0xFFFFFFFF, at


def _signed(value: int) -> int:
    return -(value >> 1) - 1 if value & 1 else value >> 1


class _Ring:
    """The sixteen values pushed last; ``back(0)`` is the newest."""

    def __init__(self, empty) -> None:
        self.values, self.head = [empty] * 16, 0

    def push(self, value) -> None:
        self.values[self.head] = value
        self.head = (self.head + 1) & 15

    def back(self, k: int):
        return self.values[(self.head - 1 - k) & 15]


def triangles(source: bytes, count: int) -> np.ndarray:
    if not source or source[0] not in (0xE0, 0xE1):
        raise MeshoptError("no index header")
    if count % 3 or len(source) < 1 + count // 3 + 16:
        raise MeshoptError("the index data is cut off")
    near = 13 if source[0] & 15 else 15
    table, at, fresh, last, out = source[-16:], 1 + count // 3, 0, 0, []
    edges, corners = _Ring((0, 0)), _Ring(0)

    def new() -> int:
        nonlocal fresh
        fresh += 1
        corners.push(fresh - 1)
        return fresh - 1

    def free() -> int:
        nonlocal at, last
        value, at = _varint(source, at)
        last = (last + _signed(value)) & 0xFFFFFFFF
        corners.push(last)
        return last

    try:
        for code in source[1 : 1 + count // 3]:
            low = code & 15
            if code < 0xF0:
                a, b = edges.back(code >> 4)
                if low == 0:
                    c = new()
                elif low < near:
                    c = corners.back(low)
                elif low < 15:
                    last = c = (last + (1 if low == 14 else -1)) & 0xFFFFFFFF
                    corners.push(c)
                else:
                    c = free()
                edges.push((c, b))
                edges.push((a, c))
            else:
                if code < 0xFE:
                    more, first = table[low], 0
                else:
                    more, first, at = source[at], 0 if code == 0xFE else 15, at + 1
                    if more == 0:
                        fresh = 0
                high, low = more >> 4, more & 15
                # Looked up before anything is pushed, given out in the order a, b, c.
                old_b, old_c = corners.back(high - 1), corners.back(low - 1)
                inline = code >= 0xFE
                marks, old = (first, high, low), (0, old_b, old_c)
                a, b, c = (None if m == 15 and inline else "new" if m == 0 else o for m, o in zip(marks, old, strict=True))
                got = []
                if inline and 15 in marks:
                    # New numbers come first, then what the data holds; corners are pushed in order afterwards.
                    numbers = []
                    for x in (a, b, c):
                        if x == "new":
                            numbers.append(fresh)
                            fresh += 1
                        else:
                            numbers.append(x)
                    for k, x in enumerate(numbers):
                        if x is None:
                            value, at = _varint(source, at)
                            last = (last + _signed(value)) & 0xFFFFFFFF
                            numbers[k] = last
                    for m, x in zip(marks, numbers, strict=True):
                        if m in (0, 15):
                            corners.push(x)
                    got = numbers
                else:
                    got = [new() if x == "new" else x for x in (a, b, c)]
                a, b, c = got
                edges.push((b, a))
                edges.push((c, b))
                edges.push((a, c))
            out += (a, b, c)
    except IndexError as error:
        raise MeshoptError("the index data is cut off") from error
    if at != len(source) - 16:
        raise MeshoptError(f"{at} bytes were read of {len(source)}")
    return np.array(out, np.uint32)


def sequence(source: bytes, count: int) -> np.ndarray:
    if not source or source[0] not in (0xD0, 0xD1):
        raise MeshoptError("no sequence header")
    out, at, last = np.zeros(count, np.uint32), 1, [0, 0]
    try:
        for k in range(count):
            value, at = _varint(source, at)
            which = value & 1
            last[which] = (last[which] + _signed(value >> 1)) & 0xFFFFFFFF
            out[k] = last[which]
    except IndexError as error:
        raise MeshoptError("the sequence is cut off") from error
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def octahedral(data: bytes, stride: int) -> bytes:
    if stride not in (4, 8):
        raise MeshoptError("octahedral vectors take 4 or 8 bytes")
    kind, top = ("<i1", 127.0) if stride == 4 else ("<i2", 32767.0)
    v = np.frombuffer(data, kind).reshape(-1, 4).copy()
    x, y = v[:, 0].astype(float), v[:, 1].astype(float)
    z = v[:, 2] - np.abs(x) - np.abs(y)
    fold = np.minimum(z, 0)
    x, y = np.where(x >= 0, x + fold, x - fold), np.where(y >= 0, y + fold, y - fold)
    size = np.sqrt(x * x + y * y + z * z)
    scale = np.divide(top, size, out=np.zeros_like(size), where=size > 0)
    v[:, :3] = _rounded(np.stack([x, y, z], 1) * scale[:, None]).astype(kind)
    return v.tobytes()


def quaternion(data: bytes, stride: int) -> bytes:
    if stride != 8:
        raise MeshoptError("quaternions take 8 bytes")
    v = np.frombuffer(data, "<i2").reshape(-1, 4)
    largest = v[:, 3] & 3
    xyz = v[:, :3] * (1 / np.sqrt(2.0) / (v[:, 3] | 3))[:, None]
    w = np.sqrt(np.maximum(0, 1 - (xyz * xyz).sum(axis=1)))
    out, rows = np.zeros_like(v), np.arange(len(v))
    for k in range(3):
        out[rows, (largest + 1 + k) % 4] = _rounded(xyz[:, k] * 32767.0).astype("<i2")
    out[rows, largest] = _rounded(w * 32767.0).astype("<i2")
    return out.tobytes()


def exponential(data: bytes, stride: int) -> bytes:
    if stride % 4:
        raise MeshoptError("exponential values take 4 bytes")
    v = np.frombuffer(data, "<i4")
    return np.ldexp(((v << 8) >> 8).astype(np.float64), v >> 24).astype("<f4").tobytes()


def color(data: bytes, stride: int) -> bytes:
    if stride not in (4, 8):
        raise MeshoptError("colours take 4 or 8 bytes")
    kind, signed, bits = ("<u1", "<i1", 8) if stride == 4 else ("<u2", "<i2", 16)
    v = np.frombuffer(data, kind).reshape(-1, 4)
    s = v.view(signed).astype(np.int64)
    y, co, cg, alpha = v[:, 0].astype(np.int64), s[:, 1], s[:, 2], v[:, 3].astype(np.int64)
    full = alpha.copy()
    for shift in (1, 2, 4, 8):
        full |= full >> shift
    a = ((alpha << 1) & full) | (alpha & 1)
    rgba = np.stack([y + co - cg, y + cg, y - co - cg, a], 1)
    scale = np.divide(float((1 << bits) - 1), full, out=np.zeros(len(full)), where=full > 0)
    return _rounded(rgba * scale[:, None]).astype(kind).tobytes()


_FILTERS = {"OCTAHEDRAL": octahedral, "QUATERNION": quaternion, "EXPONENTIAL": exponential, "COLOR": color}


def decode(mode: str, filter_: str, count: int, stride: int, source: bytes) -> bytes:
    """A buffer view's bytes."""
    if mode == "ATTRIBUTES":
        data = vertices(source, count, stride)
    elif mode in ("TRIANGLES", "INDICES"):
        if stride not in (2, 4):
            raise MeshoptError("indices take 2 or 4 bytes")
        data = (triangles if mode == "TRIANGLES" else sequence)(source, count).astype(f"<u{stride}").tobytes()
    else:
        raise MeshoptError(f"unknown mode {mode}")
    if filter_ in ("", "NONE"):
        return data
    if filter_ not in _FILTERS:
        raise MeshoptError(f"unknown filter {filter_}")
    return _FILTERS[filter_](data, stride)
