"""Reads FLAC streams of any block size, depth up to 32 bits, channels and predictors (RFC 9639), one frame after another."""

from __future__ import annotations

import hashlib

import numpy as np

from lodestar.llm.flac import FIXED, crc_of

#: Samples a block and bits a sample by their codes in a frame's header; 0 where the header or stream tells.
BLOCK_SIZES = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]
DEPTHS = [0, 8, 12, None, 16, 20, 24, 32]


class Bits:
    """Bits of a byte string, from the highest on."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("the stream ends early")
        value = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end & 7) & ((1 << n) - 1)
        self.at = end
        return value

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        """How many zero bits come before the next one, which is taken too."""
        n = 0
        while not (left := self.data[self.at >> 3] & (0xFF >> (self.at & 7))):
            n += 8 - (self.at & 7)
            self.at = (self.at | 7) + 1
        first = 8 - left.bit_length()
        n += first - (self.at & 7)
        self.at = (self.at & ~7) + first + 1
        return n


def _residuals(bits: Bits, size: int, order: int) -> list[int]:
    method, parts = bits.take(2), bits.take(4)
    if method > 1 or size % (1 << parts) or (size >> parts) < order:
        raise ValueError("a reserved residual coding")
    width, out = 4 + method, []
    for p in range(1 << parts):
        n = (size >> parts) - (order if p == 0 else 0)
        k = bits.take(width)
        if k == (1 << width) - 1:
            depth = bits.take(5)
            out += [bits.signed(depth) for _ in range(n)]
            continue
        for _ in range(n):
            code = bits.zeros() << k
            if k:
                code |= bits.take(k)
            out.append(code >> 1 ^ -(code & 1))
    return out


def _subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("a subframe begins with a one")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
    depth -= wasted
    if kind == 0:
        x = [bits.signed(depth)] * size
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        x, weights, shift = [bits.signed(depth) for _ in range(order)], FIXED[order] if kind < 32 else [], 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
            if precision == 16 or shift < 0:
                raise ValueError("a reserved linear predictor")
        for e in _residuals(bits, size, order):
            x.append(e + (sum(w * v for w, v in zip(weights, reversed(x[-order:] if order else []), strict=True)) >> shift))
    else:
        raise ValueError("a reserved kind of subframe")
    return np.array(x, np.int64) << wasted


def _checksum(data: bytes, begin: int, end: int, width: int) -> int:
    return int(crc_of(np.frombuffer(data, np.uint8), np.array([begin]), np.array([end - begin]), width)[0])


def decode(stream: bytes) -> tuple[bytes, list[tuple[int, int]], int]:
    """(samples, [(first sample, byte of its frame) of each frame], bits a sample); damage of any kind is a ValueError.

    Samples of up to 8 bits are unsigned bytes, others signed little-endian ones of 2 or 4 bytes; channels are interleaved.
    """
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info = 4, False, b""
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the metadata ends early")
        last, kind, n = stream[at] >> 7 == 1, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + n]
        at += 4 + n
    if len(info) < 34:
        raise ValueError("no STREAMINFO")
    packed, md5 = int.from_bytes(info[10:18], "big"), info[18:34]
    channels, depth, total = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
    blocks, parts, done = [], [], 0
    while at < len(stream):
        begin, bits = at, Bits(stream, at)
        if bits.take(14) != 0b11111111111110 or bits.take(1):
            raise ValueError("a frame header is not as expected")
        bits.take(1)
        size_code, rate_code, layout, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        if bits.take(1) or layout > 10 or size_code == 0 or rate_code == 15 or DEPTHS[depth_code] is None:
            raise ValueError("a frame header is not as expected")
        lead = bits.take(8)
        for _ in range(max(0, 7 - (lead ^ 0xFF).bit_length()) if lead & 0x80 else 0):
            bits.take(8)
        size = bits.take(8) + 1 if size_code == 6 else bits.take(16) + 1 if size_code == 7 else BLOCK_SIZES[size_code]
        bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        if _checksum(stream, begin, bits.at >> 3, 8) != bits.take(8):
            raise ValueError("a frame header's checksum is wrong")
        count, deep = (layout + 1 if layout < 8 else 2), DEPTHS[depth_code] or depth
        if count != channels or deep != depth:
            raise ValueError("a frame is of another kind than the stream")
        side = {8: 1, 9: 0, 10: 1}.get(layout)
        x = [_subframe(bits, size, deep + (c == side)) for c in range(count)]
        if layout == 8:
            x[1] = x[0] - x[1]
        elif layout == 9:
            x[0] = x[0] + x[1]
        elif layout == 10:
            middle = x[0] << 1 | (x[1] & 1)
            x = [(middle + x[1]) >> 1, (middle - x[1]) >> 1]
        end = (bits.at + 7) >> 3
        if end + 2 > len(stream) or _checksum(stream, begin, end, 16) != int.from_bytes(stream[end : end + 2], "big"):
            raise ValueError("a frame's checksum is wrong")
        blocks.append((done, begin))
        parts.append(np.stack(x, 1))
        done, at = done + size, end + 2
    samples = np.concatenate(parts).ravel() if parts else np.empty(0, np.int64)
    if total and total != done:
        raise ValueError("the stream has fewer or more samples than it says")
    width = (depth + 7) // 8
    if md5 != b"\0" * 16 and hashlib.md5(samples.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest() != md5:
        raise ValueError("the samples are not those of the stream's MD5")
    kind = np.uint8 if depth <= 8 else "<i2" if depth <= 16 else "<i4"
    return (samples + 128 if depth <= 8 else samples).astype(kind).tobytes(), blocks, depth
