"""FLAC for mono 8-bit samples, many streams at once.

Arrays run over frames (when writing) or over seek points (when reading), so that a step of the Rice decoder or of a
predictor handles thousands of frames in one array operation. Streams follow the public FLAC format (RFC 9639):
STREAMINFO with the MD5 of the samples, a SEEKTABLE, and frames of BLOCK samples with CRC-8 and CRC-16.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np

BLOCK, RATE, SEEK_FRAMES = 192, 8000, 8
PRECISION, SHIFT = 8, 6
#: Frames that are written, and bytes of frames that are read, in one go: the bound of memory.
AT_ONCE, READ_AT_ONCE = 1536, 1_500_000
#: Predictors of the format's fixed subframes: weights of the samples before, the nearest first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: Number of the predictor that is fitted to each frame, after the fixed ones.
LINEAR = len(FIXED)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of ranges of data."""
    table, top, mask = (CRC8, 0, 0xFF) if bits == 8 else (CRC16, 8, 0xFFFF)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, crc = starts[order], lengths[order], np.zeros(len(starts), np.int64)
    live = len(starts)
    for i in range(int(lengths[0]) if len(lengths) else 0):
        while lengths[live - 1] <= i:
            live = int(np.searchsorted(-lengths, -i, "left"))
        crc[:live] = (crc[:live] << 8 & mask) ^ table[(crc[:live] >> top) ^ data[starts[:live] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _residuals(x: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x minus its prediction; the first samples, as many as weights, are kept."""
    n = weights.shape[1]
    guess = np.zeros((len(x), BLOCK - n), np.int32)
    for j in range(n):
        guess += weights[:, j : j + 1] * x[:, n - 1 - j : BLOCK - 1 - j]
    return x[:, n:] - (guess >> shift[:, None])


def _linear(x: np.ndarray) -> np.ndarray:
    """Two quantised weights for each frame, by its autocorrelation."""
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1
    safe = np.where(det > 0, det, 1)
    a = np.stack([r1 * (r0 - r2) / safe, (r0 * r2 - r1 * r1) / safe], 1)
    a[det <= 0] = 0
    return np.clip(np.round(a * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


def _coded_number(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of up to 6 bytes, number of bytes) of frame numbers in the format's UTF-8 like code."""
    size = 1 + sum((number >= limit).astype(np.int64) for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    out = np.zeros((len(number), 6), np.uint8)
    for n in range(1, 7):
        rows = size == n
        if rows.any():
            v = number[rows]
            out[rows, 0] = v if n == 1 else (0xFF00 >> n & 0xFF) | (v >> (6 * (n - 1)))
            for i in range(1, n):
                out[rows, i] = 0x80 | (v >> (6 * (n - 1 - i)) & 0x3F)
    return out, size


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(coded frames one after another, bytes of each) of rows of samples with these frame numbers."""
    # Of six predictors, the one whose residuals are least in all. Fixed ones are differences of differences.
    lpc = _linear(x)
    codes = [_zigzag(np.diff(x, o)) for o in range(len(FIXED))] + [_zigzag(_residuals(x, lpc, np.full(len(x), SHIFT, np.int32)))]
    chosen = np.argmin(np.stack([u.sum(1) + 24 * (k == LINEAR) for k, u in enumerate(codes)], 1), 1)
    order = np.array([*range(len(FIXED)), 2])[chosen]
    u = np.zeros((len(x), BLOCK), np.int32)  # codes at their sample's place; the warm-up has none
    for k, c in enumerate(codes):
        rows = chosen == k
        u[rows, BLOCK - c.shape[1] :] = c[rows]
    coded = np.arange(BLOCK)[None, :] >= order[:, None]
    costs = np.stack([(u >> k).sum(1) + (BLOCK - order) * (k + 1) for k in range(11)], 1)
    k = np.argmin(costs, 1)
    sub_bits = 8 + order * 8 + np.where(chosen == LINEAR, 4 + 5 + 2 * PRECISION, 0) + 10 + costs[np.arange(len(x)), k]
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (sub_bits >= 8 + 8 * BLOCK)
    rice = ~constant & ~verbatim
    sub_bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, sub_bits))

    coded_number, number_bytes = _coded_number(number)
    head = 4 + number_bytes + 1
    size = head + (sub_bits + 7) // 8 + 2
    starts = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, n: int) -> None:
        for j in range(n):
            bits[at + j] = value >> (n - 1 - j) & 1

    at = (starts + head) * 8
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(chosen == LINEAR, 0b100000 | 1, 0b001000 | order)))
    put(at, kind << 1, 8)
    at = at + 8
    put(at[constant], x[constant, 0] & 0xFF, 8)
    if verbatim.any():
        bits[(at[verbatim][:, None] + np.arange(8 * BLOCK)).ravel()] = np.unpackbits(x[verbatim].astype(np.int8).view(np.uint8))
    for i in range(len(FIXED) - 1):
        rows = rice & (order > i)
        put(at[rows] + 8 * i, x[rows, i] & 0xFF, 8)
    at = at + 8 * order
    rows = rice & (chosen == LINEAR)
    put(at[rows], np.full(rows.sum(), PRECISION - 1), 4)
    put(at[rows] + 4, np.full(rows.sum(), SHIFT), 5)
    for i in range(2):
        put(at[rows] + 9 + PRECISION * i, lpc[rows, i] & ((1 << PRECISION) - 1), PRECISION)
    at = at + np.where(chosen == LINEAR, 9 + 2 * PRECISION, 0)
    put(at[rice] + 6, k[rice], 4)  # method 0, partition order 0
    if rice.any():
        ur, kr, cr = u[rice], k[rice][:, None], coded[rice]
        quotient = ur >> kr
        length = np.where(cr, quotient + 1 + kr, 0)
        ends = (at[rice] + 10)[:, None] + np.cumsum(length, 1) - length + quotient
        bits[ends[cr]] = 1
        for j in range(int(kr.max())):
            there = cr & (kr > j)
            bits[ends[there] + 1 + j] = (ur >> np.maximum(kr - 1 - j, 0) & 1)[there]
    data = np.packbits(bits)
    data[starts], data[starts + 1], data[starts + 2], data[starts + 3] = 0xFF, 0xF8, 0x14, 0x02
    for i in range(6):
        rows = number_bytes > i
        data[starts[rows] + 4 + i] = coded_number[rows, i]
    data[starts + head - 1] = crc_of(data, starts, head - 1, 8)
    crc = crc_of(data, starts, size - 2, 16)
    data[starts + size - 2], data[starts + size - 1] = crc >> 8, crc & 0xFF
    return data.tobytes(), size


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each of a positive multiple of BLOCK bytes; a sample is a byte less 128."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    if (sizes % BLOCK).any() or (sizes == 0).any():
        raise ValueError(f"payloads must have a positive multiple of {BLOCK} bytes")
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    rows = raw.reshape(-1, BLOCK)
    frames = sizes // BLOCK
    first = np.cumsum(frames) - frames
    number = np.arange(len(rows)) - np.repeat(first, frames)
    parts = [_frames(rows[a : a + AT_ONCE].astype(np.int32) - 128, number[a : a + AT_ONCE]) for a in range(0, len(rows), AT_ONCE)]
    body = b"".join(p for p, _ in parts)
    size = np.concatenate([s for _, s in parts]) if parts else np.empty(0, np.int64)
    starts, out = np.cumsum(size) - size, []
    signed = (raw ^ 0x80).tobytes()
    from_sample = np.cumsum(sizes) - sizes
    for d in range(len(payloads)):
        f0, f1, n = int(first[d]), int(first[d] + frames[d]), int(sizes[d])
        lo, hi = int(starts[f0]), int(starts[f1 - 1] + size[f1 - 1])
        points = b"".join(struct.pack(">QQH", (f - f0) * BLOCK, int(starts[f]) - lo, BLOCK) for f in range(f0, f1, SEEK_FRAMES))
        md5 = hashlib.md5(signed[int(from_sample[d]) : int(from_sample[d]) + n]).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + b"\0" * 6 + ((RATE << 44) | (7 << 36) | n).to_bytes(8, "big") + md5
        out.append(b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + body[lo:hi])
    return out


def _metadata(stream: bytes) -> tuple[int, bytes, list[tuple[int, int]], int]:
    """(samples, MD5, seek points as (sample, byte after the metadata), byte where frames start)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, samples, md5, points = 4, None, b"", []
    while True:
        flag, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + n]
        at += 4 + n
        if flag & 0x7F == 0:
            packed = int.from_bytes(block[10:18], "big")
            if packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise ValueError("only mono 8-bit streams are read")
            samples, md5 = packed & ((1 << 36) - 1), block[18:34]
        elif flag & 0x7F == 3:
            points = [struct.unpack_from(">QQ", block, i) for i in range(0, n - 17, 18) if block[i : i + 8] != b"\xff" * 8]
        if flag & 0x80:
            break
    if samples is None:
        raise ValueError("no STREAMINFO")
    if samples > BLOCK * len(stream) or any(byte >= len(stream) for _, byte in points):
        raise ValueError("the metadata doesn't fit the stream")
    return samples, md5, points or [(0, 0)], at


def is_own(stream: bytes) -> bool:
    """Whether decode() reads a stream: mono, 8 bits, blocks of BLOCK samples, as its metadata says."""
    info = stream[8:42] if stream[:4] == b"fLaC" and len(stream) >= 42 and stream[4] & 0x7F == 0 else b""
    return info[:4] == struct.pack(">HH", BLOCK, BLOCK) and int.from_bytes(info[10:18], "big") >> 36 & 0xFF == 7


def _read(raw: np.ndarray, at: np.ndarray, stop: np.ndarray, sample: np.ndarray, pcm: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Decodes the frames from `at` to `stop` of raw into pcm, from `sample` on; gives (first samples, bytes) of frames."""
    window = np.zeros(len(raw) - 8, np.uint64)  # at each byte: the next eight bytes
    for j in range(8):
        window = (window << np.uint64(8)) | raw[j : j + len(window)]

    def bits_at(pos: np.ndarray, n) -> np.ndarray:
        """n bits, 1 to 32, at bit positions."""
        w = window[pos >> 3] << (pos & 7).astype(np.uint64)
        return (w >> (np.uint64(64) - np.asarray(n).astype(np.uint64))).astype(np.int64)

    def signed(v: np.ndarray, n) -> np.ndarray:
        return v - ((v >> (n - 1) & 1) << n)

    while len(at):
        if ((raw[at] != 0xFF) | (raw[at + 1] != 0xF8) | (raw[at + 2] >> 4 != 1) | (raw[at + 3] >> 4 != 0) | (~np.isin(raw[at + 3], (0x00, 0x02)))).any():
            raise ValueError("a frame header is not as expected")
        lead = raw[at + 4].astype(np.int64)
        number_bytes = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
        head = 4 + number_bytes
        if (crc_of(raw, at, head, 8) != raw[at + head]).any():
            raise ValueError("a frame header's checksum is wrong")
        pos = (at + head + 1) * 8
        kind = bits_at(pos, 8) >> 1
        pos = pos + 8
        n = len(at)
        constant, verbatim, lpc = kind == 0, kind == 1, kind >= 32
        order = np.where(lpc, (kind & 31) + 1, np.where((kind & 0b111000) == 0b001000, kind & 7, 0))
        rice = lpc | ((kind & 0b111000) == 0b001000)
        if not (constant | verbatim | rice).all():
            raise ValueError("a reserved kind of subframe")
        x = np.zeros((BLOCK, n), np.int64)
        if constant.any():
            x[:, constant] = signed(bits_at(pos[constant], 8), 8)
            pos[constant] += 8
        if verbatim.any():
            x[:, verbatim] = raw[(pos[verbatim] >> 3)[None, :] + np.arange(BLOCK)[:, None]].astype(np.int8)
            pos[verbatim] += 8 * BLOCK
        if rice.any():
            rows = np.flatnonzero(rice)
            p, o, most = pos[rows], order[rows], int(order[rows].max())
            y = np.zeros((BLOCK, len(rows)), np.int64)
            for i in range(most):
                y[i] = np.where(o > i, signed(bits_at(p + 8 * i, 8), 8), 0)
            p = p + 8 * o
            weights, shift = np.zeros((max(most, 1), len(rows)), np.int64), np.zeros(len(rows), np.int64)
            for q in range(1, min(most, 4) + 1):
                for j, w in enumerate(FIXED[q]):
                    weights[j, ~lpc[rows] & (o == q)] = w
            l = np.flatnonzero(lpc[rows])
            if len(l):
                precision = bits_at(p[l], 4) + 1
                shift[l] = signed(bits_at(p[l] + 4, 5), 5)
                p[l] += 9
                for j in range(int(o[l].max())):
                    some = l[o[l] > j]
                    width = precision[o[l] > j]
                    weights[j, some] = signed(bits_at(p[some], width), width)
                    p[some] += width
            method, parts = bits_at(p, 2), bits_at(p + 2, 4)
            if (method > 1).any():
                raise ValueError("a reserved residual coding")
            width = 4 + method
            p = p + 6
            span = BLOCK >> parts
            k, escaped = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            for i in range(BLOCK):
                fresh = (i % span == 0) if i else np.ones(len(rows), bool)
                if fresh.any():
                    k = np.where(fresh, bits_at(p, width), k)
                    p = p + np.where(fresh, width, 0)
                    escaped = np.where(fresh, k == (1 << width) - 1, escaped)
                    raw_bits = fresh & escaped
                    if raw_bits.any():
                        k = np.where(raw_bits, bits_at(p, 5), k)
                        p = p + np.where(raw_bits, 5, 0)
                due = i >= o
                w = window[p >> 3] << (p & 7).astype(np.uint64)
                top = (w >> np.uint64(32)).astype(np.float64)
                quotient = 32 - np.frexp(top)[1].astype(np.int64)
                more = due & ~escaped & (top == 0)
                while more.any():  # a run of zeros that is longer than the window
                    w2 = window[(p + quotient) >> 3] << ((p + quotient) & 7).astype(np.uint64)
                    t2 = (w2 >> np.uint64(32)).astype(np.float64)
                    quotient = np.where(more, quotient + 32 - np.frexp(t2)[1], quotient)
                    more &= t2 == 0
                after = p + quotient + 1
                rest = window[after >> 3] << (after & 7).astype(np.uint64)
                code = (quotient << k) | np.where(k > 0, (rest >> (64 - np.maximum(k, 1)).astype(np.uint64)).astype(np.int64), 0)
                value = (code >> 1) ^ -(code & 1)
                used = quotient + 1 + k
                if escaped.any():
                    plain = np.where(k > 0, (w >> (64 - np.maximum(k, 1)).astype(np.uint64)).astype(np.int64), 0)
                    value = np.where(escaped, np.where(k > 0, signed(plain, np.maximum(k, 1)), 0), value)
                    used = np.where(escaped, k, used)
                p = p + np.where(due, used, 0)
                guess = np.zeros(len(rows), np.int64)
                for j in range(min(most, i)):
                    guess += weights[j] * y[i - 1 - j]
                y[i] = np.where(due, value + (guess >> shift), y[i])
            x[:, rows] = y
            pos[rows] = p
        end = (pos + 7) // 8
        if (crc_of(raw, at, end - at, 16) != (raw[end].astype(np.int64) << 8 | raw[end + 1])).any():
            raise ValueError("a frame's checksum is wrong")
        pcm[(sample[:, None] + np.arange(BLOCK)).ravel()] = x.T.ravel()
        yield sample, at
        at, sample = end + 2, sample + BLOCK
        left = at < stop
        at, sample, stop = at[left], sample[left], stop[left]


def decode(streams: list[bytes]) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """(payload bytes, [(first sample, byte of its frame in the stream) of each frame]) of every stream.

    Frames between two seek points are read one after another, those of different seek points side by side. A wrong
    checksum of a header, a frame or a whole stream is an error.
    """
    meta = [_metadata(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    raw = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
    sample_base = np.cumsum([0, *[m[0] for m in meta]])
    pcm = np.zeros(int(sample_base[-1]), np.int8)

    units = [(base[d] + m[3] + byte, base[d] + m[3] + (m[2][i + 1][1] if i + 1 < len(m[2]) else len(streams[d]) - m[3]), sample_base[d] + sample) for d, m in enumerate(meta) for i, (sample, byte) in enumerate(m[2])]
    at, stop, sample = (np.array(c, np.int64) for c in zip(*units, strict=True)) if units else (np.empty(0, np.int64),) * 3
    found: list[tuple[np.ndarray, np.ndarray]] = []
    done = 0
    while done < len(at):  # seek points whose frames lie in the next stretch of bytes
        end = max(done + 1, int(np.searchsorted(stop, at[done] + READ_AT_ONCE, "right")))
        lo = int(at[done])
        for begun, places in _read(raw[lo : int(stop[end - 1]) + 16], at[done:end] - lo, stop[done:end] - lo, sample[done:end], pcm):
            found.append((begun, places + lo))
        done = end

    bytes_ = pcm.view(np.uint8).tobytes()
    samples, places = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    by_sample = np.argsort(samples, kind="stable")
    samples, places = samples[by_sample], places[by_sample]
    out, blocks = [], []
    for d, m in enumerate(meta):
        lo, hi = int(sample_base[d]), int(sample_base[d + 1])
        mine = bytes_[lo:hi]
        if m[1] != b"\0" * 16 and hashlib.md5(mine).digest() != m[1]:
            raise ValueError("the samples are not those of the stream's MD5")
        a, b = np.searchsorted(samples, [lo, hi])
        out.append(mine)
        blocks.append(list(zip((samples[a:b] - lo).tolist(), (places[a:b] - base[d]).tolist(), strict=True)))
    flip = bytes.maketrans(bytes(range(256)), bytes(i ^ 0x80 for i in range(256)))
    return [p.translate(flip) for p in out], blocks
