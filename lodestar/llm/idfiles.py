"""Token-id shard files with a minimal perfect hash index.

A shard is two files. `<name>.ids`: 16 bytes of header (magic, width of an id in bytes, version), then the ids of its
documents one after another, little-endian. `<name>.mph`: a minimal perfect hash of the document keys; in hash order a
slot of 20 bytes for each (32-bit fingerprint, id offset, id count); then the document keys in file order, to list a
shard. A lookup hashes the key, reads one slot, compares the fingerprint and reads one range of the payload: constant
time, whatever the number of documents.

The hash is built level by level. A level has a bit for about GAMMA keys; a key whose bit no other key wants is placed
there, the others go on to the next level. The rank of a key's bit among all set bits is its slot.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

MAGIC_IDS, MAGIC_MPH = b"TIDS", b"TMPH"
GAMMA = 2.0
LEVELS = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


def key_of(doc_id: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit keys of (doc_id, number of the row among rows of that id, whether the id is null)."""
    return mix(mix(np.asarray(doc_id).astype(np.int64).view(np.uint64)) + np.asarray(occurrence, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(null, np.uint64))


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((0xD6E8FEB86659FD93 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Levels of bits; `ranks` counts set bits before each level."""

    bits: list[np.ndarray]

    def __post_init__(self) -> None:
        self.ranks, before = [], 0
        for b in self.bits:
            self.ranks.append(before + np.concatenate([[0], np.cumsum(b, dtype=np.int64)]))
            before += int(b.sum())
        self.n = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys = np.asarray(keys, np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        bits = []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(8, int(GAMMA * len(keys)) | 1)
            at = _slot(keys, level, size)
            wanted = np.bincount(at, minlength=size)
            bits.append((wanted == 1).astype(np.uint8))
            keys = keys[wanted[at] != 1]
        if len(keys):
            raise ValueError("the keys could not be placed")
        return cls(bits)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 for a key that falls through every level and so is certainly absent."""
        keys = np.asarray(keys, np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, b in enumerate(self.bits):
            at = _slot(keys[left], level, len(b))
            hit = b[at] == 1
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(np.asarray(keys, np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def occurrences(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many earlier rows have the same id, for ids in sorted order."""
    n = len(ids)
    if not n:
        return np.empty(0, np.int64)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))


SLOT = np.dtype([("print", "<u4"), ("start", "<u8"), ("count", "<u8")])
LISTED = np.dtype([("id", "<i8"), ("null", "u1")])


def index_bytes(ids: np.ndarray, null: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    """The .mph file of a shard whose documents are in sorted order: head (with its checksum), slots, list, checksum of both."""
    keys = key_of(ids, occurrences(ids, null), null)
    h = PerfectHash.build(keys)
    slots, listed = np.empty(len(keys), SLOT), np.empty(len(keys), LISTED)
    at = h.slot(keys)
    slots["print"][at], slots["start"][at], slots["count"][at] = fingerprint(keys), starts, counts
    listed["id"], listed["null"] = ids, null
    head = MAGIC_MPH + struct.pack(f"<QI{len(h.bits)}Q", len(keys), len(h.bits), *map(len, h.bits)) + b"".join(np.packbits(b).tobytes() for b in h.bits)
    body = slots.tobytes() + listed.tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + body + struct.pack("<I", zlib.crc32(body))


class ShardIndex:
    """A .mph file, read by ranges: read(offset, bytes) gives bytes. Opening it reads the hash, a lookup its keys' slots."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        start = read(0, 16)
        if start[:4] != MAGIC_MPH:
            raise ValueError("not an index file")
        self.n, levels = struct.unpack_from("<QI", start, 4)
        sizes = struct.unpack(f"<{levels}Q", read(16, 8 * levels))
        end = 16 + 8 * levels + sum((size + 7) // 8 for size in sizes)
        head = read(0, end + 4)
        if zlib.crc32(head[:-4]) != struct.unpack("<I", head[-4:])[0]:
            raise ValueError("a damaged index file")
        at, bits = 16 + 8 * levels, []
        for size in sizes:
            bits.append(np.unpackbits(np.frombuffer(head, np.uint8, (size + 7) // 8, at))[:size])
            at += (size + 7) // 8
        self.hash, self.slots_at = PerfectHash(bits), end + 4

    def verify(self) -> None:
        """Reads all slots and the list, and compares their checksum."""
        size = self.n * (SLOT.itemsize + LISTED.itemsize)
        body = self.read(self.slots_at, size + 4)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a damaged index file")

    def listing(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, whether they are null) of documents in file order."""
        found = np.frombuffer(self.read(self.slots_at + self.n * SLOT.itemsize + begin * LISTED.itemsize, (end - begin) * LISTED.itemsize), LISTED)
        return found["id"], found["null"].astype(bool)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) of each key; start -1 for a key that the shard doesn't hold (wrong with probability 2^-32)."""
        at = self.hash.slot(keys)
        found = np.zeros(len(keys), SLOT)
        if len(keys) * 8 > self.n:  # many keys: one read of all slots
            slots = np.frombuffer(self.read(self.slots_at, self.n * SLOT.itemsize), SLOT)
            found[at >= 0] = slots[at[at >= 0]]
        else:
            for i in np.flatnonzero(at >= 0):
                found[i] = np.frombuffer(self.read(self.slots_at + int(at[i]) * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
        there = (at >= 0) & (found["print"] == fingerprint(keys))
        return np.where(there, found["start"].astype(np.int64), -1), np.where(there, found["count"].astype(np.int64), 0)


HEADER_BYTES = 16


def header(width: int) -> bytes:
    return MAGIC_IDS + struct.pack("<IQ", width, 1)


def read_ids(read: Callable[[int, int], bytes], start: int, count: int) -> np.ndarray:
    """Ids of a .ids file from place `start` on, by one range of it."""
    head = read(0, HEADER_BYTES)
    if head[:4] != MAGIC_IDS:
        raise ValueError("not an id file")
    width, _ = struct.unpack("<IQ", head[4:16])
    data = read(HEADER_BYTES + start * width, count * width)
    if len(data) != count * width:
        raise ValueError("an id file ends early")
    return np.frombuffer(data, {2: "<u2", 4: "<u4"}[width])
