"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
#: A-Z as a-z; the white space of words (space, tab to carriage return) as a space.
_FOLD = np.array([32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text)."""
    raw = _FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    solid = raw != 32
    at = np.flatnonzero(solid)
    begins = at[np.concatenate([[True], at[1:] != at[:-1] + 1])] if len(at) else at
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(begins, text_ends)]))
    if not len(at):
        return np.empty(0, np.uint64), counts
    first = np.searchsorted(at, begins)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    powers = np.cumprod(np.full(int(within.max()) + 1, _POWER, np.uint64))
    return _mix(np.add.reduceat(_BYTE[raw[at]] * powers[within], first)), counts


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of `words` words; a shorter text is one run."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        joined = joined * _STEP + hashes[j : j + len(joined)]
    joined = _mix(joined)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= words:
            s = np.sort(joined[end - n : end - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in hashes[end - n : end]:
                    short = short * _STEP + h
            out.append(_mix(np.array([short ^ np.uint64(0x5851F42D4C957F2D)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out
