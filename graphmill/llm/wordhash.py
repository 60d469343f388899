"""Vectorised word splitting and hashing over UTF-8 bytes.

Texts are joined by one separator byte, so a whole Arrow batch is split and
hashed by a few array operations.  All hashes are unsigned 64-bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
SEGMENT = 1 << 19

#: Lower-casing of A-Z alone, as a byte table.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte tables of separators, for the two word definitions.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
NON_WORD = np.zeros(256, bool)
NON_WORD[0:0x30] = NON_WORD[0x3A:0x61] = NON_WORD[0x7B:0x80] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = SEGMENT):
    """Slices (from, to) of about `limit` bytes each; a longer text is a slice of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and each text's first word (one more entry at the end)."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    buf = LOWER[raw]
    inside = ~separators[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        hashes = np.empty(len(starts), np.uint64)
        # Segments that end between words keep the arrays of powers short.
        at = 0
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
            high = ends[to - 1]
            part = buf[low:high].astype(np.uint64) + np.uint64(1)
            power, inverse = _powers(len(part) + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)], dtype=np.uint64)))
            s, e = starts[at:to] - low, ends[at:to] - low
            hashes[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _STEP)
            at = to
    return hashes, np.searchsorted(starts, begins)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; tables up to a segment's length are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, _INV):
        p = np.full(max(n, SEGMENT + 1), base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= SEGMENT + 1:
        _POWERS[:] = made
    return made[0], made[1]


def shingle_sets(texts: list[bytes], k: int, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text, concatenated, and where each text's begin (one entry more).

    A text of fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    words, first = word_hashes(texts, separators)
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        n_all = max(len(words) - k + 1, 0)
        acc = np.full(n_all, mix(np.array([k], np.uint64))[0])
        for j in range(k):
            acc = mix((acc ^ words[j : j + n_all]) + _STEP)
        sets: list[np.ndarray] = []
        for i, n in enumerate(counts):
            a = first[i]
            if n >= k:
                own = np.sort(acc[a : a + n - k + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif n:
                one = mix(np.array([n], np.uint64))
                for w in words[a : a + n]:
                    one = mix((one ^ w) + _STEP)
                sets.append(one)
            else:
                sets.append(np.zeros(0, np.uint64))
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), ends
