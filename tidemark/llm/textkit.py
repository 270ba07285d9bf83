"""Array helpers shared by the text operators: hashing of words, shingles and subwords.

Everything here works on one bounded chunk of texts at a time and on whole texts; a text longer than
a chunk makes a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For bytes.translate: letters and digits of ASCII in lower case, bytes of other characters as they are, all else a space.
TERMS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Hands memory that is free again back to the system, as workers live on between stages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashed integers."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def chunks(texts: Sequence[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first text, encoded texts), each chunk about `limit` bytes."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def joined(parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts, each followed by one space, and the offsets of the parts."""
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    return data, np.concatenate(([0], ends))


def spans(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of `data`, which ends with a space."""
    gap = space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal bytes give equal hashes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=total[1:])
    value = (total[ends] - total[starts]) * _power("down", _INVERSE, n)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all parts in order, and the offsets of each part in them."""
    data, offsets = joined(parts)
    starts, ends = spans(data)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and the part each belongs to.

    A part of 1 to k-1 words has one shingle: all its words. A part without words has none.
    """
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    if n >= k:
        value = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            value = value * np.uint64(_BASE) + words[j : n - k + 1 + j]
        inside = owner[: n - k + 1] == owner[k - 1 :]
        value, whose = mix(value[inside]), owner[: n - k + 1][inside]
    else:
        value, whose = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            at = offsets[:-1][short[has]] + j
            extra[has] = extra[has] * np.uint64(_BASE) + words[at]
        value = np.concatenate((value, mix(extra + np.uint64(1))))
        whose = np.concatenate((whose, short))
    return value, whose


def weighted(value: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (part, shingle) with the number of times each occurs, sorted by part and shingle."""
    order = np.lexsort((value, whose))
    value, whose = value[order], whose[order]
    if not len(value):
        return value, whose, np.zeros(0)
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (whose[1:] != whose[:-1])))
    at = np.flatnonzero(new)
    return value[at], whose[at], np.diff(np.concatenate((at, [len(value)]))).astype(np.float64)
