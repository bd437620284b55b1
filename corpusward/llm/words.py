"""Vectorised word splitting and hashing of whole texts, for use inside Arrow tasks.

A word is a run of characters other than space and U+0009..U+000D.  All work is
on the UTF-8 bytes; none of those separators occurs inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK)
        ones = np.full(size, _BASE)
        ones[0] = 1
        _powers["up"] = np.cumprod(ones)
        ones = np.full(size, _BASE_INV)
        ones[0] = 1
        _powers["down"] = np.cumprod(ones)
    return _powers["up"], _powers["down"]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into the bytes) for slices of a string column.

    Nulls become empty texts.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each row's first word (with an end mark).

    ``separators`` marks the bytes between words; white space by default.
    """
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    solid = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes give equal hashes in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    table = _BYTE[_LOWER] if lower else _BYTE
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; of its whole sequence if it has fewer words."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = mix(out) * _BASE + words[k : len(words) - size + 1 + k]
    return mix(out + np.uint64(size))


#: White space, control characters and ASCII punctuation.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SHAPE = np.array([ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b >= 128 else ord("0") if 48 <= b < 58 else b for b in range(256)], np.uint8)


def heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words with over ``size`` code points, and where their first ``size`` end."""
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), np.full(size + 1, len(data)))
    cut = lead[np.minimum(np.searchsorted(lead[: len(lead) - size - 1], starts) + size, len(lead) - 1)]
    longer = np.flatnonzero(cut < ends)
    return longer, cut[longer]


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes: runs of capitals, other letters and digits as one mark each."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    kind = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return hashes(kind[keep], total[starts], total[ends])
