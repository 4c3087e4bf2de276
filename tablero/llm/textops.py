"""Vectorised word work on Arrow text columns (numpy, inside tasks).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z is lower-cased; other bytes stay.
Words are named by 64-bit polynomial hashes. Texts are handled in slices of a few MB, so that memory
does not follow the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ASCII white space of the word definition.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INV)):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def byte_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null is the empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer text forms a range alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words; a row boundary ends a word."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def hashed_rows(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of a text column: first and end row, word hashes, and each word's row from the first."""
    data, offsets = byte_buffer(column)
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        offs = offsets[lo : hi + 1] - offsets[lo]
        starts, ends, rows = word_spans(part, offs)
        yield lo, hi, word_hashes(part, starts, ends), rows


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; the whole run if it has fewer; none without words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    out = np.full(len(hashes) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + hashes[k : len(hashes) - width + 1 + k]
    return mix(out)
