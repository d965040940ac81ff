"""Whole-batch text kernels over Arrow buffers: words, word hashes and word shingles without Python strings.

A batch's texts are one byte array with offsets. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's
hash is a polynomial over its bytes modulo 2**64, so it depends on the word alone and not on its place; all words of
a segment come from one ``add.reduceat``.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the SplitMix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))[LOWER]
BYTE_VALUE[SEPARATOR] = 0
RAW_VALUE = mix(np.arange(1001, 1257, dtype=np.uint64))
SLOT = mix(np.arange(77, 77 + 64, dtype=np.uint64)) | np.uint64(1)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64, kept for the worker's life up to 4 segments."""
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, SEGMENT + 256), np.uint64(base))
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            made.append(p)
        if n > 4 * SEGMENT:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def segments(data: np.ndarray, size: int = SEGMENT):
    """Cuts at separators about every ``size`` bytes, so that no word is split."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        while end < n:
            found = np.flatnonzero(SEPARATOR[data[max(at, end - 4096) : end]])
            if len(found):
                end = max(at, end - 4096) + int(found[-1]) + 1
                break
            end = min(n, end + 4096)
        yield at, end
        at = end


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and hash of every word, in order."""
    all_starts, all_hashes = [], []
    for lo, hi in segments(data):
        d = data[lo:hi]
        token = ~SEPARATOR[d]
        fresh = np.empty(len(d), bool)
        fresh[0] = True
        fresh[1:] = ~token[:-1]
        first = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        fresh[first] = True
        starts = np.flatnonzero(token & fresh)
        if not len(starts):
            continue
        up, down = powers(len(d))
        h = np.add.reduceat(BYTE_VALUE[d] * up[: len(d)], starts)
        all_starts.append(starts + lo)
        all_hashes.append(mix(h * down[starts]))
    if not all_starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(all_starts), np.concatenate(all_hashes)


def word_bounds(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the first word of each document, n + 1 values."""
    return np.searchsorted(starts, offsets)


def shingles(bounds: np.ndarray, hashes: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The shingle hashes of each document in order, with repeats. Fewer words than ``width``: the whole sequence is
    one; no words: none."""
    n = len(hashes)
    if n >= width:
        rolled = hashes[: n - width + 1] * SLOT[0]
        for j in range(1, width):
            rolled = rolled + hashes[j : n - width + 1 + j] * SLOT[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(rolled[a : b - width + 1])
        elif b > a:
            out.append(mix((hashes[a:b] * SLOT[: b - a]).sum(keepdims=True, dtype=np.uint64) + SLOT[width + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, ascending."""
    offsets, data = strings(column)
    starts, hashes = words(offsets, data)
    out = []
    for s in shingles(word_bounds(offsets, starts), hashes, width):
        if len(s) > 1:
            s = np.sort(s)
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        out.append(s)
    return out


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def release() -> None:
    """Gives freed memory back to the system, so that a worker that is used again doesn't keep its peak."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def sliced(batch: pa.RecordBatch, column: str, size: int = 1 << 20):
    """Cuts a batch into runs of rows of about ``size`` bytes of text (one row at least)."""
    offsets, _ = strings(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(at, end - at)
        at = end
    release()
