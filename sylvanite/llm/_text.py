"""Byte-level text kernels shared by the corpus operators (numpy, no per-word Python)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
LONG = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 1 where a byte belongs to a word [^\x20\x09-\x0D]+
BLANK = np.ones(256, np.uint8)
BLANK[[0x20, *range(0x09, 0x0E)]] = 0
#: 1 where a byte of lower-cased text belongs to a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.ones(256, np.uint8)
ALNUM[:0x30] = 0
ALNUM[0x3A:0x61] = 0
ALNUM[0x7B:0x80] = 0

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * _A
    h ^= h >> np.uint64(33)
    h *= _B
    h ^= h >> np.uint64(33)
    return h


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without gaps, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column, limit: int = CHUNK):
    """(first row, end row, bytes, offsets) of runs of rows that hold about `limit` bytes; a longer text is a run of its own."""
    data, off = buffer(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def spans(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the first word of each text (with the end of the last)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = word[data]
    cut = np.zeros(len(data) + 1, np.uint8)
    cut[off] = 1
    first = w.copy()
    first[1:] &= (1 - w[:-1]) | cut[1:-1]
    last = w.copy()
    last[:-1] &= (1 - w[1:]) | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes a step."""
    size = ends - starts
    h = np.full(len(starts), np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    h += size.astype(np.uint64) * _B
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, step = np.flatnonzero((size > 0) & (size <= LONG)), 0
    with np.errstate(over="ignore"):
        while len(live):
            left = size[live] - step
            x = eight[starts[live] + step] & _MASK[np.minimum(left, 8)]
            g = (h[live] ^ x) * _A
            h[live] = (g ^ (g >> np.uint64(29))) * _C
            step += 8
            live = live[left > 8]
        for i in np.flatnonzero(size > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
        return mix(h)


def ngrams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text (texts of 1 to k-1 words: one hash of all of them), and where each text's begin."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            full = full * _C + h[j : j + len(full)]
        at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
        out = mix(full[np.minimum(at, max(0, len(full) - 1))]) if len(full) else np.zeros(len(at), np.uint64)
        for i in np.flatnonzero((n > 0) & (n < k)):
            x = np.uint64(int(n[i]))
            for y in h[first[i] : first[i + 1]]:
                x = x * _C + y
            out[begin[i]] = mix(np.array([x ^ _B]))[0]
    return out, begin


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
