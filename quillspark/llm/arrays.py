"""Whole texts as numpy arrays: words, rolling hashes, sliding minima.

Everything here works on one bounded chunk of documents (``chunks``), whose UTF-8 bytes lie one after the other.
Hashes are fixed rules, so that every executor and every rerun agrees. ``hashes`` and ``chained`` mix block by block and may
stand for what they are made of. ``prefix`` with ``spans`` and ``grams`` are polynomials modulo 2**64, in which texts can be made to
meet: they only choose anchors and fill filters, where a meeting costs time and no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
CHUNK_BYTES = 1 << 20

#: The multipliers of the public-domain splitmix64 finaliser.
MIX1, MIX2, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95  # any odd number


def mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


VALUE = mix(np.arange(1, 257, dtype=U) * STEP)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CONTINUATION = (np.arange(256) & 0xC0) == 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for at, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) of runs of rows of about limit bytes; a longer text is a run of its own."""
    buf, off = buffer(column)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and for each document the index of its first word (one more entry)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < len(buf))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def prefix(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the symbols in [start, end), from prefix()."""
    return mix((pre[end] - pre[start]) * powers(len(pre))[1][start] + (end - start).astype(U) * STEP)


BLOCKS = 32  # of eight bytes; what is longer is hashed by xxh3
KEEP = (U(1) << (np.arange(9, dtype=U) * U(8) & U(63))) - U(1)
KEEP[8] = ~U(0)


def eights(buf: np.ndarray, spare: int = 16) -> np.ndarray:
    """The eight bytes from each place of buf as one little-endian number; past the end there are ``spare`` bytes of 255."""
    padded = np.full(len(buf) + spare, 255, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64 bits of the bytes in each [s, e), mixed eight at a time."""
    size = e - s
    out = size.astype(U) * STEP
    if not len(s):
        return out
    view, live, at = eights(buf), np.flatnonzero(size <= 8 * BLOCKS), 0
    for x in np.flatnonzero(size > 8 * BLOCKS).tolist():
        out[x] = xxhash.xxh3_64_intdigest(buf[s[x] : e[x]])
    while len(live):
        left = size[live] - at
        block = view[s[live] + at] & KEEP[np.clip(left, 0, 8)]
        out[live] = mix((out[live] ^ block) + STEP)
        at += 8
        live = live[left > 8]
    return out


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return hashes(buf, s, e)


def chained(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive symbols, mixed one after the other (also across documents; callers mask those)."""
    at = len(symbols) - n + 1
    if at <= 0:
        return np.zeros(0, U)
    out = np.full(at, n, U)
    for k in range(n):
        out ^= symbols[k : k + at]
        out *= MIX1
        out ^= out >> U(29)
    return mix(out)


def distinct_rows(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Order of (row, key) for rows in 0, 1, ...: one sort of numbers that hold the row and the upper bits of the key."""
    bits = int(row.max()).bit_length() if len(row) else 0
    both = (row.astype(U) << U(64 - bits) if bits else np.zeros(len(key), U)) | (key >> U(bits))
    order = np.argsort(both)
    near = both[order]
    key = key[order]
    if (key[1:] < key[:-1])[near[1:] == near[:-1]].any():  # keys that only their last bits set apart
        order = order[np.lexsort((key, near))]
    return order


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive symbols (also across documents; callers mask those)."""
    if len(symbols) < n:
        return np.zeros(0, U)
    pre, at = prefix(symbols), len(symbols) - n + 1
    return mix((pre[n:] - pre[:at]) * powers(at)[1] + U(n * int(STEP) & (1 << 64) - 1))


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys, by block-wise running minima from both sides."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.zeros(0, keys.dtype)
    pad = np.full(-(-len(keys) // w) * w, np.iinfo(keys.dtype).max, keys.dtype)
    pad[: len(keys)] = keys
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values in [first[i], first[i + 1]); empty rows are 0. values: (n,) or (n, k)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:], dtype=total.dtype)
    return total[first[1:]] - total[first[:-1]]
