"""NumPy kernels over whole Arrow text columns: words, hashes, shingles, sliding minima.

All functions take the UTF-8 bytes of many texts at once; nothing loops over
words or rows in Python. Hashes are 64-bit and depend on the bytes alone, so
every task and every retry computes the same ones.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that one step works on.
BLOCK = 1 << 21


def byte_table(pattern_bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(pattern_bytes)] = True
    return t


#: Words [^\x20\x09-\x0D]+
NOT_BLANK = byte_table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of lower-case ASCII letters, digits and all other alphabets, once A-Z are lower case.
WORDY = byte_table(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(BASE) + U64(seed)) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes to numbers in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", BASE_INV)):
            x = np.full(n, base, U64)
            x[0] = 1
            _POW[name] = np.cumprod(x, dtype=U64)
    return _POW["up"], _POW["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null rows are empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off.astype(np.int64) - int(off[0])


def slices(offsets: np.ndarray, size: int = BLOCK):
    """Ranges of rows with about ``size`` bytes together; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words(NamedTuple):
    start: np.ndarray   # first byte
    end: np.ndarray     # behind the last byte
    row: np.ndarray     # row of the slice
    hash: np.ndarray    # of the (folded) bytes


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """All words: runs of bytes in ``table``, never across rows. ``fold`` maps bytes before hashing."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, U64))
    inside = table[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = ~inside[:-1]
    opens = cut[:n].copy()
    opens[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(inside & opens)
    cut[:n - 1] = ~inside[1:]
    closes = cut[:n]
    closes[n - 1] = True
    last = off[1:] - 1
    closes[last[last >= 0]] = True
    end = np.flatnonzero(inside & closes) + 1
    row = np.searchsorted(off, start, "right") - 1
    h = np.empty(len(start), U64)
    k = 0
    while k < len(start):  # words are whole in every block; a longer word is a block of its own
        m = max(k + 1, int(np.searchsorted(end, start[k] + BLOCK, "right")))
        a, b = int(start[k]), int(end[m - 1])
        up, down = _powers(b - a)
        part = data[a:b] if fold is None else fold[data[a:b]]
        weighed = np.where(inside[a:b], part.astype(U64) + U64(1), U64(0)) * up[:b - a]
        h[k:m] = np.add.reduceat(weighed, start[k:m] - a) * down[start[k:m] - a]
        k = m
    return Words(start, end, row, mix(h + (end - start).astype(U64)))


def per_row(row: np.ndarray, rows: int) -> np.ndarray:
    """Start of each row's words in the word list, and the total behind them."""
    return np.searchsorted(row, np.arange(rows + 1))


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``n`` consecutive words, also of those that span rows: mask with :func:`whole`."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j, c in enumerate(odd_constants(n, seed + 17 * n)):
        out += h[j:j + m] * c
    return mix(out)


def whole(row: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words from here on lie in one row."""
    m = len(row) - n + 1
    return row[:m] == row[n - 1:] if m > 0 else np.zeros(0, bool)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum over every ``n`` consecutive values."""
    m = len(x) - n + 1
    if m <= 0:
        return x[:0]
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:m], x[n - span:n - span + m])


def distinct_per_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted by row, then hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]
