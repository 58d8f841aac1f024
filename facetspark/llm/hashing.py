"""Word and window hashes over whole Arrow text columns, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes. All functions work on the
contiguous byte buffer of a batch, so no Python string is made per word, and
temporary memory is bounded by ``WINDOW`` bytes at a time whatever a text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 1 << 21  # bytes hashed at once

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE_VALUES[~_NOT_SPACE] = 0


def text_buffer(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the n + 1 word offsets of the rows."""
    n = len(buf)
    solid = _NOT_SPACE[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    first, last = offs[:-1][offs[:-1] < n], offs[1:][offs[1:] > 0] - 1
    start[first] = solid[first]
    end[last] = solid[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def _power_table(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _BASE)])
    return _powers


def word_hashes(buf: np.ndarray, offs: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit polynomial hash of every word and the word offsets of the rows.

    ``fold`` lower-cases A-Z first.
    """
    s, e, rows = word_spans(buf, offs)
    out = np.zeros(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + WINDOW, "right")))
        a, b = int(s[i]), int(e[j - 1])
        part = buf[a:b]
        value = _BYTE_VALUES[_LOWER[part] if fold else part]
        first = s[i:j] - a
        length = np.diff(np.append(first, b - a))
        place = np.arange(b - a) - np.repeat(first, length)
        value *= _power_table(int(length.max()))[place]
        out[i:j] = np.add.reduceat(value, first)
        i = j
    return mix(out ^ (e - s).astype(np.uint64)), rows


def window_hashes(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hash (mod 2**64) of each k consecutive entries: n - k + 1 values.

    Built by joining power-of-two runs: hash(xy) = hash(x) * base**len(y) + hash(y).
    """
    if len(words) < k:
        return np.zeros(0, np.uint64)
    mask = (1 << 64) - 1
    run, size, out, have = words, 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, have = run, size
            else:
                n = len(words) - have - size + 1
                out = out[:n] * np.uint64(pow(base, size, mask + 1)) + run[have:have + n]
                have += size
        if size * 2 > k:
            return mix(out)
        n = len(run) - size
        run = run[:n] * np.uint64(pow(base, size, mask + 1)) + run[size:size + n]
        size *= 2


def row_slices(offs: np.ndarray, limit: int = WINDOW) -> list[tuple[int, int]]:
    """Row ranges [a, b) holding about ``limit`` bytes each, one row at least."""
    out, a, n = [], 0, len(offs) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1))
        out.append((a, b))
        a = b
    return out
