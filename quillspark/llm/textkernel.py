"""Words and word windows of whole Arrow batches of texts, as numpy arrays.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes are never part of another
character.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text handled at once: its arrays stay within a few megabytes.
CHUNK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, i < n at least.  A worker keeps those of one piece of a batch, not more."""
    if base in _powers and len(_powers[base][0]) >= n:
        return _powers[base]
    m = max(n, 1 << 16)
    up, down = np.full(m, base, U), np.full(m, pow(base, -1, 2**64), U)
    up[0] = down[0] = 1
    got = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if m <= CHUNK // 2:
        _powers[base] = got
    return got


class Words:
    """The words of some texts: start, end (bytes), first[d]:first[d+1] those of text d, hash (64 bits each)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = int(offsets[-1] - offsets[0])
        padded = np.full(n + 8, 0x20, np.uint8)
        padded[:n] = data[offsets[0] : offsets[-1]]
        if lower:
            padded = _LOWER[padded]
        at = offsets - offsets[0]
        word = ~_SPACE[padded[:n]]
        step = np.zeros(n + 1, np.int8)
        step[:n] += word
        step[1:] -= word
        inner = at[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < n)])
        inner = inner[word[inner - 1] & word[inner]]  # a text ends and the next begins without a space
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(inner):
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        self.data, self.start, self.end = padded, start, end
        self.first = np.searchsorted(start, at)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        n = len(self.data) - 7
        eight = np.ndarray((n,), "<u8", self.data, strides=(1,))
        size = self.end - self.start
        h = mix(eight[self.start] & _MASK[np.minimum(size, 8)] ^ (size.astype(U) * U(_P)))
        live, done = np.flatnonzero(size > 8), 8
        while len(live):
            left = size[live] - done
            h[live] = mix(h[live] * U(_Q) + (eight[self.start[live] + done] & _MASK[np.minimum(left, 8)]))
            live, done = live[left > 8], done + 8
        return h

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int, base: int = _P) -> np.ndarray:
        """Hash of the k words from each word on; of use only where they lie in one text (see inside)."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, U)
        up, down = powers(base, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hash * up[:n], out=total[1:])
        return mix((total[k:] - total[:-k]) * down[: n - k + 1] + U(k))

    def inside(self, k: int) -> np.ndarray:
        """Which of windows(k) lie in one text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        n = max(len(self.hash) - k + 1, 0)
        return np.arange(n) + k <= last[:n]

    def whole(self, base: int = _P) -> np.ndarray:
        """Hash of each text's word sequence."""
        n = len(self.hash)
        up, down = powers(base, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hash * up[:n], out=total[1:])
        a, b = self.first[:-1], self.first[1:]
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(U) * U(_Q))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary array's bytes and offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def pieces(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array with so many of values in each row."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (size[0] of them), first[1], ..."""
    total = int(size.sum())
    if not total:
        return np.empty(0, np.int64)
    at = np.cumsum(size) - size
    return np.arange(total) + np.repeat(first - at, size)
