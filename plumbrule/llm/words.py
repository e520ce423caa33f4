"""Words of many texts at once, as numpy arrays over the Arrow buffers.

Both word definitions used here (separators are single ASCII bytes, everything
from 0x80 up belongs to words) can be read off UTF-8 bytes, so a batch of texts
is cut and hashed without decoding it. Word hashes are 64-bit; A-Z hash as a-z.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once; bounds the working memory of a task (a single longer text is cut alone).
CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Words of letters, digits and non-ASCII characters.
ALPHANUMERIC = _separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Words between white space.
SPACED = _separators((0x20, 0x20), (0x09, 0x0D))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _byte_values(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * _BASE)


_VALUES = _byte_values(True)
#: For words whose case counts.
UNCHANGED = _byte_values(False)


class _Powers:
    """Powers of the base and of its inverse, kept per process and never sent along with a function."""

    def __init__(self) -> None:
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.tables is None or len(self.tables[0]) < n:
            size = max(n, CHUNK_BYTES + (1 << 16))
            up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
            up[0] = down[0] = 1
            self.tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.tables


_POWERS = _Powers()


class Words(NamedTuple):
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are the words of text ``i``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def cut(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, values: np.ndarray = _VALUES) -> Words:
    """Cut the texts ``data[offsets[i]:offsets[i + 1]]`` (uint8) into words."""
    base, stop = int(offsets[0]), int(offsets[-1])
    data, offsets = data[base:stop], (offsets - base).astype(np.int64)
    n = len(data)
    inside = np.zeros(n + 2, dtype=np.int8)
    np.logical_not(separators[data], out=inside[1:n + 1].view(bool))
    step = np.diff(inside)
    # A text's border ends a word as well.
    borders = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    glued = np.unique(borders[(inside[borders] == 1) & (inside[borders + 1] == 1)])
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(glued):
        start, end = np.sort(np.concatenate([start, glued])), np.sort(np.concatenate([end, glued]))
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[1])
    return Words(start + base, end + base, h, np.searchsorted(start, offsets))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` consecutive word hashes (len(h) - width + 1 of them)."""
    n = len(h) - width + 1
    out = np.full(max(n, 0), np.uint64(width))
    for k in range(width):
        out = mix(out * _BASE + h[k:k + n]) if n > 0 else out
    return out


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all ``width`` consecutive word hashes, rolled along by prefix sums."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last) text numbers of runs of texts that hold about ``limit`` bytes; a longer text is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to
