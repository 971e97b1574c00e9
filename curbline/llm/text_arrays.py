"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space is [\x20\x09-\x0D] throughout.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def parts(column: pa.Array, most: int = 1 << 21, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of runs of texts, of ``most`` bytes unless one text is longer, and ``rows`` texts."""
    if not len(column):
        return
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, a + rows) if rows else b
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _ladder(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Finds and hashes words; keeps the tables of powers between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word."""
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        space = SPACE[data]
        cut = np.zeros(n + 1, bool)  # a text starts here, or the last one ends
        cut[offsets] = True
        before = np.concatenate([[True], space[:-1]]) | cut[:-1]
        after = np.concatenate([space[1:], [True]]) | cut[1:]
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit polynomial hash of each word's bytes."""
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = _ladder(n + 1, _BASE), _ladder(n + 1, _INVERSE)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])


def shingles(hashes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ``width`` words; of all words where a text has fewer."""
    if not len(hashes):
        return hashes, text
    n_texts = int(text[-1]) + 1
    counts = np.bincount(text, minlength=n_texts)
    first = np.cumsum(counts) - counts
    full = len(hashes) - width + 1
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    if full > 0:
        run = np.zeros(full, np.uint64)
        for k in range(width):
            run = run * multiplier + hashes[k : k + full]
        inside = text[:full] == text[width - 1 :]
        out, at = mix(run[inside]), text[:full][inside]
    else:
        out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            total[has] = total[has] * multiplier + hashes[first[short[has]] + k]
        # the word count keeps short sequences apart from full ones
        total = mix(total ^ mix(counts[short].astype(np.uint64)))
        out, at = np.concatenate([out, total]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at
