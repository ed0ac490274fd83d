"""Content-defined anchors of windows of symbols: equal windows have equal anchors, wherever they stand.

Symbols are bytes or hashed words. A window is anchored at the gram of least hash within it (the first of equals).
Neighbouring windows mostly share their anchor; the windows of one anchor form a run. Documents lie end to end in one array
and are walked in pieces, so memory does not grow with a text; a run that a piece's end cuts goes on as another run.

Defined results: windows never cross documents; a document shorter than a window has none, nor has an empty array.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import xxhash

#: Windows of a piece; anchors do not depend on it.
PIECE = 1 << 17
#: Odd bases of two hashes of the same symbols.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PLACE = np.uint64(0xFFFFF)
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


@cache
def _tables(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(size, base), _powers(size, pow(base, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that all bits of a sum count."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def values_of(symbols: np.ndarray) -> np.ndarray:
    return BYTE_VALUES[symbols] if symbols.dtype == np.uint8 else mixed(symbols + np.uint64(1))


class Sums:
    """Hashes of any stretches of a piece, from running sums of its values times powers of an odd number."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self.up, down = _tables(1 << n.bit_length(), base)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * down[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` consecutive ones, by doubling."""
    done = 1
    while 2 * done <= width:
        keys, done = np.minimum(keys[:-done], keys[done:]), 2 * done
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :]) if width > done else keys


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the documents that lie in ``data`` from offset to offset, and the offsets of their words."""
    starts, ends = [], []
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        word = np.zeros(b - a + 2, bool)  # with the byte before and the byte behind
        low, high = max(0, a - 1), min(len(data), b + 1)
        word[low - a + 1 : high - a + 1] = ~SPACES[data[low:high]]
        before, own, after = word[:-2], word[1:-1], word[2:]
        cut = np.zeros(b - a + 1, bool)  # where a document begins or ends
        cut[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        starts.append((np.flatnonzero(own & (~before | cut[:-1])) + a).astype(np.int32))  # a column of texts has less than 2 GB
        ends.append((np.flatnonzero(own & (~after | cut[1:])) + a + 1).astype(np.int32))
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts)
    ends = np.concatenate(ends)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = int(np.searchsorted(ends, int(starts[at]) + PIECE, "right"))
        if to <= at:  # a word longer than a piece
            out[at], at = xxhash.xxh64_intdigest(data[starts[at] : ends[at]]), at + 1
            continue
        low = starts[at]
        out[at:to] = mixed(Sums(values_of(data[low : ends[to - 1]])).of(starts[at:to] - low, ends[at:to] - low))
        at = to
    return out, np.searchsorted(starts, offsets)


def runs(symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple]:
    """Piece by piece: its start, its values, and of every run of windows the anchor's place, first and last window's start."""
    n = len(symbols) - window + 1
    inner = offsets[1:-1]
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        values = values_of(symbols[lo : hi + window - 1])
        sums = Sums(values)
        places = np.arange(len(values) - gram + 1)
        keys = (mixed(sums.of(slice(0, len(places)), slice(gram, None))) & ~PLACE) | places.astype(np.uint64)
        at = (least_of(keys, window - gram + 1) & PLACE).astype(np.int64)
        within = np.ones(hi - lo, bool)  # windows that end in the document they start in
        for b in inner[np.searchsorted(inner, lo, "right") : np.searchsorted(inner, hi + window - 1)].tolist():
            within[max(0, b - window + 1 - lo) : max(0, b - lo)] = False
        start = np.flatnonzero(within)
        if len(start):
            own = at[start]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            yield lo, values, sums, own[new], start[new], start[np.append(new[1:] - 1, len(start) - 1)]
