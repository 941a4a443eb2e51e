"""Content-chosen suffixes of a text, for finding long repeats.

Every window of ``length`` bytes picks, among the ``gram``-byte strings inside it, the one whose hash is least
(leftmost among equals).  Equal windows pick the same place, so a repeat of a whole window always meets at the
suffix that begins there.  A run of windows that pick the same place is a segment: the suffix's key is the hash
of its leading gram, and the segment's bytes are those its windows cover.
"""

from __future__ import annotations

import numpy as np
import xxhash

LENGTH, GRAM = 200, 32
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _BASE)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _INVERSE)), dtype=np.uint64)


_powers = Powers()


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data)
    _powers.reach(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers.up[:n], out=sums[1:])
    return (sums[gram:] - sums[:-gram]) * _powers.down[: n - gram + 1]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima of blocks in both directions."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    rows = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, bytes hash, first window, last window) of each segment, in text order.

    The bytes hash covers the segment's bytes and the place of the suffix in it.  A segment never crosses a
    multiple of CHUNK windows counted from the text's start only if the text is longer than that; such a cut
    may split a repeated segment in two shorter ones, which are then compared window by window.
    """
    windows = len(text) - length + 1
    if windows <= 0:
        e = np.empty(0, np.int64)
        return e, e, e, e
    data = np.frombuffer(text, np.uint8)
    width = length - gram + 1
    keys, firsts, lasts, places = [], [], [], []
    for at in range(0, windows, CHUNK):
        n = min(CHUNK, windows - at)
        hashes = _gram_hashes(data[at : at + n + length - 1], gram)
        order = (hashes ^ hashes >> np.uint64(29)) * _MIX
        place = (_least(order & ~_PLACE | np.arange(len(order), dtype=np.uint64), width) & _PLACE).astype(np.int64)
        first = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
        keys.append(hashes[place[first]].view(np.int64))
        firsts.append(first + at)
        lasts.append(np.append(first[1:], n) - 1 + at)
        places.append(place[first] + at)
    first, last, place = map(np.concatenate, (firsts, lasts, places))
    digest = xxhash.xxh64_intdigest
    seg = np.array([digest(text[a : b + length], x - a) for a, b, x in zip(first.tolist(), last.tolist(), place.tolist())], np.uint64).view(np.int64)
    return np.concatenate(keys), seg, first, last
