"""Words, word pairs and hashes shared by the text operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import xxhash

# Unicode blocks of Han characters.
HAN = "々〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
#: A word is one Han character or a run of other letters and digits.
WORD = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
MASK = (1 << 64) - 1


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class WordHash(dict):
    """64-bit hashes of words, kept for one task; emptied when it has grown to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` adjacent words; fewer words give none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out) + hashes[k : k + n]
    return mix(out)


def numbered(values: np.ndarray) -> np.ndarray:
    """Each value by itself the first time it occurs, and another one for its second, third, ... time: what two multisets share, these share as sets."""
    values = np.sort(values)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    again = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    return np.where(again > 0, mix(values + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), values)


def minhashes(flat: np.ndarray, starts: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """``size`` 32-bit min-hashes of each segment of ``flat``; ``starts`` are the segments' first places, none of them empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(1, 1 << 63, size, dtype=np.uint64)
    out = np.empty((len(starts), size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts) if len(starts) else 0
    return out


_LOW = np.uint64(0x0101010101010101)


def sign_bits(flat: np.ndarray, starts: np.ndarray, longs: int) -> np.ndarray:
    """``longs`` 64-bit integers for each segment of ``flat``: each bit is the majority of that bit over hashes of the segment's values.

    Two sets whose cosine is c differ in a share of acos(c) / pi of the bits, on the average.
    """
    ends = np.append(starts[1:], len(flat))
    # Eight counters of eight bits share a word, so that at most 255 values are summed at once.
    cuts = [np.arange(s, e, 255) for s, e in zip(starts, ends, strict=True)]
    first = np.cumsum([0, *(len(c) for c in cuts[:-1])])
    cut = np.concatenate(cuts)
    half = (ends - starts)[:, None]
    out, low = np.empty((len(starts), longs), np.int64), np.empty_like(flat)
    for k in range(longs):
        h = mix(flat + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & MASK))
        bits = np.empty((len(starts), 8, 8), bool)
        for b in range(8):
            np.bitwise_and(h, _LOW, out=low)
            np.right_shift(h, np.uint64(1), out=h)
            sums = np.add.reduceat(low, cut).view(np.uint8).reshape(-1, 8)
            bits[:, b] = 2 * np.add.reduceat(sums, first, axis=0, dtype=np.int64) > half
        out[:, k] = np.packbits(bits.reshape(len(starts), 64), axis=1).view(np.int64)[:, 0]
    return out
