"""Words of many texts at once, as 64-bit hashes, with NumPy on their UTF-8 bytes.

A word is a run of ASCII letters (A-Z lower-cased), digits and non-ASCII characters: the
expression ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, which in UTF-8 needs no decoding.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(256, dtype=np.uint64))
STEP = np.uint64(0x9FB21C651E98DF25)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), STEP, np.uint64)]), dtype=np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and offsets: words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    raw = [(t or "").encode() for t in texts]
    data = LOWER[np.frombuffer(b" ".join(raw), np.uint8)]
    inside = IS_WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    bounds = np.cumsum([0, *(len(b) + 1 for b in raw)])
    offsets = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, np.uint64), offsets
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(BYTE[data[at]] * _powers(int(lengths.max()))[place], np.cumsum(lengths) - lengths)
        return mix(sums + lengths.astype(np.uint64)), offsets


INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))


class PrefixHashes:
    """Hashes of any parts of a sequence of values, from the prefix sums of these; a part's hash doesn't depend on where it is."""

    up, down = _powers(1), np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        if len(values) >= len(PrefixHashes.up):
            n = 2 * len(values) + 2
            with np.errstate(over="ignore"):
                PrefixHashes.up, PrefixHashes.down = _powers(n), np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, INVERSE)]), dtype=np.uint64)
        with np.errstate(over="ignore"):
            self.sums = np.empty(len(values) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(values * PrefixHashes.up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * PrefixHashes.down[start] + (end - start).astype(np.uint64))
