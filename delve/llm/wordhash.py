"""Words of UTF-8 text, found and hashed by numpy on the bytes."""

from __future__ import annotations

import numpy as np

#: A word byte: a digit, an ASCII letter, or any byte of a character outside ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out[:n] if n else out[:0]


_POWERS = powers(64)


def word_bounds(raw: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of raw; words also end at each position in breaks (starts of documents)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = IS_WORD[raw]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    if breaks is not None and len(breaks):
        at = breaks[(breaks > 0) & (breaks < len(raw))]
        starts[at] |= inside[1:-1][at]
        ends[at - 1] |= inside[1:-1][at - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, of its lower-cased ASCII letters if fold."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    table = _BYTE[LOWER] if fold else _BYTE
    longest = int(lengths.max())
    power = _POWERS if longest <= len(_POWERS) else powers(longest)
    values = table[raw[at + np.repeat(starts, lengths)]] * power[at]
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return (sums ^ (sums >> np.uint64(29))) * _BASE + lengths.astype(np.uint64)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words; it does not depend on where they stand."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    have, size, rest = words, 1, None
    taken = 0
    # binary method: pieces of sizes 1, 2, 4, … joined from the left
    while True:
        if n & size:
            if rest is None:
                rest, taken = have, size
            else:
                count = len(words) - taken - size + 1
                rest = rest[:count] * _power(size) + have[taken : taken + count]
                taken += size
        if size * 2 > n:
            break
        have = have[: len(have) - size] * _power(size) + have[size:]
        size *= 2
    return rest[: len(words) - n + 1]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), n, 1 << 64))
