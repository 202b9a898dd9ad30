"""Word and shingle hashes of many texts at once, on their UTF-8 bytes with numpy.

Words are ``[^\\x20\\x09-\\x0D]+``; A-Z are lower-cased. Both touch ASCII bytes only, so bytes serve as well as characters.
"""

from __future__ import annotations

import numpy as np

#: Seeds of fixed random tables. Changing one changes every hash.
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POW = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 64), _STEP, np.uint64)]), dtype=np.uint64)
    return _POW


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: bytes of all texts, one after another; offsets: where each begins and ends. Returns the hashes of all words and, for each text, where its words begin and end among them."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, lengths)
    letters = _BYTE[data[starts[0] :]]
    letters[~inside[starts[0] :]] = 0
    longest = int(at[inside[starts[0] :]].max()) + 1
    np.minimum(at, longest, out=at)
    letters *= _powers(longest + 1)[at]
    sums = np.add.reduceat(letters, starts - starts[0])
    return mix(sums), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text; a text with fewer words, but one, has one: its whole sequence."""
    counts = np.diff(bounds)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] += words[j:] * _PLACE[j]
    rolled = mix(rolled)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    first = np.repeat(bounds[:-1], made)
    places = first + (np.arange(out[-1]) - np.repeat(out[:-1], made))
    hashes = rolled[places]
    for i in np.flatnonzero((counts < k) & (counts > 0)):
        own = words[bounds[i] : bounds[i + 1]]
        hashes[out[i]] = mix(np.array([np.uint64(len(own)) + (own * _PLACE[: len(own)]).sum(dtype=np.uint64)], np.uint64))[0]
    return hashes, out


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(t for t in texts if t), np.uint8), offsets


def chunks(texts: list[bytes | None], limit: int = 4_000_000):
    """Ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if held and held + size > limit:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(texts):
        yield at, len(texts)
