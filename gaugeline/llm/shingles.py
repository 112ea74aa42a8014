"""Word-shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import utf8

WIDTH = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of each 64-bit value spread over the whole value."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


#: One random 64-bit factor a place in a word; words that are longer are hashed whole.
_FACTORS = np.random.default_rng(0x5EED).integers(0, 2**64, 4096, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes hashed at a time; a piece ends with a word.
PIECE = 1 << 16


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash a word: a multilinear form over its bytes, with random factors.

    Two given words agree by a chance of 2**-57 at most, whatever their bytes (a
    polynomial in one base hasn't that bound: it maps whole families to one value).
    """
    out, a, at = [], np.frombuffer(data, np.uint8), 0
    while at < len(a):
        stop = min(len(a), at + PIECE)
        if stop < len(a):
            while stop < len(a) and not _SPACE[a[stop]]:
                stop += 1
        piece = a[at:stop]
        inside = np.zeros(len(piece) + 2, bool)
        inside[1:-1] = ~_SPACE[piece]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            first = np.cumsum(sizes) - sizes
            place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
            terms = _FACTORS[np.minimum(place, len(_FACTORS) - 1)] * (piece[inside[1:-1]] + np.uint64(1))
            hashes = mixed(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * _A)
            for i in np.flatnonzero(sizes > len(_FACTORS)):
                hashes[i] = xxhash.xxh3_64_intdigest(piece[starts[i]:starts[i] + sizes[i]].tobytes())
            out.append(hashes)
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles of a text, ascending: A-Z lowered, words cut at ASCII white space.

    Fewer words than ``width`` make one shingle; no word makes none.
    """
    h = word_hashes(utf8(text).lower())
    n = len(h)
    if not n:
        return h
    width = min(n, width)
    out = h[: n - width + 1] + np.uint64(width)
    for i in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _A + h[i: n - width + 1 + i]
    return np.unique(mixed(out))


def _signed(value: int) -> int:
    return int(np.int64(np.uint64(value).view(np.int64)))


def set_key(shingles: np.ndarray) -> int:
    """64-bit signed key of a set: equal for equal sets."""
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes()))


def set_check(shingles: np.ndarray) -> int:
    """A second, independent 64-bit hash, which tells apart sets of one key."""
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes()))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two ascending sets link."""
    if not len(a) or not len(b) or percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def prefix_length(n: int) -> int:
    """Least elements, in any common order, that two linked sets of which one has n share one of."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0
