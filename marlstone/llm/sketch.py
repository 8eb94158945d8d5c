"""Word shingles as sets of 64-bit hashes, and fast similarity sketches of them."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import takes_turn

#: Coordinates of a sketch: BANDS bands of ROWS. Two sets of similarity 0.85 share no band with chance below 1e-6.
ROWS, BANDS = 5, 25
SIZE = ROWS * BANDS
#: Words whose hashes a worker remembers.
MAX_WORDS = 800_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_WORDS: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * _FACTORS[0])


def word_hashes(words: list[bytes]) -> np.ndarray:
    takes_turn("sketch", _WORDS.clear)
    known = _WORDS
    if len(known) > MAX_WORDS:
        known.clear()
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        digest = xxhash.xxh64_intdigest
        for w in words:
            if w not in known:
                known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct shingles' hashes in order; with fewer words than ``n``, one for the whole sequence; without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    with np.errstate(over="ignore"):
        if len(h) < n:
            total = np.uint64(len(h)) * _M1
            for x in h:
                total = mix(np.asarray([total * _FACTORS[1] + x]))[0]
            return np.asarray([total], np.uint64)
        last = len(h) - n + 1
        out = np.zeros(last, np.uint64)
        for i in range(n):
            out += h[i : i + last] * _FACTORS[i % 5]
        return np.unique(mix(out))


def sketch(items: np.ndarray) -> np.ndarray:
    """Fast similarity sketching. Round by round, each item falls into one hashed bin with a hashed value, and a bin keeps
    its least; a later round's values are larger than all of an earlier one's, so that it only fills bins still empty.
    After SIZE rounds, round SIZE + i puts all items into bin i. Ends when every bin is filled."""
    out = np.full(SIZE, np.uint64(2**64 - 1))
    n, at = len(items), 0
    with np.errstate(over="ignore"):
        while at < 2 * SIZE:
            step = min(max(1, int(SIZE * 5 / n)), (SIZE if at < SIZE else 2 * SIZE) - at, 32) if n else 2 * SIZE
            if not n:
                break
            h = mix(items[None, :] ^ _SEEDS[at : at + step, None])
            rounds = np.arange(at, at + step, dtype=np.uint64)[:, None]
            value = (rounds << np.uint64(48)) | (h >> np.uint64(16))
            if at < SIZE:
                bins = ((h & np.uint64(0xFFFF)) * np.uint64(SIZE)) >> np.uint64(16)
                np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
            else:
                own = np.arange(at - SIZE, at - SIZE + step)
                out[own] = np.minimum(out[own], value.min(axis=1))
            at += step
            if out.max() != np.uint64(2**64 - 1):
                break
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band, different for equal rows in different bands."""
    rows = coordinates.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _FACTORS[2]
        for i in range(ROWS):
            key = mix(key * _FACTORS[3] + rows[:, i])
    return key.view(np.int64)
