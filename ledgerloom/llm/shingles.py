"""Word-shingle sets of many texts at once, as 64-bit fingerprints on arrays."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
KEPT_POWERS = 4 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; up to KEPT_POWERS stay for the next time."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    with np.errstate(over="ignore"):
        for b in (_BASE, _INVERSE):
            out = np.full(n, b, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def word_hashes(buffer: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of bytes, A-Z as a-z: a polynomial of the bytes' random numbers, shifted to place 0.

    between: by byte, whether it stands between words.
    """
    n = len(buffer)
    word = np.empty(n + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(between[buffer], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[buffer]] * up[:n], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's shingles; with fewer words than width, of all words as one."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, hashed = word_hashes(buffer)
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    all_shingles = np.zeros(max(0, len(hashed) - width + 1), np.uint64)
    for k in range(width):
        all_shingles += hashed[k : k + len(all_shingles)] * _PLACE[k]
    all_shingles = mix(all_shingles)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            s = all_shingles[a : b - width + 1].copy()
            s.sort()
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            few = (hashed[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
