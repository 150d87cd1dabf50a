"""SetSketch: exponentially spaced registers that merge by maximum and are locality-sensitive.

Register i of a set is floor(1 - log_b(min x_i)), cut to [0, TOP], where each element draws x_i with rate ``A`` for
every register. The draws of one element are a Poisson process of rate A * m dealt to registers at random, so the
first point in a register is exponential with rate A; points come in ascending order and an element stops once its
next point is beyond the largest minimum of its set. (Ertl, SetSketch: Filling the Gap between MinHash and
HyperLogLog, 2021, describes the sketch and its joint estimator.)
"""

from __future__ import annotations

import numpy as np

M = 64
BASE = 1.001
A = 20.0
TOP = (1 << 16) - 1

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    z = z.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def sketch(elements: np.ndarray, owner: np.ndarray, sets: int, m: int = M) -> np.ndarray:
    """Registers (sets, m) uint16 of ``sets`` sets; element e (64-bit hash) belongs to set owner[e]. Empty sets give zeros."""
    least = np.full(sets * m, np.inf)
    bits = int(m).bit_length() - 1
    if m != 1 << bits:
        raise ValueError("the number of registers is a power of two")
    h, own, x, j = elements.astype(np.uint64), owner.astype(np.int64), np.zeros(len(elements)), 0
    while len(h):
        z = mix(h + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
        register = (z >> np.uint64(64 - bits)).astype(np.int64)
        u = ((z << np.uint64(bits)) >> np.uint64(11)).astype(np.float64)
        x = x - np.log((u + 0.5) * 2.0**-53) / (A * m)
        np.minimum.at(least, own * m + register, x)
        j += 1
        if j <= 6 or j % 8 == 0:  # a point beyond the bound changes no register, so late rounds look for it now and then
            going = x < least.reshape(sets, m).max(axis=1)[own]
            h, own, x = h[going], own[going], x[going]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least) / np.log(BASE))
    return np.clip(k, 0, TOP).astype(np.uint16).reshape(sets, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """(sets, m // rows) 64-bit keys of bands of ``rows`` registers."""
    n = registers.shape[1] // rows
    cut = registers[:, : n * rows].reshape(len(registers), n, rows).astype(np.uint64)
    key = np.zeros(cut.shape[:2], np.uint64) + np.arange(1, n + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * _GOLDEN + cut[:, :, r])
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    """Chance that a register of one set exceeds the other's, for the share x of elements only it holds."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0.0, 1.0, 129)


def similarity(one: np.ndarray, n_one: float, others: np.ndarray, n_others: np.ndarray) -> np.ndarray:
    """Jaccard similarity of ``one`` with each of ``others`` of largest joint likelihood, their sizes being known."""
    above = (one[None, :] > others).sum(axis=1)[:, None]
    below = (one[None, :] < others).sum(axis=1)[:, None]
    same = others.shape[1] - above - below
    u = (n_one / (n_one + n_others))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    p, q = _p(u - v * j), _p(v - u * j)
    tiny = 1e-12
    like = above * np.log(p + tiny) + below * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, 0) + tiny)
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]
