"""Winnowed fingerprints of characters.

Of the hashes of the ``GRAM``-character stretches within any ``LONG`` neighbouring characters the least is kept. Texts that share ``LONG`` characters, wherever and in
whatever script, therefore share a fingerprint. For shorter stretches all hashes of 16, 8, 4, 2 or 1 characters are keys, and only of lengths that are asked for.
"""

from __future__ import annotations

import numpy as np

LONG, GRAM = 32, 16
#: Stretches by length: winnowed ones, and those of which every place is a key.
SIZES = (LONG, 16, 8, 4, 2, 1)
_MASK = (1 << 64) - 1
_FACTOR, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)


_KEPT: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base and 1; kept, as every text asks for them."""
    if base not in _KEPT or len(_KEPT[base]) <= n:
        _KEPT[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(2 * n, 1 << 15), base, np.uint64)]))
    return _KEPT[base][: n + 1]


def _grams(code: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` neighbouring characters."""
    if len(code) < n:
        return np.zeros(0, dtype=np.uint64)
    x = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(_SPREAD)
    x ^= x >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(_FACTOR, len(x) - 1), dtype=np.uint64)])
    h = (sums[n:] - sums[:-n]) * _powers(_INVERSE, len(x) - n)
    h ^= h >> np.uint64(31)
    return h * np.uint64(_SPREAD)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    done = 1
    while done < width and len(h):
        by = min(done, width - done)
        h, done = np.minimum(h[:-by], h[by:]), done + by
    return h


def keys(text: str, size: int) -> np.ndarray:
    """The distinct keys of a text for stretches of ``size`` characters, as signed numbers."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = _least(_grams(code, GRAM), LONG - GRAM + 1) if size == LONG else _grams(code, size)
    return np.unique(h).view(np.int64)


def key_of(stretch: str) -> tuple[int, int]:
    """The largest size that a stretch (not empty) fills, and the key of its beginning."""
    size = next(s for s in SIZES if s <= len(stretch))
    return size, int(keys(stretch[:size], size)[0])
