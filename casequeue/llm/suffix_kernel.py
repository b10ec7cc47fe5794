"""Array kernels of the suffix sort: anchors, and hashes of byte ranges.

A text's suffixes are compared through ``depth`` bytes only. Each window of that length is owned by
its anchor: the leftmost smallest of the hashes of its ``digit``-byte strings. Equal windows have
equal anchors at equal offsets, and neighbouring windows mostly share one, so anchors are a small
part of all suffixes.
"""

from __future__ import annotations

import numpy as np

_SEED = np.random.default_rng(20240229)
_BYTES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several arrays of integers."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64, copy=False)) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.up):
            size = 1 << int(n + 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


class Hashed:
    """Hashes of any byte range of a buffer."""

    def __init__(self, raw: np.ndarray, powers: Powers):
        powers.reach(len(raw))
        self.powers = powers
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * powers.up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.powers.down[start]


def anchors(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: Hashed, depth: int, digit: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last owned window of the documents ``raw[starts:ends]``, in order."""
    empty = np.zeros(0, np.int64)
    n = len(raw)
    if n < depth:
        return empty, empty, empty
    at = np.arange(n - digit + 1, dtype=np.uint64)
    whole = hashed.sums[digit:] - hashed.sums[: n - digit + 1]
    key = mix(whole * hashed.powers.down[: n - digit + 1])
    key = (key >> np.uint64(32) << np.uint64(32)) | at
    span, width = depth - digit + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    valid = np.zeros(n - depth + 1, bool)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s >= depth:
            valid[s : e - depth + 1] = True
    windows = np.flatnonzero(valid)
    if not len(windows):
        return empty, empty, empty
    owner = (key[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    turn = np.flatnonzero(np.diff(owner)) + 1
    first = np.concatenate([[0], turn])
    last = np.concatenate([turn, [len(windows)]]) - 1
    return owner[first], windows[first], windows[last]
