"""Hashes of byte ranges from running sums, for numpy batches.

With a random 64-bit number for each byte value and powers of an odd base modulo
2**64, the sum of ``number * base**place`` over a range, divided by
``base**start`` (odd numbers have inverses), depends on the bytes alone. One
pass over a batch then gives the hash of any range by two look-ups.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    def __init__(self, raw: np.ndarray):
        _grow(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _powers[: len(raw)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of raw[start:end], scrambled together with the length."""
        plain = (self.sums[ends] - self.sums[starts]) * _inverses[starts]
        return mix(plain + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
