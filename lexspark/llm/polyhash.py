"""Hashes of many substrings of a buffer at once, from prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray, by: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = (h ^ (h >> U(33))) * U(by)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


class _Powers:
    """Powers of an odd number and of its inverse, as far as a batch needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, x, U))]) for x in (BASE, pow(BASE, -1, 2**64)))
        return self.up, self.down


_POWERS = _Powers()


class Substrings:
    """``of(starts, ends)``: unmixed hashes of these substrings of ``buffer`` (bytes as uint8)."""

    def __init__(self, buffer: np.ndarray):
        up, self.down = _POWERS.upto(len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, U)
        np.cumsum((buffer.astype(U) + U(1)) * up[: len(buffer)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


class Sequences(Substrings):
    """The same for a sequence of numbers."""

    def __init__(self, numbers: np.ndarray):
        up, self.down = _POWERS.upto(len(numbers) + 1)
        self.sums = np.zeros(len(numbers) + 1, U)
        np.cumsum(mix(numbers.astype(U) + U(1)) * up[: len(numbers)], out=self.sums[1:])
