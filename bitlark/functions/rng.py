"""SplitMix64 and Box-Muller, fixed so that a fit can be repeated anywhere."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
# Fixed values of the generator.
STEP, MUL1, MUL2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class SplitMix64:
    def __init__(self, seed: int) -> None:
        self.state = seed & _MASK

    def u64(self) -> int:
        self.state = (self.state + STEP) & _MASK
        return self._out(self.state)

    @staticmethod
    def _out(z: int) -> int:
        z = ((z ^ (z >> 30)) * MUL1) & _MASK
        z = ((z ^ (z >> 27)) * MUL2) & _MASK
        return z ^ (z >> 31)

    def many(self, n: int) -> np.ndarray:
        """The next n values."""
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP) + np.uint64(self.state)
        self.state = (self.state + n * STEP) & _MASK
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MUL1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MUL2)
        return z ^ (z >> np.uint64(31))

    def normals(self, n: int) -> np.ndarray:
        """n standard normals, float32 throughout; two uniforms each."""
        u = ((self.many(2 * n) >> np.uint64(40)).astype(np.float32)) / np.float32(1 << 24)
        u1 = np.maximum(u[0::2], np.finfo(np.float32).tiny)
        return np.sqrt(np.float32(-2) * np.log(u1)) * np.cos(np.float32(2 * np.pi) * u[1::2])
