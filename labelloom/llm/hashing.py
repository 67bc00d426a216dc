"""Polynomial hashes of many byte spans at once, with numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


class Rolling:
    """Hashes of spans of a buffer; equal bytes hash alike at every place and in every buffer."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                setattr(self, name, _powers_of(base, n))

    def read(self, data: np.ndarray) -> None:
        """Take a buffer of uint8."""
        self._powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.down[starts])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of ``size`` bytes, in order of their starts."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])


def row_sums(rows: np.ndarray) -> np.ndarray:
    """Running sums of each row of a byte matrix, one column more than the rows have."""
    n = rows.shape[1]
    sums = np.zeros((len(rows), n + 1), np.uint64)
    np.cumsum(_BYTES[rows] * _powers_of(_BASE, n), axis=1, out=sums[:, 1:])
    return sums


def row_hash(sums: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Hash of the columns ``start`` to ``stop - 1`` of each row."""
    return mix((sums[:, stop] - sums[:, start]) * _powers_of(pow(_BASE, -1, 1 << 64), start + 1)[start])


def _powers_of(base: int, n: int) -> np.ndarray:
    steps = np.full(n, _U(base & _MASK))
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of bytes that are not ASCII white space."""
    visible = np.zeros(len(data) + 2, np.int8)
    visible[1:-1] = ~_SPACE[data]
    edges = np.diff(visible)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
