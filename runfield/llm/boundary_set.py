"""A set of ascending whole numbers in containers of 2^16 values each, of the kind that takes least room for what it holds."""

from __future__ import annotations

import numpy as np

BITS = 16
#: An array of more values would be larger than a bitmap.
ARRAY_MOST = 4096
_LOW = (1 << BITS) - 1


class ArrayContainer:
    """The values themselves, 2 bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit for each value there may be, 8192 bytes, and the bits set before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.upto, k, "right"))
        inside = np.flatnonzero(np.unpackbits(self.words[w : w + 1].view(np.uint8), bitorder="little"))
        return (w << 6) + int(inside[k - (int(self.upto[w - 1]) if w else 0)])


class RunContainer:
    """First value and length of each stretch of consecutive values, 4 bytes each, and the values up to each one's end."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.start = low[first].astype(np.uint16)
        self.upto = np.append(first[1:], len(low)).astype(np.int64)

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.upto, k, "right"))
        return int(self.start[r]) + k - (int(self.upto[r - 1]) if r else 0)


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for ascending values below 2^16."""
    plain = 2 * len(low) if len(low) <= ARRAY_MOST else (1 << BITS) // 8
    if 4 * int(np.count_nonzero(np.diff(low, prepend=-2) != 1)) + 2 < plain:
        return RunContainer(low)
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """Ascending distinct numbers >= 0; ``select(k)`` is the k-th of them, from 0."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.int64)
        high = values >> BITS
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[starts]
        self.upto = np.append(starts[1:], len(values)) if len(values) else np.zeros(0, np.int64)
        self.containers = [container(values[a:b] & _LOW) for a, b in zip(starts.tolist(), self.upto.tolist(), strict=True)]

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.upto, k, "right"))
        return (int(self.high[c]) << BITS) + self.containers[c].select(k - (int(self.upto[c - 1]) if c else 0))
