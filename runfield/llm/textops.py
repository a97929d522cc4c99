"""Words of many texts at once, with numpy on the bytes that Arrow holds.

A batch is worked on in blocks of whole texts of about a quarter of a megabyte, so that memory stays the same whatever the batch
holds. A longer text is a block of its own, hashed in sections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)

_byte = np.arange(256)
#: A-Z to a-z, all else as it is.
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Bytes of words: digits, letters and all of non-ASCII characters.
WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
#: ASCII white space.
SPACE = (_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constant(n: int) -> np.uint64:
    return np.uint64(n & _MASK)


_value = mix(np.arange(1, 257, dtype=np.uint64) * constant(_R))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_pow, _inv = _powers(_R, 1 << 16), _powers(_R_INVERSE, 1 << 16)


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        if size > 4 * BLOCK:
            return _powers(_R, n), _powers(_R_INVERSE, n)
        _pow, _inv = _powers(_R, size), _powers(_R_INVERSE, size)
    return _pow, _inv


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts, with the end of the last. A null has no bytes."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts within them and the end) of groups of whole texts."""
    data, at = buffers(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of equal, non-zero ``kind`` (one of each byte) that cross no place in ``at``."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(kind) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[at[at < len(kind)]] = True
    edges = np.flatnonzero(change)
    real = kind[edges[:-1]] != 0
    return edges[:-1][real], edges[1:][real]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end]; equal strings have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) <= 2 * BLOCK:
        return _section_hashes(data, starts, ends)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # sections of a long text, each of whole spans
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = _section_hashes(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def _section_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_value[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive items; the caller leaves out windows that reach over two texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        out = hashes[:size] * constant(_R)
        for k in range(1, n):
            out = (out + hashes[k : k + size]) * constant(_R + 2 * k * 0x51_7C_C1_B7)
        return mix(out)


def word_rows(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, the number of the first span in it, with the number of spans last."""
    return np.searchsorted(starts, at, "left")


def lowered_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts and ends of words; for each text the number of its first word, with the total last."""
    low = LOWER[data]
    starts, ends = spans(WORD[data].view(np.uint8), at)
    return low, starts, ends, word_rows(starts, at)
