"""A wavelet matrix over the token ids of one shard, and its file format.

Level by level, from the highest bit down, the matrix keeps that bit of every token and then moves the tokens with a 0
before those with a 1, each group in its old order. With the number of ones before each position ("rank") a token is read
by following its position through the levels, occurrences of a token are counted between two positions in as many steps,
and the k-th occurrence is found by going back up ("select").

File: the magic b"WVMX0001", the length of the header (little-endian 64-bit), the header (JSON: levels, n_tokens, n_docs,
and for each section its name, offset from the header's end, stored and plain length), then the sections, each a zstd
frame: doc_ids (64-bit), doc_null (8-bit), doc_starts (64-bit, with the end), and for each level its bits (packed, lowest
first, in whole 64-bit words) and its ranks (32-bit, ones before every 512th bit).
"""

from __future__ import annotations

import json

import numpy as np
import zstandard

MAGIC = b"WVMX0001"
#: Bits between two stored ranks.
EVERY = 512


#: Tokens moved at a time, so that positions stay in a core's cache.
_SOME = 1 << 15


def _partition(v: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The items of v at a 0, then those at a 1. By positions: many times as fast as by masks where the bits are mixed."""
    out = np.empty_like(v)
    a, b = 0, len(v) - int(np.count_nonzero(ones))
    for at in range(0, len(v), _SOME):
        some, bits = v[at : at + _SOME], ones[at : at + _SOME]
        zero, one = np.flatnonzero(~bits), np.flatnonzero(bits)
        some.take(zero, out=out[a : a + len(zero)], mode="clip")
        some.take(one, out=out[b : b + len(one)], mode="clip")
        a, b = a + len(zero), b + len(one)
    return out


def _merge(v: np.ndarray, ones: np.ndarray, bit: int) -> np.ndarray:
    """Undoes ``_partition`` and sets ``bit`` in the items that go to a 1."""
    out = np.empty_like(v)
    a, b = 0, len(v) - int(np.count_nonzero(ones))
    for at in range(0, len(v), _SOME):
        some, bits = out[at : at + _SOME], ones[at : at + _SOME]
        zero, one = np.flatnonzero(~bits), np.flatnonzero(bits)
        some[zero] = v[a : a + len(zero)]
        some[one] = v[b : b + len(one)] | v.dtype.type(bit)
        a, b = a + len(zero), b + len(one)
    return out


class Bits:
    """A bit vector with rank and select."""

    def __init__(self, words: np.ndarray, n: int, ranks: np.ndarray | None = None):
        """``ranks``: ones before every ``EVERY``-th bit as stored with the words; the rest is counted from them."""
        self.words, self.n = words, n
        ones, self.before = np.bitwise_count(words), np.zeros(len(words) + 1, np.int64)
        if ranks is None:
            np.cumsum(ones, out=self.before[1:])
            return
        step = EVERY // 64
        blocks = np.zeros((-(-len(words) // step), step), np.int64)
        blocks.reshape(-1)[: len(words)] = ones
        upto = np.cumsum(blocks, axis=1)
        if len(ranks) != len(words) // step + 1 or ranks[0] or not np.array_equal(ranks[: len(blocks)][1:], (ranks[: len(blocks)] + upto[:, -1])[:-1]):
            raise ValueError("ranks do not match their bits")
        self.before[1:] = (upto + ranks[: len(blocks), None]).reshape(-1)[: len(words)]

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position, 0 <= at <= n."""
        word = np.minimum(at >> 6, len(self.words) - 1)
        inside = at - (word << 6)
        mask = np.where(inside >= 64, ~np.uint64(0), (np.uint64(1) << (inside & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) one, or zero."""
        before = self.before if ones else np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        word = np.searchsorted(before, k, "right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seen = np.cumsum(bits if ones else 1 - bits, axis=1)
        return (word << 6) + np.argmax(seen == (k - before[word] + 1)[:, None], axis=1)


class WaveletMatrix:
    def __init__(self, planes: list[Bits], n: int):
        self.planes, self.n, self.levels = planes, n, len(planes)
        self.zeros = [n - int(p.before[-1]) for p in planes]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        levels = max(1, int(ids.max()).bit_length()) if n else 1
        v, planes = ids.astype(np.uint16 if levels <= 16 else np.uint32), []
        for shift in range(levels - 1, -1, -1):
            ones = (v & v.dtype.type(1 << shift)) != 0
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(-(-n // 64) or 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            planes.append(Bits(words, n))
            if shift:
                v = _partition(v, ones)
        return cls(planes, n)

    def all(self) -> np.ndarray:
        """All tokens in order, by undoing the moves from the lowest level up."""
        v = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[k].words.view(np.uint8), count=self.n, bitorder="little").view(bool)
            v = _merge(v, ones, 1 << (self.levels - 1 - k))
        return v

    def access(self, at) -> np.ndarray:
        """The tokens at these positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.int64)
        for plane, z in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.get(at).astype(bool), plane.rank(at)
            out = (out << 1) | bit
            at = np.where(bit, z + ones, at - ones)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences between lo and hi end up after the last level."""
        if token < 0 or token >> self.levels:
            return 0, 0
        at = np.array([lo, hi], np.int64)
        for k, (plane, z) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.rank(at)
            at = z + ones if (token >> (self.levels - 1 - k)) & 1 else at - ones
        return int(at[0]), int(at[1])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token at positions lo to hi - 1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Positions of the token from lo to hi - 1, ascending."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        at = np.arange(a, b, dtype=np.int64)
        for k in range(self.levels - 1, -1, -1):
            one = bool((token >> (self.levels - 1 - k)) & 1)
            if len(at):
                at = self.planes[k].select(at - self.zeros[k] if one else at, one)
        return at


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], doc_starts: np.ndarray) -> bytes:
    matrix, sections = WaveletMatrix.of(ids), []
    sections.append(("doc_ids", np.array([d or 0 for d in doc_ids], "<i8")))
    sections.append(("doc_null", np.array([d is None for d in doc_ids], np.uint8)))
    sections.append(("doc_starts", np.asarray(doc_starts, "<i8")))
    for k, plane in enumerate(matrix.planes):
        sections += [(f"bits{k}", plane.words.astype("<u8", copy=False)), (f"ranks{k}", plane.before[:: EVERY // 64].astype("<u4"))]
    pack, stored, listed, at = zstandard.ZstdCompressor(level=1), [], [], 0
    for name, values in sections:
        frame = pack.compress(values.tobytes())
        listed.append([name, at, len(frame), values.nbytes])
        stored.append(frame)
        at += len(frame)
    header = json.dumps({"levels": matrix.levels, "n_tokens": len(ids), "n_docs": len(doc_ids), "sections": listed}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *stored])


class Shard:
    """A shard read from its file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        size = int.from_bytes(data[8:16], "little")
        header = json.loads(data[16 : 16 + size])
        view, unpack = memoryview(data)[16 + size :], zstandard.ZstdDecompressor()
        plain = {name: unpack.decompress(view[at : at + n], max_output_size=raw) for name, at, n, raw in header["sections"]}
        null = np.frombuffer(plain["doc_null"], np.uint8)
        self.doc_ids = [None if x else d for d, x in zip(np.frombuffer(plain["doc_ids"], "<i8").tolist(), null, strict=True)]
        self.doc_starts = np.frombuffer(plain["doc_starts"], "<i8")
        planes = [Bits(np.frombuffer(plain[f"bits{k}"], "<u8").astype(np.uint64, copy=False), header["n_tokens"], np.frombuffer(plain[f"ranks{k}"], "<u4").astype(np.int64)) for k in range(header["levels"])]
        self.tokens = WaveletMatrix(planes, header["n_tokens"])
