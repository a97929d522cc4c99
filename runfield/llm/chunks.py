"""Cutting texts where tokenizers cut them anyway, and remembering what each chunk gives.

A byte-level BPE vocabulary first splits a text by a pattern under which no token reaches across a place between a
character that is no white space and a white space, nor past a lone line feed. Words recur, so a batch of texts is cut and
its distinct chunks are found by Arrow, and what a chunk gives is remembered in Arrow and numpy arrays of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from runfield.llm import textops

#: Bytes of texts that are cut at a time; a longer text is a block of its own.
BLOCK = 4 << 20
#: Bytes of chunks and of what they give that a worker remembers.
REMEMBERED = 24 << 20
#: Longer pieces are not remembered.
LONGEST = 64
#: ASCII punctuation but for the apostrophe, which may begin an ending of its own.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: Letters below are Latin and older than any vocabulary; all of them are composed, and no mark among them joins another.
_LATIN = "\u0250"
#: A chunk of letters, a blank before them or not, and marks after them. Each of these letters is one when lowered, too.
_PLAIN = rf"^(?P<letters> ?[A-Za-zÀ-ÖØ-öø-įĲ-ſ]+)(?P<marks>[{re.escape(_MARKS)}]*)$"
#: A place before white space, after anything else.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=\s)")
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@dataclass(frozen=True)
class Cutter:
    """How texts are cut into chunks whose tokens, one chunk after another, are those of the text."""

    cut: Callable[[pa.Array], pa.ListArray]
    #: Texts that match are cut one by one, by ``alone``.
    hard: str = ""
    alone: Callable[[str], list[str]] | None = None


#: Two white spaces in a row: such a text is not cut at its spaces. Concatenated, chunks are the text.
BYTE_LEVEL = Cutter(lambda texts: pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 "), "\0"), rf"\x00|{_WHITE}{{2}}", _BEFORE_SPACE.split)
#: For vocabularies that drop white space after splitting at it.
WORDS = Cutter(lambda texts: pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))


def plain_pieces(chunk: str) -> tuple[str, ...]:
    """The pieces of a chunk that is letters, marks or letters and marks after them, with or without a blank first; else none.

    All patterns of the vocabularies here split such a chunk alike.
    """
    letters = chunk.rstrip(_MARKS)
    bare = letters[1:] if letters[:1] == " " else letters
    if not bare:
        return (chunk,) if chunk else ()
    if not bare.isalpha() or not (bare.isascii() or max(bare) < _LATIN):
        return ()
    at = len(letters)
    return (letters, chunk[at:]) if at < len(chunk) else (chunk,)


def split_plain(chunks: pa.Array, lower: bool = False) -> tuple[list[str | None], list[str | None]]:
    """Letters and marks of each chunk, as ``plain_pieces`` has them, by Arrow; None for chunks that it doesn't know to be plain.

    ``lower``: letters are lowered, after the chunk as it is was found to be plain, as other letters may become Latin ones.
    """
    found = pc.extract_regex(chunks, _PLAIN)
    letters, marks = (pc.if_else(found.is_valid(), found.field(name), None) for name in ("letters", "marks"))
    return tuple(x.to_numpy(zero_copy_only=False).tolist() for x in (pc.utf8_lower(letters) if lower else letters, marks))


def distinct_chunks(texts: pa.Array, cutter: Cutter, special: list[str]) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """For blocks of rows: first row, row after the last, distinct chunks, each chunk's number among them, first chunk of each row with the end.

    A text that holds one of the ``special`` strings is one chunk. A null has no text.
    """
    texts = pc.fill_null(texts, "")
    pattern = "|".join([*map(re.escape, special), *filter(None, [cutter.hard])])
    for i, j, _, _ in textops.blocks(texts, BLOCK):
        some = texts.slice(i, j - i)
        hard = pc.match_substring_regex(some, pattern) if pattern else None
        if hard is not None and pc.any(hard).as_py():
            one_by_one = [[t] if any(s in t for s in special) else cutter.alone(t) for t in some.filter(hard).to_pylist()]
            easy = cutter.cut(some.filter(pc.invert(hard)))
            back = np.argsort(np.argsort(hard.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            lists = pa.concat_arrays([easy, pa.array(one_by_one, easy.type)]).take(pa.array(back))
        else:
            lists = cutter.cut(some)
        found = lists.flatten().dictionary_encode()
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
        yield i, j, found.dictionary, found.indices.to_numpy(), first


class Remembered:
    """What ``make`` gives for new chunks, bytes of unsigned 32-bit integers each. Bounded by bytes: beyond, only the last block's stay."""

    def __init__(self, make: Callable[[pa.Array], list[bytes]], most: int = REMEMBERED):
        self.make, self.most = make, most
        self._forget()

    def _forget(self) -> None:
        self.keys, self.values, self.size = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """values, and for each of the distinct ``chunks`` where its own start there and how many there are."""
        at = pc.index_in(chunks, value_set=self.keys)
        new = chunks.filter(pc.is_null(at))
        made = self.make(new)
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        place = np.where(place < 0, len(self.keys) - 1 + np.cumsum(place < 0), place)
        self.size = np.concatenate((self.size, np.fromiter(map(len, made), np.int32, len(made)) // 4))
        self.values = np.concatenate((self.values, np.frombuffer(b"".join(made), "<u4")))
        self.keys = pa.concat_arrays([self.keys, new.cast(pa.string())])
        values, size = self.values, self.size[place]
        start = (np.cumsum(self.size, dtype=np.int64) - self.size)[place]
        if self.keys.nbytes + self.values.nbytes > self.most:
            self._forget()
            if chunks.nbytes + 4 * int(size.sum()) <= self.most:
                self.keys, self.size, self.values = chunks.cast(pa.string()), size, gathered(values, start, size)
        return values, start, size


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all, one after another."""
    at = np.repeat(start - (np.cumsum(size, dtype=np.int64) - size), size)
    at += np.arange(len(at))
    return values[at]


class Recent(dict):
    """What ``make`` gives for a piece, remembered in two generations if it is not long.

    Once ``half`` keys are in the younger one it becomes the older, and what that held is forgotten; a key found in the
    older one moves to the younger. Hits are plain dict look-ups.
    """

    def __init__(self, half: int, make: Callable):
        super().__init__()
        self.half, self.make, self.old = half, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
