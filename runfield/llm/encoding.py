"""Token ids of whole texts by the tokenizers library, each distinct piece merged once while it is remembered.

Texts are cut into chunks where the vocabulary's own rules cut every text; ids of a text are those of its chunks in turn.
A block of texts is cut by Arrow, and only its distinct chunks are looked up.
A new chunk is normalised and split into pieces by the vocabulary's pattern, and each new piece is merged by the library's
model. Chunks of Latin letters with ASCII punctuation after them, nearly all in most texts, are split without the pattern.
A text that holds one of the vocabulary's special strings goes to the library whole, as does any text of a vocabulary whose
rules are not among those known here.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from runfield.llm.chunks import BYTE_LEVEL, WORDS, Cutter, Recent, Remembered, distinct_chunks, gathered, plain_pieces, split_plain
from runfield.llm.common import kept, tokenizer_path
from runfield.llm.token_counts import PATTERN, byte_alphabet

#: Pieces that a worker remembers, twice over; about 200 bytes each.
CACHED = 100_000
#: Ids that are put together at a time.
SOME = 1 << 19
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _cutter(spec: dict):
    """How this vocabulary's texts may be cut into chunks, and the pattern that splits those; None if the library must have texts whole."""
    pre, normal, model = spec["pre_tokenizer"] or {}, spec["normalizer"], spec["model"]
    if model["type"] != "BPE" or model.get("dropout"):
        return None
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not normal:
        return BYTE_LEVEL, PATTERN
    if pre.get("type") == "Sequence" and normal and normal["type"] == "Sequence":
        split, level = pre["pretokenizers"][0], pre["pretokenizers"][-1]
        drops = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and "[^\\s" in split["pattern"].get("Regex", "")
        kinds = [(n["type"], n.get("pattern")) for n in normal["normalizers"]]
        by_char = kinds == [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
        if drops and by_char and len(pre["pretokenizers"]) == 2 and level["type"] == "ByteLevel" and not level["use_regex"] and not level["add_prefix_space"]:
            return WORDS, split["pattern"]["Regex"]
    return None


#: For vocabularies that must have texts whole.
WHOLE = Cutter(lambda texts: pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), texts))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.merge, self.normalizer = self.library.model.tokenize, self.library.normalizer
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.has_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)").search
        self.cut, pattern = _cutter(spec) or (None, "")
        self.split = regex.compile(pattern).findall
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.known, self.pieces = Remembered(self._chunks), Recent(CACHED, self._piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunks(self, chunks: pa.Array) -> list[bytes]:
        if self.cut is None:
            return [self._whole(x) for x in chunks.to_pylist()]
        letters, marks = split_plain(chunks, lower=bool(self.normalizer))
        pieces, texts = self.pieces, chunks.to_numpy(zero_copy_only=False).tolist()
        if self.special:
            special = pc.match_substring_regex(chunks, "|".join(map(re.escape, self.special)))
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
                letters[i] = None
        return [self._chunk(x) if a is None else pieces[a] + pieces[b] if b else pieces[a] for x, a, b in zip(texts, letters, marks, strict=True)]

    def _chunk(self, chunk: str) -> bytes:
        if self.has_special(chunk):
            return self._whole(chunk)
        plain = plain_pieces(chunk.lower() if self.normalizer else chunk)
        if not plain:
            plain = self.split(self.normalizer.normalize_str(chunk) if self.normalizer else chunk)
        return b"".join([self.pieces[x] for x in plain])

    def _piece(self, piece: str) -> bytes:
        # of printable ASCII, the alphabet changes the blank only
        shown = piece.replace(" ", self.alphabet[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.merge(shown)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def encoded(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For blocks of rows: first row, row after the last, the ids of all with ``end_id`` after each, first id of each row with the end."""
        for i, j, chunks, number, first in distinct_chunks(texts, self.cut or WHOLE, self.special):
            values, start, size = self.known.of(chunks)
            # the end id is one more chunk after those of each row
            values, start, size = np.append(values, np.uint32(end_id)), np.append(start, len(values)), np.append(size, np.int32(1))
            number = np.insert(number, first[1:], len(chunks))
            first = first + np.arange(len(first))
            upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size[number], dtype=np.int64)))[first]
            a = 0
            while a < j - i:
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + SOME, "right")) - 1)
                some = number[first[a] : first[b]]
                yield i + a, i + b, gathered(values, start[some], size[some]), upto[a : b + 1] - upto[a]
                a = b


def encoder(vocabulary: str) -> Encoder:
    """This worker's encoder; stages that use it must say that they keep it."""
    return kept(f"encoder {vocabulary}", lambda: Encoder(tokenizer_path(vocabulary)))
