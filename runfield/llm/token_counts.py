"""Token counts by heap-and-linked-list byte-pair merging.

Each text is cut into pre-tokens. The bytes of a pre-token are nodes of a doubly linked list, and every adjacent pair that
the vocabulary can merge lies in a heap by rank. The lowest pair is popped, its nodes become one and the two new neighbour
pairs are pushed, until the heap is empty. The count is the number of bytes less the merges; no identifier is emitted.
That takes n log n steps for a pre-token of n bytes, however long.

Scale: one narrow map over (doc_id, text), no shuffle. Distinct chunks of a block of texts are merged once, and each Python
worker keeps the counts of recent chunks in a cache of bounded size, which changes no result.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a null or repeated doc_id gives its row as any other does;
of pairs of equal rank the leftmost merges first; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from runfield.llm.chunks import BYTE_LEVEL, Recent, Remembered, distinct_chunks, plain_pieces
from runfield.llm.common import id_and_text, kept, map_batches, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: The pattern by which byte-level vocabularies of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a worker remembers, twice over.
CACHED = 100_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the files of byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class PairMerger:
    """Counts the tokens of whole texts under one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        if not plain or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.byte_id = [ids[c] for c in byte_alphabet()]
        #: (left, right) -> (rank, merged symbol)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.known, self.pieces = Remembered(lambda chunks: [self.of_chunk(x).to_bytes(4, "little") for x in chunks.to_numpy(zero_copy_only=False).tolist()]), Recent(CACHED, lambda piece: self.merged(piece.encode()))

    def merged(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(piece)
        if n < 2:
            return n
        merges, symbol = self.merges, [self.byte_id[b] for b in piece]
        heap = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        push, pop, count = heapq.heappush, heapq.heappop, n
        while heap:
            _, i, new, left, right = pop(heap)
            j = following[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = new, -1
            k = following[i] = following[j]
            count -= 1
            if k < n:
                before[k] = i
                found = merges.get((new, symbol[k]))
                if found:
                    push(heap, (found[0], i, found[1], new, symbol[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], new))
                if found:
                    push(heap, (found[0], h, found[1], symbol[h], new))
        return count

    def of_chunk(self, chunk: str) -> int:
        """Tokens of a chunk. The vocabulary's special strings count as one token each, as the library has it by default."""
        if self.split_special and self.split_special.search(chunk):
            between = self.split_special.split(chunk)
            return len(between) - 1 + sum(map(self.of_chunk, between))
        return sum([self.pieces[x] for x in plain_pieces(chunk) or self.pattern.findall(chunk)])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for i, j, chunks, number, first in distinct_chunks(texts, BYTE_LEVEL, self.special):
            values, start, _ = self.known.of(chunks)
            upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(values[start][number], dtype=np.int64)))
            out[i:j] = upto[first[1:]] - upto[first[:-1]]
        return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row for each row of ``docs``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column(1), "")
        tokens = kept(f"merger {vocabulary}", lambda: PairMerger(tokenizer_path(vocabulary))).counts(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(id_and_text(docs, id_col, text_col), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", keeps=True)
