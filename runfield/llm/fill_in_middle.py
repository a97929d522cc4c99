"""Fill-in-the-middle: documents cut at two line ends, and put together again as prefix, suffix and middle in another order.

A document's units are its lines, each with its LF. Where units end is a set of byte offsets, kept in containers (arrays,
bitmaps and runs, ``boundary_set``) with cumulative cardinalities: a search over containers and a selection inside one
give the offset after the i-th unit. Both cuts come from the SHA-256 of seed and doc_id alone, so a lost task
makes the same rows again.

Texts with one of the marks ``<P>``, ``<S>``, ``<M>`` stay as they are, so in an output each mark is found once, and
``restored`` rebuilds the text from output and form by string functions alone.

Scale: a narrow map, with no shuffle; texts reach Python in bounded batches, and a set takes at most 2 bytes for a line.

Defined cases: a null or empty text is plain, with n 0 and an empty output; of a text without LF the one unit is the whole
text, and either cut stands at its start or end; a null doc_id is hashed as ``<seed>:null``; repeated rows and ids are cut
each for itself, alike; an empty table gives no rows; other columns are not read; a very long text is cut as any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfield.llm import textops
from runfield.llm.boundary_set import BoundarySet
from runfield.llm.common import id_and_text, map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts, those that are cut; of 100 cut ones, those with the suffix first.
RATE, SPM_RATE = 100, 50


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    found = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(found[k : k + 4], "big") for k in range(0, 16, 4)]


def ends_of_lines(data: np.ndarray) -> np.ndarray:
    """Byte offsets after each unit of a text."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if not len(data) or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def _characters(data: np.ndarray) -> int:
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


def cut(data: np.ndarray, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of prefix and middle (None if plain), and the output of one text, given as UTF-8 bytes."""
    ends = BoundarySet(ends_of_lines(data))
    n, text = len(ends), data.tobytes()
    one, two, three, four = draws(doc_id, seed)
    if not text or three % 100 >= rate or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((one % (n + 1), two % (n + 1)))
    a, b = (ends.select(k - 1) if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if four % 100 < spm_rate else ("psm", (p, prefix, s, suffix, m, middle))
    return n, form, _characters(data[:a]), _characters(data[a:b]), b"".join(parts)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of ``docs``."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_pylist()
        for i, j, data, at in textops.blocks(batch.column(1)):
            n, form, prefix, middle, output = zip(*(cut(data[at[k] : at[k + 1]], ids[i + k], seed, rate, spm_rate) for k in range(j - i)), strict=True)
            columns = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(id_and_text(docs, id_col, text_col), work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from output and form."""
    out, upto = F.col(output), lambda c, a, b: F.substring(F.col(c), a, b - a)
    part = lambda mark, behind: (F.locate(mark, out) + len(mark), F.locate(behind, out) if behind else F.length(out) + 1)
    psm = (part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = (part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    built = lambda parts: F.concat(*(upto(output, a, b) for a, b in parts))
    return F.when(F.col(form) == "psm", built(psm)).when(F.col(form) == "spm", built(spm)).otherwise(out)


def digested(found: DataFrame) -> DataFrame:
    """``transformed`` with the SHA-256 of each output and of the text rebuilt from it instead of the output."""
    sha = lambda c: F.sha2(c, 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
