"""Quality rules, line first: rules judge each line, failing lines are removed, and a text that loses too much is rejected.

Words are runs of anything but ASCII white space; lines are what line feeds part; only lines with a word are judged. A line
fails, by the first rule that applies, as

- ``symbols``: more than one character of ``#*$%&|<>`` for ten words,
- ``navigation``: two or more separators (``|`` or ``»`` or ``·``), or at most three words without closing punctuation,
- ``shouting``: more capital than small ASCII letters, and at least three capitals,
- ``boilerplate``: it holds one of a list of phrases of licences, cookie notices and page furniture,
- ``repeated``: it equals an earlier line of the text,
- ``punctuation``: it doesn't end in closing punctuation (quotes and brackets may follow).

A text is kept if it passes the base (50 words, and at most half of the words in repeated 3-word windows) and its failing
lines hold at most ``most_lost`` of its words.

Scale: one narrow map, no shuffle; a text is worked on whole, line by line.

Defined cases: a null text has no words and no lines, so it fails the base, as an empty one does; repeated rows are each
judged alike; an empty table gives no rows; other columns are not read by ``judged``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runfield.llm.common import id_and_text, map_batches

LEAST_WORDS = 50
#: Percent of words in repeated 3-word windows that a text may have.
MOST_REPEATED = 50
#: Percent of words that a text may lose with its failing lines.
MOST_LOST = 30

SYMBOLS = b"#*$%&|<>"
CLOSING = ".!?:;…。！？"
#: May follow closing punctuation.
AFTER = "\"')]»”’"
PHRASES = ("all rights reserved", "licensed under", "this work is licensed", "released under the", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "accept cookies", "enable javascript", "click here", "skip to content", "sign up", "log in", "lorem ipsum", "copyright ©", "copyright (c)")

_CLOSING = tuple(c.encode() for c in CLOSING)
_AFTER = [c.encode() for c in AFTER]
_SEPARATORS = (b"|", "»".encode(), "·".encode())
_PHRASES = [p.encode() for p in PHRASES]
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SPACES = b" \t\n\r\x0b\x0c"


def _without(data: bytes, chars: bytes) -> int:
    """How many of ``chars`` are in ``data``."""
    return len(data) - len(data.translate(None, chars))


def closes(line: bytes) -> bool:
    """Whether the line, without white space at its end, ends in closing punctuation, quotes and brackets aside."""
    line = line.rstrip(_SPACES)
    while True:
        for mark in _AFTER:
            if line.endswith(mark):
                line = line[: -len(mark)]
                break
        else:
            return line.endswith(_CLOSING)


def failing(line: bytes, n_words: int, seen: bool) -> str | None:
    """The rule by which a line fails."""
    if 10 * _without(line, SYMBOLS) > n_words:
        return "symbols"
    closed = closes(line)
    if sum(map(line.count, _SEPARATORS)) >= 2 or (n_words <= 3 and not closed):
        return "navigation"
    upper = _without(line, _UPPER)
    if upper >= 3 and upper > _without(line, _LOWER):
        return "shouting"
    low = line.lower()  # of bytes: A-Z only
    if any(p in low for p in _PHRASES):
        return "boilerplate"
    if seen:
        return "repeated"
    return None if closed else "punctuation"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more, the first of them included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    if len(numbers) < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # number the pairs first
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1].astype(np.int64)
        key = pairs[:-1] * len(numbers) + ids[2:] if pairs.max() < (1 << 62) // len(numbers) else np.unique(np.stack((pairs[:-1], ids[2:])), axis=1, return_inverse=True)[1]
    ordered = np.argsort(key, kind="stable")
    same = key[ordered[1:]] == key[ordered[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[ordered[1:][same]] = True
    twice[ordered[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def judge(text: str | None, most_lost: int = MOST_LOST) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, lost_words, cleaned text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - _without(raw, _SPACES)
    repeated, lines, dup, lost, failed, left, seen = repeat_words(words), 0, 0, 0, 0, [], set()
    for line in raw.split(b"\n"):
        k = len(line.split())
        if not k:
            continue
        lines += 1
        again = line in seen
        dup += again
        seen.add(line)
        if failing(line, k, again):
            failed += 1
            lost += k
        else:
            left.append(line)
    base = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    return n, chars, _without(raw, SYMBOLS), dup, repeated, base, not base and 100 * lost <= most_lost * n, lines, failed, lost, b"\n".join(left).decode()


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = MOST_LOST, cleaned: bool = False) -> DataFrame:
    """A row for each of ``docs``; with ``cleaned``, also the text without its failing lines."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_words"] + ["cleaned"] * cleaned
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()] * cleaned

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            columns = list(zip(*(judge(t.as_py(), most_lost) for t in part.column(1)), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=["doc_id", *names])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, lost_words long" + ", cleaned string" * cleaned
    return map_batches(id_and_text(docs, id_col, text_col), work, schema)
