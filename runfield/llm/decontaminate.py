"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all windows of the corpus.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Each item of the benchmark gives its
windows of ``n`` words, an item of fewer words one window of all of them. The hashes of all windows of a text are looked
up in the set; each hit is verified word by word against the item's window. What is inside a verified occurrence is hit;
``mode`` removes such spans or whole documents.

Scale: one narrow map over the corpus; no shuffle of it. The set is broadcast in parts of about ``part_windows`` windows and
``PART_BYTES`` at most: a larger benchmark takes more passes over the corpus, joined by doc_id and position, with the same
result. Windows and their bytes are summed up before anything is broadcast; the driver holds one part at a time, whose pass
is written before the next is made. The items of a window that very many hold are dealt to ``DEALS`` entries of it, which
may lie in different parts. Of a long text, words are hashed in sections, with some 60 bytes for each word held at once.

Defined cases: null, empty and wordless texts have no words and no hits; items whose text has no word or whose item_id is
null have no window; equal windows of several items count for each; repeated rows are each treated alike; an empty
benchmark gives no hits; further columns are kept by ``decontaminate`` and not read by ``benchmark_hits``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runfield.llm import textops
from runfield.llm.common import id_and_text, map_batches
from runfield.sources.shared import written

N = 10
#: Windows that one broadcast holds at most; about 300 bytes each in a Python worker.
PART_WINDOWS = 500_000
#: Bytes that one broadcast holds at most, as estimated from the words and items of its windows.
PART_BYTES = 160 << 20
#: Entries that the items of one window are dealt to by their hash.
DEALS = 64


class WindowSet:
    """Windows of a benchmark, by hash: sorted hashes for a first look-up, then the words and items of each."""

    def __init__(self, rows: list[tuple[int, list[str], list[str]]]):
        """rows: (words in the window, the words, the items)"""
        by_length: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = {}
        for n, words, items in rows:
            joined = " ".join(words).encode()
            low, starts, ends, _ = textops.lowered_words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
            key = int(textops.windows(textops.span_hashes(low, starts, ends), n)[0])
            by_length.setdefault(n, {}).setdefault(key, []).append((joined, items))
        self.by_length = {n: (np.sort(np.fromiter(found, np.uint64, len(found))), found) for n, found in by_length.items()}

    def occurrences(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, list[str]]]:
        """(row, first word within the block, words, items) of each verified occurrence."""
        for n, (keys, found) in self.by_length.items():
            seen = textops.windows(hashes, n)
            if not len(seen):
                continue
            place = np.minimum(np.searchsorted(keys, seen), len(keys) - 1)
            hits = np.flatnonzero(keys[place] == seen)
            rows = np.searchsorted(first, hits, "right") - 1
            for w, row in zip(hits.tolist(), rows.tolist(), strict=True):
                if w + n > first[row + 1]:
                    continue  # reaches over the end of its text
                words = b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(w, w + n))
                for joined, items in found[int(seen[w])]:
                    if joined == words:
                        yield row, w, n, items


def _words(text: str) -> F.Column:
    return F.filter(F.split(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """size, words, deal, items: each distinct window with the ids (as strings) of the items that hold it, dealt by their hash."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), _words(text_col).alias("all")).where("item is not null and size(all) > 0")
    many = F.transform(F.sequence(F.lit(1), F.size("all") - n + 1), lambda i: F.slice("all", i, n))
    each = items.select("item", F.explode(F.when(F.size("all") < n, F.array("all")).otherwise(many)).alias("words"))
    return each.groupBy("words", F.pmod(F.xxhash64("item"), F.lit(DEALS)).alias("deal")).agg(F.collect_set("item").alias("items")).select(F.size("words").alias("size"), "words", "deal", "items")


def window_sets(benchmark: DataFrame, n: int = N, part_windows: int = PART_WINDOWS, part_bytes: int = PART_BYTES, id_col: str = "item_id", text_col: str = "text") -> tuple[int, Iterator[WindowSet]]:
    """How many sets, and the benchmark's windows in that many sets, made one after another as they are asked for."""
    found = written(benchmark_windows(benchmark, n, id_col, text_col), "benchmark-windows")
    bytes_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 60)
    rows, size = found.agg(F.count("*"), F.coalesce(F.sum(bytes_of("words") + bytes_of("items") + 200), F.lit(0))).first()
    parts = max(1, -(-rows // part_windows), -(-size // part_bytes))

    def made() -> Iterator[WindowSet]:
        for k in range(parts):
            part = found if parts == 1 else found.where(F.pmod(F.xxhash64("words", "deal"), F.lit(parts)) == k)
            yield WindowSet([(r["size"], r["words"], r["items"]) for r in part.toLocalIterator()])

    return parts, made()


def _scan(texts: pa.Array, found: WindowSet, use: Callable[[int, int, list[tuple[int, int, int, list[str]]], np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    for i, j, data, at in textops.blocks(texts):
        low, starts, ends, first = textops.lowered_words(data, at)
        use(i, j, list(found.occurrences(low, starts, ends, textops.span_hashes(low, starts, ends), first)), starts, ends, first, at)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _covered(ranges: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, part_windows: int = PART_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items: the sorted ids as strings.

    If the benchmark has more than ``part_windows`` windows, the rows of one doc_id are taken as one document's parts
    only where their texts are equal too.
    """
    parts, sets = window_sets(benchmark, n, part_windows)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    if parts > 1:
        return _hits_by_parts(docs, sets, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(next(sets))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit, n_items, digests, names = [], [], [], [], []
        clean = _digest(set())

        def use(i, j, occurrences, starts, ends, first, at):
            ranges: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for row, w, size, of in occurrences:
                ranges.setdefault(row, []).append((w, w + size))
                items.setdefault(row, set()).update(of)
            n_words.extend(np.diff(first).tolist())
            for row in range(j - i):
                got = items.get(row)
                n_hit.append(_covered(ranges[row]) if got else 0)
                n_items.append(len(got) if got else 0)
                digests.append(_digest(got) if got else clean)
                names.append(sorted(got) if got else [])

        _scan(batch.column(1), shared.value, use)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_hit, n_items)), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(names, pa.list_(pa.string()))],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )

    return map_batches(id_and_text(docs, id_col, text_col), work, schema)


def _hits_by_parts(docs: DataFrame, sets: Iterator[WindowSet], id_col: str, text_col: str) -> DataFrame:
    """One pass for each set, written before the next is made; the word ranges and items of a document meet in one small row."""
    passes = []
    for k, part in enumerate(sets):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            n_words, ranges, names = [], [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]

            def use(i, j, occurrences, starts, ends, first, at):
                n_words.extend(np.diff(first).tolist())
                for row, w, size, of in occurrences:
                    a = w - int(first[row])
                    ranges[i + row].append({"a": a, "b": a + size})
                    names[i + row].update(of)

            _scan(batch.column(1), shared.value, use)
            kinds = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(ranges, kinds), pa.array([sorted(x) for x in names], pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "ranges", "items"])

        rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
        # after the first pass, only what was hit goes on
        found = map_batches(rows, work, "doc_id long, text_hash long, n_words long, ranges array<struct<a:long,b:long>>, items array<string>").where(F.lit(k == 0) | (F.size("ranges") > 0))
        # rows of one id and text have equal parts: they become one with their number, before and after the shuffle
        once = found.groupBy("doc_id", "text_hash").agg(*(F.any_value(c).alias(c) for c in ("n_words", "ranges", "items")), F.count("*").alias("copies"))
        passes.append(written(once.withColumn("copies", F.col("copies") * int(k == 0)), "hits"))
        shared.destroy()
    every = passes[0]
    for one in passes[1:]:
        every = every.unionAll(one)
    # One row from each pass at most; repeated rows were counted in the first and are given back as often.
    joined = every.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("copies").alias("copies"))
    ordered = F.array_sort("ranges")
    hit = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")))["n"]
    out = joined.withColumn("n_hit", hit).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = N, part_windows: int = PART_WINDOWS, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without what the benchmark holds.

    mode "document": rows with a hit are left out. mode "span": the bytes from the first to the last word of each hit
    range are cut out of the text (a null text stays null). Several sets are applied one after another; for spans, each
    scans the text as it was, ranges travel with the row, and the last pass cuts them all.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    out, column = docs, docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(_free_name(docs), T.ArrayType(T.LongType()))]) if mode == "span" else docs.schema
    if mode == "span":
        out = docs.withColumn(schema.names[-1], F.array().cast("array<long>"))
    parts, sets = window_sets(benchmark, n, part_windows)
    for part in sets:
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            hits: dict[int, list[tuple[int, int]]] = {}

            def use(i, j, occurrences, starts, ends, first, at):
                for row, w, size, _ in occurrences:
                    hits.setdefault(i + row, []).append((int(starts[w] - at[row]), int(ends[w + size - 1] - at[row])))

            _scan(batch.column(column), shared.value, use)
            if mode == "document":
                return batch.filter(pa.array([i not in hits for i in range(batch.num_rows)], pa.bool_()))
            if not hits:
                return batch
            # begin, end, begin, end ...: the ranges of this pass and of those before it
            ranges = batch.column(batch.num_columns - 1).to_pylist()
            for row, more in hits.items():
                ranges[row] = [x for r in _merged([*zip(ranges[row][::2], ranges[row][1::2], strict=True), *more]) for x in r]
            kept = batch.columns[:-1]
            return pa.RecordBatch.from_arrays([*kept, pa.array(ranges, batch.schema.types[-1])], schema=batch.schema)

        out = map_batches(out, work, schema)
        if parts > 1:
            out = written(out, "decontaminated")
            shared.destroy()
    if mode == "document":
        return out

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ranges = batch.column(column), batch.column(batch.num_columns - 1).to_pylist()
        columns = batch.columns[:-1]
        if any(ranges):
            values = texts.to_pylist()
            for row, r in enumerate(ranges):
                if r:
                    raw, bounds = values[row].encode(), [0, *r, None]
                    values[row] = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)).decode()
            columns[column] = pa.array(values, texts.type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return map_batches(out, cut, docs.schema)


def _free_name(docs: DataFrame) -> str:
    name = "_ranges"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out
