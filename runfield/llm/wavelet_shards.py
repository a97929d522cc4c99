"""Token-id output: one wavelet-matrix file for each shard of a corpus in ascending order of doc_id.

Documents are dealt by ranges of doc_id and sorted within each range. A task encodes its documents and closes a shard
file whenever ``shard_tokens`` tokens are in it, so memory stays bounded however many documents fall to a task (a longer
document is a shard of its own). Files are written to the shared folder under a name of their own for each attempt; a
small table lists the files of the attempts that succeeded, so a lost or repeated task leaves no trace in the result.

Scale: one range shuffle of (doc_id, text), by the text's hash within an id; ids never are shuffled. The start of each shard is a running sum over the
list of files, first within a task's files, then over tasks.

Defined cases: a null text has the end id only; null doc_ids come first; repeated doc_ids are ordered by their texts'
hashes; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runfield.llm.common import bounded_batches, id_and_text, map_batches, tidied
from runfield.sources.shared import new_path, written
from runfield.llm.encoding import encoder
from runfield.llm.wavelet import Shard, to_bytes

VOCABULARY = "byte_bpe_50k.json"
END = 2
SHARD_TOKENS = 2_000_000
#: Files that a reading task takes where there are very many.
FILES = 64


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder (a plain path, file, hdfs, s3 or gs) and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards below ``folder``; returns path, n_docs, n_tokens and start, the tokens of all shards before it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        part, files = TaskContext.get().partitionId(), 0
        held, doc_ids, ends, total = [], [], [0], 0

        def closed() -> pa.RecordBatch:
            nonlocal files, held, doc_ids, ends, total
            fs.create_dir(root, recursive=True)
            name = f"part-{part:06d}-{files:06d}-{uuid.uuid4().hex}.wvm"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(np.concatenate(held), doc_ids, np.array(ends)))
            row = [[part], [files], [f"{folder}/{name}"], [len(doc_ids)], [total]]
            files, held, doc_ids, ends, total = files + 1, [], [], [0], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "path", "n_docs", "n_tokens"])

        encoded = encoder(vocabulary).encoded
        for batch in tidied(batches, keeps=True):
            for i, j, ids, upto in encoded(batch.column(1), end_id):
                for doc_id, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    if total and total + b - a > shard_tokens:
                        yield closed()
                    held.append(ids[a:b])
                    doc_ids.append(doc_id)
                    total += b - a
                    ends.append(total)
        if doc_ids:
            yield closed()

    # ranges of (doc_id, hash), so that rows of one id, or of none, are not all in one task
    order = ("doc_id", F.xxhash64("text"))
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    files = written(bounded_batches(ordered).mapInArrow(work, "part long, file long, path string, n_docs long, n_tokens long"), "shard-files")
    tasks = files.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    tasks = tasks.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(tasks, "part").select("path", "n_docs", "n_tokens", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"))


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the listed files, read back from them."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, name = _store(path)
            with fs.open_input_stream(name) as source:
                shard = Shard(source.read())
            ids, at = shard.tokens.all(), shard.doc_starts
            crcs = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array(at[:-1] + base, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    listed = written(files, "shard-list")
    # a task for each file while they are few, else one for FILES of them
    many, few = listed.count(), 4 * listed.sparkSession.sparkContext.defaultParallelism
    spread = listed.select("path", "start").repartition(max(1, min(many, few), -(-many // FILES)))
    return map_batches(spread, work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes the shards of ``docs`` to the shared folder and gives what reading them back gives."""
    return read_shards(write_shards(docs, new_path(docs.sparkSession, "wavelet-shards"), **options))
