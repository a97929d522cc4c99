"""What the operators share on the Spark side: input columns, batches for Python, and the memory of Python workers."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT = "67108864b"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns that most operators read; others never reach Python."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session is told to send Python at most BATCH_BYTES at a time, unless it has a setting of its own.

    With Spark's default, thousands of long texts are one batch in the memory of both sides. A plan takes the setting from
    its session when it runs, so there is no narrower place for it.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == _DEFAULT:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """An object of this Python worker that is costly to make, such as a tokenizer. Only the last one asked for is kept."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def tidied(batches: Iterator[pa.RecordBatch], keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """``batches``; before each, what the one before it left free goes back to the system.

    Spark uses a worker for one stage after another, and executors count what workers hold. Unless the stage ``keeps`` it,
    a kept object goes too.
    """
    if not keeps:
        _kept.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: T.StructType | str, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with a function of one batch; it may return one batch, several or none. ``keeps``: it uses ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches, keeps):
            made = work(batch)
            if isinstance(made, pa.RecordBatch):
                yield made
            elif made is not None:
                yield from made
            del made, batch

    return bounded_batches(df).mapInArrow(run, schema)


def passed_through(docs: DataFrame, keep: Callable[[pa.Array, pa.Array], list[bool]], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, for which ``keep(ids, texts)`` says so."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask = keep(batch.column(batch.schema.get_field_index(id_col)), batch.column(batch.schema.get_field_index(text_col)))
        return batch.filter(pa.array(mask, pa.bool_()))

    return map_batches(docs, work, docs.schema)


def tokenizer_path(name: str) -> str:
    """``name`` itself if it is a file, else the file of that name among the public vocabularies."""
    if os.path.isfile(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
