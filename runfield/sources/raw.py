"""Raw volumes: one unsigned byte for each cell, row by row and slice by slice, as a Python data source of stripes.

    spark.dataSource.register(RawVolume)
    spark.read.format("rawvolume").options(path=..., width=640, height=480, depth=100).load()

A volume is one file of width x height x depth bytes, or a folder that this source has written. A folder holds stripes of
``stripe`` rows, counted over all slices, so a stripe may be smaller than a slice or reach over several. Stripes next to each
other, ``FILE`` bytes of cells or one stripe if that is more, are a group; a file holds those stripes of one group that have a
cell, and behind them their numbers and how many they are. Stripes without a cell are not stored and are read as 0.
``volume.json`` names the file of each group; it is written when all tasks are done, so what tasks that failed or ran twice
have left is never read. It grows with the number of files, not of stripes or rows, and tasks don't read it.

A task reads one group, or at most ``rows`` rows of one if that option is given, from their place in the file.

Paths are those that ``pyarrow.fs`` takes: plain ones, file:, hdfs:, s3:, gs:.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from runfield.sources.volumes import Dims

SCHEMA = "slice int, row int, col int, val int"
MANIFEST = "volume.json"
#: Rows of a stripe, and cells of a batch.
STRIPE, CELLS = 256, 1 << 16
#: Bytes of cells that a file stands for, and that a task reads or writes.
FILE = 32 << 20


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    found, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return found, inner.rstrip("/")


def _dims(options: dict[str, str]) -> Dims:
    missing = [k for k in ("path", "width", "height", "depth") if k not in options]
    if missing:
        raise ValueError(f"a raw volume needs the options {', '.join(missing)}")
    found = Dims(*(int(options[k]) for k in ("width", "height", "depth")))
    if min(found.width, found.height, found.depth) < 0:
        raise ValueError("a raw volume cannot have a negative extent")
    return found


def _group(stripe: int, width: int, file: int = FILE) -> int:
    """Stripes of a group."""
    return max(1, file // max(1, stripe * width))


@dataclass
class Part(InputPartition):
    """``rows`` rows from the ``first``-th of the volume. ``file`` is that of their group, "" the volume's one file, None if all are 0."""

    dims: Dims
    stripe: int
    first: int
    rows: int
    file: str | None


@dataclass
class _Written(WriterCommitMessage):
    #: (group, file)
    files: list[tuple[int, str]]


class RawVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvolume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(dict(self.options), overwrite)


class RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options.get("path", ""), int(options.get("rows", 0))
        self.options = options

    def _size(self) -> tuple[Dims, int, int, dict[str, str] | None]:
        """The volume's dims, rows of a stripe and of a group, and, if it is a folder, the file of each stored group."""
        files, inner = _filesystem(self.path)
        info = files.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.Directory:
            with files.open_input_stream(f"{inner}/{MANIFEST}") as f:
                made = json.loads(f.read())
            return Dims(made["width"], made["height"], made["depth"]), made["stripe"], made["stripe"] * made["group"], made["files"]
        dims = _dims(self.options)
        if info.size != dims.cells:
            raise ValueError(f"{self.path} has {info.size} bytes; {dims.width} x {dims.height} x {dims.depth} cells were asked for")
        return dims, STRIPE, STRIPE * _group(STRIPE, dims.width), None

    def partitions(self) -> list[Part]:
        dims, stripe, group, stored = self._size()
        if not dims.cells:
            return []
        rows, step = dims.height * dims.depth, min(self.rows or group, group)
        file = lambda g: "" if stored is None else stored.get(str(g))
        return [Part(dims, stripe, a, min(step, group - a % group, rows - a), file(a // group)) for g in range(0, rows, group) for a in range(g, min(g + group, rows), step)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        dims, first, end = partition.dims, partition.first, partition.first + partition.rows
        many, x = max(1, CELLS // dims.width), np.arange(dims.width, dtype=np.int32)
        source = None
        if partition.file is not None:
            files, inner = _filesystem(self.path)
            source = files.open_input_file(f"{inner}/{partition.file}" if partition.file else inner)
        try:
            stored = _stored(source) if partition.file else None
            for a in range(first, end, many):
                n = min(many, end - a)
                val = np.zeros(n * dims.width, np.uint8)
                if stored is not None:
                    for number in range(a // partition.stripe, (a + n - 1) // partition.stripe + 1):
                        if number in stored:
                            start = number * partition.stripe
                            lo, hi = max(a, start), min(a + n, start + partition.stripe)
                            val[(lo - a) * dims.width : (hi - a) * dims.width] = _bytes(source, (stored[number] * partition.stripe + lo - start) * dims.width, (hi - lo) * dims.width)
                elif source is not None:
                    val[:] = _bytes(source, a * dims.width, n * dims.width)
                row = np.repeat(np.arange(a, a + n), dims.width)
                columns = (row // dims.height, row % dims.height, np.tile(x, n), val)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names=["slice", "row", "col", "val"])
        finally:
            if source is not None:
                source.close()


def _bytes(source: pa.NativeFile, at: int, n: int) -> np.ndarray:
    source.seek(at)
    return np.frombuffer(source.read(n), np.uint8)


def _stored(source: pa.NativeFile) -> dict[int, int]:
    """The numbers of the stripes in a group's file, each with its place there."""
    end = source.size() - 8
    n = int(_bytes(source, end, 8).view("<i8")[0])
    return {number: k for k, number in enumerate(_bytes(source, end - 8 * n, 8 * n).view("<i8").tolist())}


class RawWriter(DataSourceArrowWriter):
    """Takes cells in order of their stripes within each task, as ``write_volume`` deals them."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.dims, self.stripe, self.overwrite = options.get("path", ""), _dims(options), int(options.get("stripe", STRIPE)), overwrite
        self.group = _group(self.stripe, self.dims.width, int(options.get("file", FILE)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, inner = _filesystem(self.path)
        files.create_dir(inner, recursive=True)
        w, rows, group = self.dims.width, self.dims.height * self.dims.depth, self.group
        made, out, held, number, numbers = [], None, None, -1, []

        def flush() -> None:
            if held is not None:
                out.write(held.tobytes())
                numbers.append(number)

        def closed() -> None:
            if out is not None:
                out.write(np.array([*numbers, len(numbers)], "<i8").tobytes())
                out.close()

        try:
            for batch in iterator:
                z, y, x, val = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("slice", "row", "col", "val"))
                bad = (z < 0) | (z >= self.dims.depth) | (y < 0) | (y >= self.dims.height) | (x < 0) | (x >= w)
                if bad.any():
                    raise ValueError(f"{int(bad.sum())} cells lie outside the volume")
                row = z * self.dims.height + y
                of = row // self.stripe
                for a, b in _stretches(of):
                    if of[a] != number:
                        if of[a] < number:
                            raise ValueError("cells do not come in order of their stripes")
                        flush()
                        if out is None or of[a] // group != number // group:
                            closed()
                            name = f"part-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.raw"
                            out, numbers = files.open_output_stream(f"{inner}/{name}"), []
                            made.append((int(of[a]) // group, name))
                        number = int(of[a])
                        held = np.zeros(min(self.stripe, rows - number * self.stripe) * w, np.uint8)
                    held[(row[a:b] - number * self.stripe) * w + x[a:b]] = (val[a:b] & 0xFF).astype(np.uint8)
            flush()
            closed()
        finally:
            if out is not None and not out.closed:
                out.close()
        return _Written(made)

    def commit(self, messages: list[_Written | None]) -> None:
        files, inner = _filesystem(self.path)
        every = [f for m in messages if m for f in m.files]
        stored = dict(every)
        if len(stored) < len(every):
            raise ValueError("a group of stripes came from several tasks")
        size = {"width": self.dims.width, "height": self.dims.height, "depth": self.dims.depth}
        manifest = size | {"stripe": self.stripe, "group": self.group, "files": stored}
        files.create_dir(inner, recursive=True)
        with files.open_output_stream(f"{inner}/{MANIFEST}") as out:
            out.write(json.dumps(manifest).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        files, inner = _filesystem(self.path)
        for m in messages:
            for _, name in m.files if m else []:
                files.delete_file(f"{inner}/{name}")


def _stretches(of: np.ndarray) -> Iterator[tuple[int, int]]:
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return zip(first.tolist(), np.append(first[1:], len(of)).tolist(), strict=True)


def write_volume(cells: DataFrame, path: str, dims: Dims, stripe: int = STRIPE, file: int = FILE) -> None:
    """Writes cells (slice, row, col, val) as a raw volume; a cell that is not there is 0, and of a val the lowest byte counts. ``file``: bytes of cells of a group."""
    cells.sparkSession.dataSource.register(RawVolume)
    of = F.floor((F.col("slice").cast("long") * dims.height + F.col("row")) / stripe)
    dealt = cells.select("slice", "row", "col", F.col("val").cast("int").alias("val")).repartition(F.floor(of / _group(stripe, dims.width, file))).sortWithinPartitions(of)
    dealt.write.format("rawvolume").options(path=path, width=dims.width, height=dims.height, depth=dims.depth, stripe=stripe, file=file).mode("append").save()


def read_volume(spark: SparkSession, path: str, rows: int = 0, dims: Dims | None = None) -> DataFrame:
    """slice, row, col, val of every cell; ``dims`` are needed for a single file. ``rows``: what a task reads at most, if less than a group."""
    spark.dataSource.register(RawVolume)
    size = {} if dims is None else {"width": dims.width, "height": dims.height, "depth": dims.depth}
    return spark.read.format("rawvolume").options(path=path, rows=rows, **size).load()
