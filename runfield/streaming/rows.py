"""Components of a grid whose rows arrive one after the other, by Structured Streaming.

Cells are dealt to slabs of slices; a slab is the key of a ``transformWithStateInPandas``. Its state is the runs of the last
row, with the components that they belong to, the partial features of those open components, and the cells of the newest
row, which more may yet come of. When a later row arrives, all before it are complete: their runs are joined to those of the row
before them and to each other, all that a micro-batch completes at once, and components that do not reach the last of them
are closed and given out. State is thus as large as two rows of a slab, however many rows there have been.

A slab also sees the first slice of the slab after it. Where its runs touch one there, it gives out a seam, the run and the
component; the slab after it gives out the component that the run is of; ``features_of`` joins the two and folds parts.

What a stream gives out, by ``kind``:

    part   a: component; its features; first_slice, first_row, first_x0: place of its first run in raster order
    link   a, b: components of a slab that turned out to be one
    lower  a: component that touches the run (slice, row, x0) of the slab after its own
    upper  a: component of the run (slice, row, x0), in the first slice of its slab
    late   slice, row, x0: a cell that arrived after its row was complete; it is in no component

Coordinates are 0 or more; a cell that lacks one is no cell. Rows may come in any order within a micro-batch. A cell that comes twice counts once. A negative column is no cell: it only
says that all rows before its own are complete, as ``endings`` does at the end for every slab.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runfield.operators import components, features
from runfield.sources.shared import written

SLICES = 64
CELLS = "slab int, slice int, row int, col int"
_SUMS, _LOWS, _HIGHS = features.SUMS, features.LOWS, features.HIGHS
_PART = (*_SUMS, *_LOWS, *_HIGHS, *features.FIRST)
OUTPUT = "kind string, a long, b long, slice int, row int, x0 int, " + ", ".join(f"{c} {'long' if c in _SUMS else 'int'}" for c in _PART)
_INTEGERS = [(name, np.int64 if kind == "long" else np.int32) for name, kind in (c.split() for c in OUTPUT.split(", ")[1:])]
#: Components of a slab are numbered from slab << COMP_BITS.
COMP_BITS = 40
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A store sets disk aside for its logs unless told otherwise, several MB for each partition and run, however little it holds.
_SETTINGS = {_PROVIDER: _ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
_PARTITIONS = "spark.sql.shuffle.partitions"
#: State partitions for each core of the cluster; slabs are many more, and a task holds one of them at a time.
PER_CORE = 2
#: Columns of the arrays in the state: runs and cells, and open components.
_RUN, _OPEN = 5, 1 + len(_PART)


def dealt(voxels: DataFrame, slices: int = SLICES) -> DataFrame:
    """Cells by slab; those of a slab's first slice go to the slab before it, too."""
    own = F.expr(f"cast(slice div {slices} as int)")
    slabs = F.when((F.col("slice") % slices == 0) & (F.col("slice") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return voxels.where("slice is not null and row is not null and col is not null").select(F.explode(slabs).alias("slab"), "slice", "row", "col")


def endings(cells: DataFrame, row: int) -> DataFrame:
    """For each slab of ``cells`` (of ``dealt``), the sign that all rows before ``row`` are complete."""
    return cells.select("slab").distinct().select("slab", F.lit(0).alias("slice"), F.lit(row).alias("row"), F.lit(-1).alias("col"))


def _runs(cells: np.ndarray) -> np.ndarray:
    """line, x0, x1 of the runs of cells (line, col), in order; a cell that comes twice counts once."""
    order = np.lexsort((cells[:, 1], cells[:, 0]))
    line, x = cells[order, 0], cells[order, 1]
    new = (np.diff(line, prepend=-1) != 0) | (np.diff(x, prepend=-1) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(line))[: len(first)] - 1
    return np.stack((line[first], x[first], x[last] + 1), axis=1)


def _touching(a: np.ndarray, b: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of runs (line, x0, x1) of a and b, b in order, that touch, b being ``steps`` lines further."""
    place = lambda line, x: (line << 32) + x
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lines, of_b = np.unique(b[:, 0], return_inverse=True)
    starts, ends = place(of_b, b[:, 1]), place(of_b, b[:, 2])
    for step in steps if len(lines) else ():
        at = np.minimum(np.searchsorted(lines, a[:, 0] + step), len(lines) - 1)
        asks = np.flatnonzero(lines[at] == a[:, 0] + step)
        low = np.searchsorted(ends, place(at[asks], a[asks, 1]), "left")
        high = np.searchsorted(starts, place(at[asks], a[asks, 2]), "right")
        many = np.maximum(high - low, 0)
        left.append(np.repeat(asks, many))
        right.append(np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many))
    return np.concatenate(left), np.concatenate(right)


def _folded(parts: np.ndarray) -> np.ndarray:
    """Rows (comp, _PART) added up by comp."""
    if not len(parts):
        return parts
    parts = parts[np.lexsort((*(parts[:, k] for k in range(_OPEN - 1, _OPEN - 4, -1)), parts[:, 0]))]
    at = np.flatnonzero(np.diff(parts[:, 0], prepend=-1))
    out = parts[at].copy()  # the first of each comp has its least first run
    for columns, fold in ((_SUMS, np.add), (_LOWS, np.minimum), (_HIGHS, np.maximum)):
        k = [1 + _PART.index(c) for c in columns]
        out[:, k] = fold.reduceat(parts[:, k], at, axis=0)
    return out


def _of_runs(comp: np.ndarray, z: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    n = x1 - x0
    return np.stack((comp, n, (x0 + x1 - 1) * n // 2, y * n, z * n, x0, y, z, x1, y + 1, z + 1, z, y, x0), axis=1)


class _Slab:
    """A slab's state and what it gives out; plain numpy, apart from the stream."""

    def __init__(self, slab: int, slices: int, row: int = -1, count: int = 0, held: np.ndarray | None = None, opened: np.ndarray | None = None, waiting: np.ndarray | None = None):
        self.slab, self.slices, self.beyond = slab, slices, (slab + 1) * slices
        self.first_slice = slab * slices
        self.row, self.count = row, count
        #: runs of the last row: slice, x0, x1, comp, 0; those of the slice beyond have comp -1
        self.held = np.zeros((0, _RUN), np.int64) if held is None else held
        self.opened = np.zeros((0, _OPEN), np.int64) if opened is None else opened
        #: cells of rows that are not complete: slice, row, col, 0, 0
        self.waiting = np.zeros((0, _RUN), np.int64) if waiting is None else waiting
        self.out: list[pd.DataFrame] = []

    def given(self, kind: str, **columns) -> None:
        if len(next(iter(columns.values()))):
            self.out.append(pd.DataFrame(columns).assign(kind=kind))

    def closed(self, parts: np.ndarray) -> None:
        self.given("part", a=parts[:, 0], **{c: parts[:, 1 + k] for k, c in enumerate(_PART)})

    def take(self, cells: np.ndarray) -> None:
        """Cells (slice, row, col) of any rows; those before the greatest row among them are complete."""
        late = cells[(cells[:, 1] <= self.row) & (cells[:, 2] >= 0)]
        self.given("late", slice=late[:, 0], row=late[:, 1], x0=late[:, 2])
        cells = cells[cells[:, 1] > self.row]
        if not len(cells):
            return
        newest = int(max(cells[:, 1].max(), self.waiting[:, 1].max(initial=-1)))
        cells = cells[cells[:, 2] >= 0]
        waiting = np.concatenate((self.waiting, np.pad(cells, ((0, 0), (0, _RUN - 3)))))
        ready, self.waiting = waiting[waiting[:, 1] < newest], waiting[waiting[:, 1] == newest]
        if newest - 1 > self.row:
            self.complete(ready[:, :3], newest - 1)

    def complete(self, cells: np.ndarray, row: int) -> None:
        """All rows up to ``row`` are complete; ``cells`` (slice, row, col) are those of rows after the last complete one."""
        # lines of runs: rows that follow each other are ``width`` apart, others further, and slices of a row 1
        width = self.slices + 3
        rows, at = np.unique(np.append(cells[:, 1], self.row), return_inverse=True)
        rank = np.cumsum(np.minimum(np.diff(rows, prepend=rows[0]), 2))
        line = lambda z, k: rank[k] * width + z - self.first_slice + 1
        runs = _runs(np.stack((line(cells[:, 0], at[:-1]), cells[:, 2]), axis=1))
        held = np.column_stack((line(self.held[:, 0], at[-1]), self.held[:, 1:3]))
        z = runs[:, 0] % width + self.first_slice - 1
        y = rows[np.searchsorted(rank, runs[:, 0] // width)]
        inside, was_inside = z < self.beyond, self.held[:, 3] >= 0
        own, z, y, zb, yb = runs[inside], z[inside], y[inside], z[~inside], y[~inside]
        old = int(was_inside.sum())
        comp = np.concatenate((self.held[was_inside, 3], (self.slab << COMP_BITS) + self.count + np.arange(len(own))))
        self.count += len(own)
        both = np.concatenate((held[was_inside], own))
        i, k = _touching(own, both, (-1, -width - 1, -width, 1 - width))
        if len(i):
            found = components._least(comp[old + i], comp[k])
            v, root = found["v"].to_numpy(np.int64), found["root"].to_numpy(np.int64)

            def now(names: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(v, names), len(v) - 1)
                return np.where(v[at] == names, root[at], names)

            before = self.opened[:, 0].copy()
            comp, self.opened[:, 0] = now(comp), now(before)
            merged = before != self.opened[:, 0]
            self.given("link", a=before[merged], b=self.opened[merged, 0])
        names = comp[old:]
        self.opened = _folded(np.concatenate((self.opened, _of_runs(names, z, y, own[:, 1], own[:, 2]))))
        # seams: a run beyond that touches one of this slab's, in its row or the one before or after; those of held runs are known
        far, was_beyond = np.concatenate((held[~was_inside], runs[~inside])), int((~was_inside).sum())
        zb, yb = np.concatenate((self.held[~was_inside, 0], zb)), np.concatenate((np.full(was_beyond, self.row), yb))
        i, k = _touching(both, far, (1, 1 - width, 1 + width))
        new = (i >= old) | (k >= was_beyond)
        seams = np.unique(np.stack((comp[i[new]], k[new]), axis=1), axis=0)
        i, k = seams.T
        self.given("lower", a=i, slice=zb[k], row=yb[k], x0=far[k, 1])
        edge = (z == self.first_slice) & (self.slab > 0)
        self.given("upper", a=names[edge], slice=z[edge], row=y[edge], x0=own[edge, 1])
        last, last_beyond = y == row, yb == row
        ended = ~np.isin(self.opened[:, 0], names[last])
        self.closed(self.opened[ended])
        self.opened = self.opened[~ended]
        none = lambda k, value: np.full(int(k.sum()), value)
        self.held = np.concatenate((np.column_stack((z[last], own[last, 1:], names[last], none(last, 0))), np.column_stack((zb[last_beyond], far[last_beyond, 1:], none(last_beyond, -1), none(last_beyond, 0)))))
        self.row = row


class _Rows(StatefulProcessor):
    def __init__(self, slices: int):
        self.slices = slices

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slab", "row int, count long, held binary, opened binary, waiting binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = lambda data, width: np.frombuffer(bytes(data), np.int64).reshape(-1, width).copy()
        found = self.state.get()
        if found is not None:
            row, count, *arrays = found
            slab = _Slab(int(key[0]), self.slices, row, count, *(table(x, w) for x, w in zip(arrays, (_RUN, _OPEN, _RUN), strict=True)))
        else:
            slab = _Slab(int(key[0]), self.slices)
        slab.take(np.concatenate([r[["slice", "row", "col"]].to_numpy(np.int64) for r in rows]))
        self.state.update((slab.row, slab.count, slab.held.tobytes(), slab.opened.tobytes(), slab.waiting.tobytes()))
        if slab.out:
            yield _completed(*slab.out)

    def close(self) -> None:
        pass


def _completed(*frames: pd.DataFrame) -> pd.DataFrame:
    """Frames one after the other, with all columns of OUTPUT, in order; those that a frame lacks are null."""
    sizes = [len(f) for f in frames]
    columns = {"kind": np.concatenate([f["kind"].to_numpy(object) for f in frames])}
    for name, dtype in _INTEGERS:
        values = np.concatenate([f[name].to_numpy(dtype) if name in f else np.zeros(n, dtype) for f, n in zip(frames, sizes, strict=True)])
        columns[name] = pd.arrays.IntegerArray(values, np.repeat([name not in f for f in frames], sizes))
    return pd.DataFrame(columns)


def labelled(cells: DataFrame, slices: int = SLICES) -> DataFrame:
    """The stream of what the module's docstring lists, from a stream of cells (slab, slice, row, col) as ``dealt`` gives them.

    The session must use the RocksDB state store, as ``advanced`` sees to.
    """
    return cells.groupBy("slab").transformWithStateInPandas(_Rows(slices), OUTPUT, "Append", "None")


def state_partitions(spark: SparkSession) -> int:
    """As many as the session shuffles to, but not more than PER_CORE for each core: every run opens and commits a store for each."""
    return min(int(spark.conf.get(_PARTITIONS)), PER_CORE * spark.sparkContext.defaultParallelism)


def advanced(spark: SparkSession, source: str, sink: str, checkpoint: str, slices: int = SLICES) -> None:
    """Takes in all cells that are new in the folder ``source`` and adds what comes of them to ``sink``; state is kept in ``checkpoint``.

    It may be called again whenever there are more cells, by another application too; the number of state partitions stays
    that of the first call.
    """
    settings = _SETTINGS | {_PARTITIONS: str(state_partitions(spark))}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        stream = labelled(spark.readStream.schema(CELLS).parquet(source), slices)
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def features_of(given: DataFrame) -> DataFrame:
    """Features by label from all that a stream gave out: parts folded over links and seams."""
    at = ["slice", "row", "x0"]
    lower, upper = (given.where(F.col("kind") == k).select(*at, F.col("a").alias(n)) for k, n in (("lower", "a"), ("upper", "b")))
    links = given.where("kind = 'link'").select("a", "b").unionByName(lower.join(upper, at).select("a", "b"))
    names = written(components.connected(links), "stream-names").select(F.col("v").alias("comp"), "root")
    parts = given.where("kind = 'part'").select(F.col("a").alias("comp"), *_PART)
    return features.of_parts(parts, names)
