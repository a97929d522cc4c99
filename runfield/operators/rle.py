"""Run-length encoding of grid rows.

A run is a longest stretch of foreground cells of one row, half-open [x0, x1). ``segments`` holds slice, row, seg (the
run's number in its row, from 0), x0, x1 and seg_id (its number in raster order, from 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfield.sources.volumes import Dims

#: Rows of a slice that are numbered together, and slices whose bands are summed up together.
ROWS, SLICES = 1024, 4096
#: Cells of a dense grid that one task spreads out.
TASK_CELLS = 1 << 20


def _in_row():
    return Window.partitionBy("slice", "row")


def runs(voxels: DataFrame) -> DataFrame:
    """slice, row, x0, x1. One shuffle by row and one sort; a cell that comes twice counts once.

    Of a sorted row only the first and the last cell of each run are kept, so no task gathers runs or cells in memory.
    """
    order = _in_row().orderBy("col")
    before, after = F.lag("col").over(order), F.lead("col").over(order)
    ends = voxels.select("slice", "row", "col", (before.isNull() | (before < F.col("col") - 1)).alias("first"), (after.isNull() | (after > F.col("col") + 1)).alias("last")).where("first or last")
    last = F.when(F.col("last"), F.col("col")).otherwise(F.lead("col").over(order))
    return ends.withColumn("x1", last + 1).where("first").select("slice", "row", F.col("col").alias("x0"), "x1")


def numbered(rows: DataFrame, keys: list[str], order: list[str], band: Column, name: str) -> DataFrame:
    """``name``: each row's place, from 1, in the order of ``keys`` (of which the first two are slice and row), then ``order``.

    Rows are ranked inside a band of rows of a slice, sizes of bands are summed up inside SLICES slices, and only the sums
    of those, one for SLICES slices, in one task.
    """
    within = Window.partitionBy("slice", "band").orderBy(*keys, *order)
    banded = rows.withColumn("band", band)
    sizes = banded.groupBy("slice", "band").count()
    sizes = sizes.withColumn("part", F.floor(F.col("slice") / SLICES))
    running = lambda window, c: F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("count").alias("total")).select("part", running(Window.orderBy("part"), "total").alias("part_start"))
    inside = sizes.select("slice", "band", "part", running(Window.partitionBy("part").orderBy("slice", "band"), "count").alias("inside"))
    starts = inside.join(parts, "part").select("slice", "band", (F.col("part_start") + F.col("inside")).alias("start"))
    ranked = banded.withColumn("k", F.row_number().over(within))
    return ranked.join(starts, ["slice", "band"]).withColumn(name, (F.col("start") + F.col("k")).cast("long")).drop("band", "start", "k")


def segments(voxels: DataFrame) -> DataFrame:
    return numbered_runs(runs(voxels))


def numbered_runs(found: DataFrame) -> DataFrame:
    """Segments of runs (slice, row, x0, x1)."""
    seg = found.withColumn("seg", (F.row_number().over(_in_row().orderBy("x0")) - 1).cast("int"))
    return numbered(seg, ["slice", "row"], ["x0"], F.floor(F.col("row") / ROWS), "seg_id").select("slice", "row", "seg", "x0", "x1", "seg_id")


def closed(seg: DataFrame) -> DataFrame:
    """Runs with their last cell instead of the one after it."""
    return seg.withColumn("x1", F.col("x1") - 1)


def widened(seg: DataFrame, width: Column | int) -> DataFrame:
    """Closed runs made one cell longer on either side, inside 0 .. width - 1."""
    last = F.lit(width) if isinstance(width, int) else width
    return seg.withColumn("x0", F.greatest(F.col("x0") - 1, F.lit(0))).withColumn("x1", F.least(F.col("x1") + 1, last - 1))


def edges(dense: DataFrame) -> DataFrame:
    """``edge`` on every cell: whether its lowest bit differs from that of the cell before it (0 before the first)."""
    bit = F.col("val").bitwiseAND(1)
    return dense.withColumn("edge", bit.bitwiseXOR(F.coalesce(F.lag(bit).over(_in_row().orderBy("col")), F.lit(0))).cast("int"))


def relative_labels(dense: DataFrame) -> DataFrame:
    """``er`` on every cell: edges of the row up to it. Odd inside runs, where (er - 1) div 2 is the run's ``seg``."""
    upto = _in_row().orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return edges(dense).withColumn("er", F.sum("edge").over(upto).cast("long")).drop("edge")


def gaps(seg: DataFrame, width: int) -> DataFrame:
    """slice, row, x0, x1 of the background between, before and after the runs of every row that has runs."""
    order = _in_row().orderBy("x0")
    start, after = F.coalesce(F.lag("x1").over(order), F.lit(0)), F.lead("x0").over(order)
    sided = seg.select("slice", "row", start.alias("start"), "x0", "x1", after.isNull().alias("last"))
    gap = lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))
    own, tail = gap(F.col("start"), F.col("x0")), gap(F.col("x1"), F.lit(width))
    each = F.explode(F.when(F.col("last"), F.array(own, tail)).otherwise(F.array(own)))
    return sided.select("slice", "row", each.alias("gap")).select("slice", "row", "gap.x0", "gap.x1").where("x0 < x1")


def every_cell(seg: DataFrame, dims: Dims, value: str | Column, other: Column) -> DataFrame:
    """slice, row, col, value of every cell of the grid: that of the run (slice, row, x0, x1) that covers it, or ``other``.

    Runs, the gaps between them and rows without runs are dealt by row and spread out into cells there, so no cell is
    shuffled, then or in a window over rows. Runs outside ``dims`` have no cell.
    """
    value = F.col(value) if isinstance(value, str) else value
    inside = seg.where(F.col("slice").between(0, dims.depth - 1) & F.col("row").between(0, dims.height - 1) & (F.col("x0") >= 0) & (F.col("x1") <= dims.width))
    rows = seg.sparkSession.range(dims.depth * dims.height).selectExpr(f"cast(id div {dims.height} as int) AS slice", f"cast(id % {dims.height} as int) AS row")
    bare = rows.join(inside.select("slice", "row").distinct(), ["slice", "row"], "left_anti").withColumn("x0", F.lit(0)).withColumn("x1", F.lit(dims.width))
    empty = gaps(inside, dims.width).unionByName(bare).withColumn("value", other)
    # dealt anew, as a union of parts that are dealt by row need not be; by the number of cells, as runs don't tell how many come of them
    tasks = max(seg.sparkSession.sparkContext.defaultParallelism, -(-dims.cells // TASK_CELLS))
    dealt = inside.select("slice", "row", "x0", "x1", value.alias("value")).unionByName(empty).repartition(tasks, "slice", "row")
    return dealt.select("slice", "row", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("col"), "value")


def foreground_counts(seg: DataFrame) -> DataFrame:
    """slice, row, n: foreground cells by row."""
    return seg.groupBy("slice", "row").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("n"))
