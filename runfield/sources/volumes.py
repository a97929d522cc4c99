"""Grids as tables: adaptors from the driver's tables, generators, padding and reshaping.

A grid is sparse, ``voxels(slice, row, col)`` with foreground cells only, or dense, with ``val``. A 2-D image has slice 0.
Every function returns a plan; cells come from ``range``, so a generated grid is spread over the cluster from the start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dims:
    """Extent of a grid in cells."""

    width: int
    height: int
    depth: int = 1

    @property
    def cells(self) -> int:
        return self.width * self.height * self.depth


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(df: DataFrame, slice_: Column, row: Column, col: Column, distinct: bool = True) -> DataFrame:
    """Cells, distinct ones if they are to be; rows in which a coordinate is null name no cell."""
    cells = df.select(slice_.cast("int").alias("slice"), row.cast("int").alias("row"), col.cast("int").alias("col"))
    cells = cells.where("slice is not null and row is not null and col is not null")
    return cells.distinct() if distinct else cells


def shipments(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Supplier x month since 1995 x day of month of returned line items. Runs need no ``distinct`` cells, which take a shuffle."""
    day = F.col("l_shipdate")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return _cells(returned, F.col("l_suppkey"), (F.year(day) - 1995) * 12 + F.month(day) - 1, F.dayofmonth(day) - 1, distinct)


def activity(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """User x day since 2024-01-01 x hour of events; earlier events lie outside the grid. ``distinct`` as in ``shipments``."""
    return _cells(table(spark, sf_dir, "events"), *activity_place(), distinct).where("row >= 0")


def activity_place() -> tuple[Column, Column, Column]:
    """slice, row and col of an event."""
    ts = F.col("ts")
    return F.col("user_id").cast("int"), F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")), F.hour(ts)


def embedding_bits(spark: SparkSession, sf_dir: str, threshold: float = 0.15) -> DataFrame:
    """A 2-D image: vector x component, set where the component is over the threshold."""
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "x"))
    return _cells(each.where(F.col("x").cast("double") > threshold), F.lit(0), F.col("vec_id"), F.col("col"))


def from_row_major(df: DataFrame, array: str, width: int, slice_col: str | None = None) -> DataFrame:
    """Cells (slice, row, col, val) of row-major arrays, one image for each row of ``df``, at the slice that it names (0 without)."""
    at = F.col(slice_col).cast("int") if slice_col else F.lit(0)
    each = df.select(at.alias("slice"), F.posexplode(array).alias("pos", "val"))
    return each.select("slice", F.expr(f"cast(pos div {width} as int)").alias("row"), (F.col("pos") % width).alias("col"), "val")


def generate(spark: SparkSession, dims: Dims, value: Column | str) -> DataFrame:
    """Every cell of the grid with ``val``, an expression of slice, row and col."""
    w, h = dims.width, dims.height
    cells = spark.range(dims.cells).selectExpr(f"cast(id div {w * h} as int) AS slice", f"cast(id div {w} % {h} as int) AS row", f"cast(id % {w} as int) AS col")
    return cells.withColumn("val", F.expr(value) if isinstance(value, str) else value)


def random_bits(spark: SparkSession, dims: Dims, seed: int, density: float) -> DataFrame:
    """A Bernoulli bitmap. Bits depend on the seed and the cell only, so a recomputed partition has the same ones."""
    return generate(spark, dims, hashed_bit(dims, seed, density))


def hashed_bit(dims: Dims, seed: int, density: float) -> str:
    """An integer expression that is 1 for about ``density`` of cells: two rounds of a multiplicative hash of the cell's number."""
    cell = f"((cast(slice as bigint) * {dims.height} + row) * {dims.width} + col + {seed})"
    once = f"({cell} % 1048573 * 48271 + 11) % 2147483647"
    return f"cast(case when ({once}) % 65521 * 48271 % 65521 < {round(density * 65521)} then 1 else 0 end as int)"


def fill(spark: SparkSession, dims: Dims, value: int) -> DataFrame:
    return generate(spark, dims, F.lit(value))


def fill_box(dense: DataFrame, value: int, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Sets ``val`` in the box from ``low`` to ``high``, (slice, row, col) and inclusive."""
    inside = F.lit(True)
    for name, a, b in zip(("slice", "row", "col"), low, high, strict=True):
        inside = inside & F.col(name).between(a, b)
    return dense.withColumn("val", F.when(inside, F.lit(value)).otherwise(F.col("val")))


def pad(dense: DataFrame, dims: Dims, before: int, after: int | None = None) -> DataFrame:
    """A border of zeros around a dense grid, which holds all cells of ``dims``; slices get one only if the grid has several."""
    after = before if after is None else after
    deep = dims.depth > 1
    full = Dims(dims.width + before + after, dims.height + before + after, dims.depth + (before + after) * deep)
    shifted = dense.select((F.col("slice") + before * deep).alias("slice"), (F.col("row") + before).alias("row"), (F.col("col") + before).alias("col"), "val")
    within = F.col("slice").between(before * deep, before * deep + dims.depth - 1) & F.col("row").between(before, before + dims.height - 1) & F.col("col").between(before, before + dims.width - 1)
    return shifted.unionByName(generate(dense.sparkSession, full, F.lit(0)).where(~within))


def transpose(grid: DataFrame) -> DataFrame:
    """Rows and columns swapped in every slice; other columns stay."""
    others = [c for c in grid.columns if c not in ("slice", "row", "col")]
    return grid.select("slice", F.col("col").alias("row"), F.col("row").alias("col"), *others)


def foreground(dense: DataFrame) -> DataFrame:
    """The cells whose lowest bit is set, without ``val``."""
    return dense.where(F.col("val").bitwiseAND(1) == 1).select("slice", "row", "col")


def dimensions(voxels: DataFrame) -> DataFrame:
    """width, height, depth: one row, zeros for an empty grid."""
    size = lambda c: (F.coalesce(F.max(c), F.lit(-1)) + 1).cast("int")
    return voxels.agg(size("col").alias("width"), size("row").alias("height"), size("slice").alias("depth"))


def linear_index(grid: DataFrame, dims: DataFrame) -> DataFrame:
    """``pos``, the place of each cell in row-major order; ``dims`` is the one row of ``dimensions``."""
    place = (F.col("slice").cast("long") * F.col("height") + F.col("row")) * F.col("width") + F.col("col")
    return grid.crossJoin(F.broadcast(dims)).withColumn("pos", place).drop("width", "height", "depth")
