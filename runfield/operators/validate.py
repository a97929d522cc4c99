"""Comparing label images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfield.sources.shared import written

CELL = ["slice", "row", "col"]
#: Extent of a tile that has one checksum, in each direction.
TILE = 32


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """slice, row, col, left, right of the cells whose labels differ; a cell that one side lacks is null there."""
    both = a.select(*CELL, F.col("label").alias("left")).join(b.select(*CELL, F.col("label").alias("right")), CELL, "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: equal (boolean) and n_differing cells."""
    return differences(a, b).agg((F.count("*") == 0).alias("equal"), F.count("*").alias("n_differing"))


def digests(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """tz, ty, tx, n, x, s: for each tile with cells, their number and two sums over their hashes that no order changes."""
    at = [F.floor(F.col(c) / tile).cast("int").alias(f"t{a}") for c, a in zip(CELL, "zyx", strict=True)]
    hashed = cells.select(*at, F.xxhash64(*CELL, "label").alias("h"))
    return hashed.groupBy("tz", "ty", "tx").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"))


def differing_tiles(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """tz, ty, tx of the tiles whose checksums differ or that one side lacks."""
    of = lambda df, name: digests(df, tile).select("tz", "ty", "tx", F.struct("n", "x", "s").alias(name))
    return of(a, "p").join(of(b, "q"), ["tz", "ty", "tx"], "full").where(~F.col("p").eqNullSafe(F.col("q"))).select("tz", "ty", "tx")


def differences_by_tiles(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """``differences``, but only cells of tiles that differ are joined: images that are mostly alike shuffle checksums alone."""
    tiles = written(differing_tiles(a, b, tile), "tiles")
    at = [F.floor(F.col(c) / tile).cast("int") == F.col(f"t{x}") for c, x in zip(CELL, "zyx", strict=True)]
    within = lambda df: df.join(tiles, at[0] & at[1] & at[2], "left_semi")
    return differences(within(a), within(b))


def area_has(cells: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], expected: int) -> DataFrame:
    """One row, ok: whether every given cell of the box (slice, row, col; ends included) has the label; true for no cells."""
    inside = F.lit(True)
    for name, x, y in zip(CELL, low, high, strict=True):
        inside = inside & F.col(name).between(x, y)
    return cells.where(inside).agg(F.coalesce(F.bool_and(F.col("label") == expected), F.lit(True)).alias("ok"))
