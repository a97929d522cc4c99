"""Label images from labelled runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfield.operators.rle import every_cell
from runfield.sources.volumes import Dims

#: Labels that a task counts up at a time.
BLOCK = 1 << 16


def label_cells(labelled: DataFrame) -> DataFrame:
    """slice, row, col, label of every foreground cell; background is not written."""
    return labelled.select("slice", "row", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("col"), "label")


def dense_labels(labelled: DataFrame, dims: Dims) -> DataFrame:
    """slice, row, col, label of every cell, 0 in the background."""
    return every_cell(labelled, dims, "label", F.lit(0).cast("long")).withColumnRenamed("value", "label")


def labels_by_position(er: DataFrame, labelled: DataFrame) -> DataFrame:
    """The cells of ``label_cells`` by looking up each foreground cell's run: an odd ``er`` names run (er - 1) div 2."""
    inside = er.where("er % 2 = 1").select("slice", "row", "col", F.expr("cast((er - 1) div 2 as int)").alias("seg"))
    return inside.join(labelled.select("slice", "row", "seg", "label"), ["slice", "row", "seg"]).select("slice", "row", "col", "label")


def palette(labels: DataFrame) -> DataFrame:
    """label, r, g, b: a colour from 55 to 255 in each channel for each distinct label, black for 0."""
    shade = lambda k: F.when(F.col("label") == 0, 0).otherwise((F.col("label") % 1048573 * k + 12345) % 65521 % 201 + 55).cast("int")
    return labels.select("label").distinct().select("label", shade(48271).alias("r"), shade(40692).alias("g"), shade(69621).alias("b"))


def histogram(cells: DataFrame, dims: Dims) -> DataFrame:
    """label, n for 0 .. the greatest label, with 0 for the background that ``cells`` leaves out."""
    counts = cells.groupBy("label").agg(F.count("*").alias("n"))
    found = counts.agg(F.coalesce(F.max("label"), F.lit(0)).alias("top"), F.coalesce(F.sum("n"), F.lit(0)).alias("set"))
    # all labels up to the top, in blocks that are dealt out before they are filled in
    blocks = found.select("top", (F.lit(dims.cells) - F.col("set")).alias("zeros"), F.explode(F.expr(f"sequence(0L, top div {BLOCK})")).alias("block")).repartition("block")
    every = blocks.select(F.explode(F.expr(f"sequence(block * {BLOCK}, least(top, (block + 1) * {BLOCK} - 1))")).alias("label"), "zeros")
    return every.join(counts, "label", "left").select("label", F.when(F.col("label") == 0, F.col("zeros") + F.coalesce("n", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"))


def rendered(cells: DataFrame, width: int = 2) -> DataFrame:
    """slice, row, line: each row's labels in order of their columns, padded, with blanks between."""
    each = F.array_sort(F.collect_list(F.struct("col", F.lpad(F.col("label").cast("string"), width, " ").alias("v"))))
    return cells.groupBy("slice", "row").agg(F.array_join(F.transform(each, lambda x: x["v"]), " ").alias("line"))
