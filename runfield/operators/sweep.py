"""Densities of thresholds: the share of values above each, by running sums over sorted values, never a threshold times a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfield.functions.scalars import closest
from runfield.sources.shared import written


def of_steps(df: DataFrame, by: str, value: str, step: int, steps: int) -> DataFrame:
    """``by``, threshold, density for the thresholds 0, step .. (steps - 1) * step: each value is counted at the one step that it ends.

    A value lies above the first ceil(value / step) thresholds, so the counts of at most ``steps`` + 1 numbers of a group
    are all that is summed up. Nulls lie above none; NaN, which is greater than any number, above all.
    """
    v = F.col(value)
    above = F.when(v.isNull(), 0).when(F.isnan(v.cast("double")), steps).otherwise(F.least(F.greatest(F.ceil(v / step), F.lit(0)), F.lit(steps))).cast("int")
    counts = df.groupBy(by, above.alias("above")).agg(F.count("*").alias("n"))
    whole = counts.groupBy(by).agg(F.sum("n").alias("total"))
    # every threshold of every group has a row, if only with 0
    none = whole.select(by, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("above"), F.lit(0).cast("long").alias("n"))
    each = counts.where("above > 0").unionByName(none).groupBy(by, "above").agg(F.sum("n").alias("n"))
    upper = F.sum("n").over(Window.partitionBy(by).orderBy(F.col("above").desc()))
    return each.withColumn("n", upper).join(whole, by).select(by, ((F.col("above") - 1) * step).cast("int").alias("threshold"), (F.col("n").cast("double") / F.col("total")).alias("density"))


def of_values(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by``, threshold, density for every distinct value as a threshold.

    Distinct values are dealt by ranges of (by, value), summed up inside a range, and ranges are then summed up by their
    totals, of which there is one for each group and range; so a group of very many values is spread over tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("threshold")).agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange(by, "threshold").withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(by, "range").agg(F.sum("n").alias("in_range"))
    order = Window.partitionBy(by).orderBy("range")
    placed = totals.select(by, "range", F.coalesce(F.sum("in_range").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("in_range").over(Window.partitionBy(by)).alias("total"))
    upto = F.sum("n").over(Window.partitionBy(by, "range").orderBy("threshold"))
    found = ranged.withColumn("upto", upto).join(placed, [by, "range"])
    return found.select(by, "threshold", ((F.col("total") - F.col("before") - F.col("upto")).cast("double") / F.col("total")).alias("density"))


def nearest(densities: DataFrame, by: str, desired: float | Column) -> DataFrame:
    """``by``, threshold: of each group, the threshold whose density is nearest to ``desired``; the least of a tie."""
    return closest(densities, "threshold", F.abs(F.col("density") - desired), "threshold", [by])
