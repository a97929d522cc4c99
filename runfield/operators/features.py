"""Features of components: volume, first moments and bounding box, as one hash aggregation with partial sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfield.operators.rle import ROWS, numbered
from runfield.sources.shared import written

SUMS = ("S", "Sx", "Sy", "Sz")
LOWS = ("lo_col", "lo_row", "lo_slice")
HIGHS = ("hi_col", "hi_row", "hi_slice")
#: Place of a part's first run in raster order.
FIRST = ("first_slice", "first_row", "first_x0")


@dataclass(frozen=True)
class FeatureConfig:
    """Which features are wanted; columns of others are not computed."""

    volume: bool = True
    moments: bool = True
    box: bool = True

    @property
    def columns(self) -> tuple[str, ...]:
        return SUMS[:1] * self.volume + SUMS[1:] * self.moments + (LOWS + HIGHS) * self.box


def _run_values() -> dict[str, Column]:
    size = (F.col("x1") - F.col("x0")).cast("long")
    return {
        "S": size, "Sx": F.expr("cast(x0 + x1 - 1 as bigint) * (x1 - x0) div 2"), "Sy": F.col("row") * size, "Sz": F.col("slice") * size,
        "lo_col": F.col("x0"), "lo_row": F.col("row"), "lo_slice": F.col("slice"), "hi_col": F.col("x1"), "hi_row": F.col("row") + 1, "hi_slice": F.col("slice") + 1,
    }


def _folds(config: FeatureConfig) -> list[Column]:
    how = {c: F.sum for c in SUMS} | {c: F.min for c in LOWS} | {c: F.max for c in HIGHS}
    kind = lambda c: "long" if c in SUMS else "int"
    return [how[c](c).cast(kind(c)).alias(c) for c in config.columns]


def folded(rows: DataFrame, keys: list[str], config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Partial features added up by ``keys``."""
    return rows.groupBy(*keys).agg(*_folds(config))


def of_runs(labelled: DataFrame, config: FeatureConfig = FeatureConfig(), keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Features by label (and other keys) from runs; ``lo_*`` are inclusive and ``hi_*`` exclusive bounds."""
    values = _run_values()
    return folded(labelled.select(*keys, *(values[c].alias(c) for c in config.columns)), list(keys), config)


def parts_of_runs(runs: DataFrame) -> DataFrame:
    """Partial features by comp, and FIRST, from runs of which ``first`` marks one of each comp. One hash aggregation."""
    values = _run_values()
    at = {c: F.when(F.col("first"), F.col(c.removeprefix("first_"))).alias(c) for c in FIRST}
    each = runs.select("comp", *(values[c].alias(c) for c in FeatureConfig().columns), *at.values())
    return each.groupBy("comp").agg(*_folds(FeatureConfig()), *(F.min(c).alias(c) for c in FIRST))


def of_runs_2d(labelled: DataFrame) -> DataFrame:
    """Features of 2-D components, by slice and label. ``hi_row`` is the last row, inclusive, while ``hi_col`` is exclusive."""
    found = of_runs(labelled, keys=("slice", "label"))
    return found.select("slice", "label", "S", "Sx", "Sy", "lo_col", "lo_row", "hi_col", (F.col("hi_row") - 1).alias("hi_row"))


def of_cells(cells: DataFrame, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Features by label from single foreground cells (slice, row, col, label)."""
    return of_runs(cells.where("label <> 0").select("slice", "row", F.col("col").alias("x0"), (F.col("col") + 1).alias("x1"), *(k for k in keys if k != "slice")), keys=keys)


def of_cells_2d(cells: DataFrame) -> DataFrame:
    found = of_cells(cells, keys=("slice", "label"))
    return found.select("slice", "label", "S", "Sx", "Sy", "lo_col", "lo_row", "hi_col", (F.col("hi_row") - 1).alias("hi_row"))


def in_box(labelled: DataFrame, slices: tuple[int, int], rows: tuple[int, int], labels: tuple[int, int] | None = None) -> DataFrame:
    """Features from the runs of some slices and rows (both ends included; whole runs), of labels from the first up to the second."""
    inside = labelled.where(F.col("slice").between(*slices) & F.col("row").between(*rows))
    if labels:
        inside = inside.where((F.col("label") >= labels[0]) & (F.col("label") < labels[1]))
    return of_runs(inside)


def by_row(labelled: DataFrame) -> DataFrame:
    """Partial features by slice, row and label."""
    return of_runs(labelled, keys=("slice", "row", "label"))


def merged(partial: DataFrame, names: DataFrame) -> DataFrame:
    """Features of ``partial`` (label and features) folded together under ``names`` (label, into)."""
    return folded(partial.join(names, "label").drop("label").withColumnRenamed("into", "label"), ["label"])


def of_parts(parts: DataFrame, names: DataFrame) -> DataFrame:
    """Features by label from partial ones: ``parts`` (comp, features, FIRST: place of its first run), ``names`` (comp, root).

    A comp without a name is its own root. Labels are numbered in raster order of components' first runs.
    """
    rooted = parts.join(names.select("comp", "root"), "comp", "left").withColumn("root", F.coalesce("root", "comp"))
    rooted = written(rooted.select("root", *FIRST, *FeatureConfig().columns), "rooted-parts")
    starts = rooted.groupBy("root").agg(F.min(F.struct(*FIRST)).alias("f")).select("root", F.col("f.first_slice").alias("slice"), F.col("f.first_row").alias("row"), F.col("f.first_x0").alias("x0"))
    labels = numbered(starts, ["slice", "row"], ["x0"], F.floor(F.col("row") / ROWS), "label").select("root", "label")
    return folded(rooted, ["root"]).join(labels, "root").select("label", *FeatureConfig().columns)


def normalized(features: DataFrame, names: DataFrame) -> DataFrame:
    """Features under new labels, ``names`` (src, dst); labels without a name are left out. If two share a dst, the greater src counts."""
    last = names.groupBy("dst").agg(F.max("src").alias("src"))
    return features.join(last, features["label"] == last["src"]).drop("label", "src").withColumnRenamed("dst", "label").select("label", *(c for c in features.columns if c != "label"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """label of the components whose features differ or that one side lacks."""
    columns = [c for c in a.columns if c != "label"]
    left, right = a.select("label", F.struct(*columns).alias("x")), b.select("label", F.struct(*columns).alias("y"))
    return left.join(right, "label", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("label")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: equal (boolean) and n_differing."""
    return differing(a, b).agg((F.count("*") == 0).alias("equal"), F.count("*").alias("n_differing"))


def centroids(features: DataFrame) -> DataFrame:
    """label, cx, cy, cz: the mean place of a component's cells."""
    return features.select("label", *((F.col(f"S{a}") / F.col("S")).alias(f"c{a}") for a in "xyz"))
