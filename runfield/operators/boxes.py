"""Very many boxes at once: a spatial join by regions, and for large boxes one by tiles, with features of whole tiles from a pyramid.

A region is a block of slices and rows. A small box goes to the one that it begins in, a run to its own and to those before
it, from which boxes can reach it. So boxes meet runs, and are added up, where both were dealt to: the shuffle is that of
boxes and of four copies of runs, not that of all labels of all boxes.

A tile of a level is a square of so many slices and rows. A box is cut into the largest tiles that lie inside it, and its
rim into smaller ones, down to single rows of a slice; so tiles grow with a box's rim, not its area, and a box never meets
runs, only a tile's partial features of each label. Levels, the pyramid and the cutting are plans of built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfield.operators import features
from runfield.sources.shared import written

#: Slices, and rows, of a tile of each level; each divides the next.
LEVELS = (1, 4, 16)
#: Slices and rows of a region, for small boxes and for longer ones. A box of one more reaches into the next region at most.
REGIONS = ((6, 8), (6, 64))
#: Rows of boxes, or copies of runs, that are dealt to one task.
TASK_ROWS = 1 << 19


def pyramid(labelled: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """size, tz, ty, label and features of the runs of every tile of every level."""
    rows = features.of_runs(labelled, keys=("slice", "row", "label"))
    each = rows.withColumn("size", F.explode(F.array(*map(F.lit, levels))))
    tiled = each.withColumns({"tz": F.expr("slice div size"), "ty": F.expr("row div size")}).drop("slice", "row")
    return features.folded(tiled, ["size", "tz", "ty", "label"])


def _sequence(a: str, b: str) -> str:
    return f"if({a} <= {b}, sequence({a}, {b}), array())"


def tiles(boxes: DataFrame, levels: tuple[int, ...] = LEVELS, keep: tuple[str, ...] = ()) -> DataFrame:
    """box, what is to be kept, size, tz, ty: disjoint tiles that make up each box (box, z0, z1, y0, y1; ends included, coordinates >= 0)."""
    parts = []
    for k, size in enumerate(levels):
        upper = levels[k + 1] if k + 1 < len(levels) else None
        inside = lambda a, b, s: (f"({a} + {s - 1}) div {s}", f"({b} + 1) div {s} - 1")
        sized = boxes.selectExpr("box", *keep, *(f"cast({e} as bigint) AS {n}" for axis in "zy" for e, n in zip(inside(f"{axis}0", f"{axis}1", size), (f"{axis}a", f"{axis}b"), strict=True)), "z0", "z1", "y0", "y1")
        if upper:
            r = upper // size
            # what the next level's tiles cover, in tiles of this one
            covered = [f"cast(({e}) * {r} + {d} as bigint) AS {n}" for axis in "zy" for e, d, n in zip(inside(f"{axis}0", f"{axis}1", upper), (0, r - 1), (f"{axis}c", f"{axis}d"), strict=True)]
            sized = sized.selectExpr("box", *keep, "za", "zb", "ya", "yb", *covered)
            rim = f"if(yc <= yd and tz between zc and zd, concat({_sequence('ya', 'yc - 1')}, {_sequence('yd + 1', 'yb')}), {_sequence('ya', 'yb')})"
        else:
            rim = _sequence("ya", "yb")
        slices = sized.withColumn("tz", F.explode(F.expr(_sequence("za", "zb"))))
        parts.append(slices.select("box", *keep, F.lit(size).alias("size"), "tz", F.explode(F.expr(rim)).alias("ty")))
    return _united(parts)


@dataclass(frozen=True)
class _Sized:
    """``boxes``, written: what was asked for inside of the grid, ``n``, a number of each row, and ``level``.

    ``level`` is the place of the least of REGIONS that the box fits, -1 for a larger one, null for one outside of the grid.
    ``tasks`` has the levels that there are, and how many tasks their boxes and runs are dealt to.
    """

    boxes: DataFrame
    tasks: dict[int, int]


def _sized(boxes: DataFrame, labelled: DataFrame, regions: tuple[tuple[int, int], ...], keep: tuple[str, ...] = (), folded: bool = False) -> _Sized:
    """Boxes (box, z0, z1, y0, y1) by size; if they are to be ``folded`` by name, those that share one are with the larger ones."""
    runs, top_z, top_y = labelled.agg(F.count("*"), F.max("slice"), F.max("row")).first()
    top = lambda c, x: F.least(F.col(c), F.lit(-1 if x is None else x)).alias(c)
    low = lambda c: F.greatest(F.col(c), F.lit(0)).alias(c)
    found = boxes.select("box", low("z0"), top("z1", top_z), low("y0"), top("y1", top_y), *keep)
    level = F.when(F.col("z0").isNull() | F.col("z1").isNull() | F.col("y0").isNull() | F.col("y1").isNull() | (F.col("z0") > F.col("z1")) | (F.col("y0") > F.col("y1")), None)
    if folded:
        names = written(boxes.groupBy("box").count().where("count > 1").select(F.col("box").alias("name"), F.lit(True).alias("shared")), "shared-names")
        found = found.join(names, F.col("box").eqNullSafe(F.col("name")), "left").drop("name")
        level = level.when(F.col("shared"), -1)
    for k, (slices, rows) in enumerate(regions):
        level = level.when((F.col("z1") - F.col("z0") <= slices) & (F.col("y1") - F.col("y0") <= rows), k)
    found = found.withColumn("level", level.otherwise(-1)).drop("shared").withColumn("n", F.monotonically_increasing_id())
    out = written(found, "boxes")
    sums = out.where("level is not null").groupBy("level").agg(F.sum(F.expr("(z1 - z0 + 1) * (y1 - y0 + 1)")).alias("rows")).collect()
    least = labelled.sparkSession.sparkContext.defaultParallelism
    return _Sized(out, {r["level"]: max(least, -(-max(r["rows"], 4 * runs) // TASK_ROWS)) for r in sums})


def _dealt(sized: _Sized, level: int, labelled: DataFrame, region: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Boxes of a level and runs (columns r_), both by the region (rz, ry), in as many tasks."""
    z, y = region
    home = sized.boxes.where(F.col("level") == level).withColumns({"rz": F.expr(f"cast(z0 div {z} as bigint)"), "ry": F.expr(f"cast(y0 div {y} as bigint)")})
    reach = lambda c, n: F.explode(F.expr(f"filter(array({c} div {n}, {c} div {n} - 1), x -> x >= 0)"))
    runs = labelled.select(*(F.col(c).alias(f"r_{c}") for c in ("slice", "row", "x0", "x1", "label")))
    near = runs.select("*", reach("r_slice", z).alias("rz")).select("*", reach("r_row", y).alias("ry"))
    return tuple(df.repartition(sized.tasks[level], "rz", "ry") for df in (home, near))


#: Whether a run lies in a box.
_INSIDE = "r_slice between z0 and z1 and r_row between y0 and y1"


def in_boxes(labelled: DataFrame, boxes: DataFrame, levels: tuple[int, ...] = LEVELS, regions: tuple[tuple[int, int], ...] = REGIONS) -> DataFrame:
    """box, label and features from the whole runs of the slices z0 .. z1 and rows y0 .. y1 of each box, as ``features.in_box`` for one.

    A box without runs gives no row. Boxes of one name are one box, whose runs count for each of them.
    """
    sized, parts = _sized(boxes, labelled, regions, folded=True), []
    for level in sorted(k for k in sized.tasks if k >= 0):
        home, near = _dealt(sized, level, labelled, regions[level])
        met = home.select("rz", "ry", "box", "z0", "z1", "y0", "y1").join(near, ["rz", "ry"]).where(_INSIDE)
        runs = met.select("rz", "ry", "box", *(F.col(f"r_{c}").alias(c) for c in ("slice", "row", "x0", "x1", "label")))
        parts.append(features.of_runs(runs, keys=("rz", "ry", "box", "label")).drop("rz", "ry"))
    if -1 in sized.tasks or not parts:
        met = tiles(sized.boxes.where("level = -1"), levels).join(pyramid(labelled, levels), ["size", "tz", "ty"])
        parts.append(features.folded(met, ["box", "label"]))
    return _united(parts)


def areas_have(labelled: DataFrame, boxes: DataFrame, regions: tuple[tuple[int, int], ...] = REGIONS) -> DataFrame:
    """box, ok: whether every foreground cell of the box (with x0, x1 and ``expected``; ends included) has the expected label.

    Each row of ``boxes`` gives one, also those of one name.
    """
    sized = _sized(boxes, labelled, regions, ("x0", "x1", "expected"))
    parts = [sized.boxes.where("level is null").select("box", F.lit(True).alias("ok"))]
    wrong = "r_x0 <= x1 and r_x1 > x0 and r_label <> expected"
    for level in sorted(k for k in sized.tasks if k >= 0):
        home, near = _dealt(sized, level, labelled, regions[level])
        met = (home["rz"] == near["rz"]) & (home["ry"] == near["ry"]) & F.expr(f"{_INSIDE} and {wrong}")
        parts += (home.join(near, met, how).select("box", F.lit(ok).alias("ok")) for how, ok in (("left_semi", False), ("left_anti", True)))
    if -1 in sized.tasks:
        large = sized.boxes.where("level = -1")
        rows = tiles(large.drop("box").withColumnRenamed("n", "box"), (1,), ("x0", "x1", "expected")).withColumnRenamed("box", "n")
        runs = labelled.select(*(F.col(c).cast("bigint").alias(t) for c, t in (("slice", "tz"), ("row", "ty"))), *(F.col(c).alias(f"r_{c}") for c in ("x0", "x1", "label")))
        found = rows.join(runs, ["tz", "ty"]).where(wrong).select("n").distinct().withColumn("wrong", F.lit(True))
        parts.append(large.select("box", "n").join(found, "n", "left").select("box", F.col("wrong").isNull().alias("ok")))
    return _united(parts)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
