"""Contacts of runs in neighbouring rows.

Runs a and b touch if a.x1 >= b.x0 and b.x1 >= a.x0 (half-open ends, so diagonal touch counts): 26-connectivity in three
dimensions, 8 in two. Of each two rows the later one, a, looks at the earlier, b, through four offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABOVE, BACK, BACK_ABOVE, BACK_BELOW = (0, -1), (-1, 0), (-1, -1), (-1, 1)
#: (slice, row) of the neighbour less that of the run.
OFFSETS = (ABOVE, BACK, BACK_ABOVE, BACK_BELOW)
#: Columns of a tile. Runs meet by tile, so a row of very many runs isn't joined with all of its neighbour row.
TILE = 256
#: Columns of a tile of the dense image, whose cells one task holds as an array.
CELLS = 4096


def _tiled(intervals: DataFrame) -> DataFrame:
    """A row for each tile that [x0, x1], both ends included, reaches."""
    tile = lambda x: F.floor(F.col(x) / TILE).cast("int")
    return intervals.withColumn("tile", F.explode(F.sequence(tile("x0"), tile("x1"))))


def asking(a: DataFrame, offsets: Sequence[tuple[int, int]], keep: list[str]) -> DataFrame:
    """Intervals of ``a`` under each (s, r, tile) that they look at; columns kept are named a_, ``o`` is the offset (dz, dy)."""
    steps = F.array(*(F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in offsets))
    each = a.select(*(F.col(c).alias(f"a_{c}") for c in dict.fromkeys(["x0", "x1", *keep])), "slice", "row", "x0", "x1", F.explode(steps).alias("o"))
    return _tiled(each.select("*", (F.col("slice") + F.col("o.dz")).alias("s"), (F.col("row") + F.col("o.dy")).alias("r"))).drop("slice", "row", "x0", "x1")


def asked(b: DataFrame, keep: list[str]) -> DataFrame:
    """Intervals of ``b`` under each (s, r, tile) that they lie in; columns kept are named b_."""
    return _tiled(b.select(*(F.col(c).alias(f"b_{c}") for c in dict.fromkeys(["x0", "x1", *keep])), "x0", "x1", F.col("slice").alias("s"), F.col("row").alias("r"))).drop("x0", "x1")


def banded(met: DataFrame) -> DataFrame:
    """Those of the pairs of ``asking`` and ``asked`` that touch, each in the one tile that holds the greater of the two starts."""
    band = (F.col("a_x1") >= F.col("b_x0")) & (F.col("b_x1") >= F.col("a_x0"))
    return met.where(band & (F.floor(F.greatest("a_x0", "b_x0") / TILE) == F.col("tile")))


def touching(a: DataFrame, b: DataFrame, offsets: Sequence[tuple[int, int]], keep_a: list[str], keep_b: list[str]) -> DataFrame:
    """Pairs of intervals (slice, row, x0, x1) that touch, b standing at one of the offsets from a.

    An equality join on (slice, row, tile). The columns kept are named a_ and b_; ``o`` is the offset (dz, dy).
    """
    return banded(asking(a, offsets, keep_a).join(asked(b, keep_b), ["s", "r", "tile"]))


def contacts(seg: DataFrame, offsets: Sequence[tuple[int, int]] = OFFSETS) -> DataFrame:
    """a, b: seg_ids of touching runs, b the earlier in raster order."""
    return touching(seg, seg, offsets, ["seg_id"], ["seg_id"]).select(F.col("a_seg_id").alias("a"), F.col("b_seg_id").alias("b"))


def contacts_by_position(seg: DataFrame, er: DataFrame) -> DataFrame:
    """The same contacts by equality joins only, through the relative labels of the neighbour row.

    ``er`` holds every cell of every row. The runs that a run touches are those numbered from that at column x0 - 1 (or the
    next, if that is background) to that at column x1 (or the one before). Labels meet runs by (slice, row, tile of CELLS
    columns): cells are gathered where the running count of their row left them, and a task holds those of a tile at most.
    """
    tile = lambda c: F.floor(F.col(c) / CELLS).cast("int")
    # a tile ends with the first cell of the next, so that the cell after a run's last one is in the last one's tile
    own = F.array(tile("col"))
    shared = F.when((F.col("col") % CELLS == 0) & (F.col("col") > 0), F.array(tile("col"), tile("col") - 1)).otherwise(own)
    cells = er.select("slice", "row", "col", "er", F.explode(shared).alias("tile"))
    rows = cells.groupBy("slice", "row", "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "er"))), lambda x: x["er"]).alias("ers"))
    steps = F.array(*(F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in OFFSETS))
    runs = seg.select("seg_id", (F.col("x0") - 1).alias("lo"), (F.col("x1") - 1).alias("hi"), "slice", "row", F.explode(steps).alias("o"))
    asking = runs.select("seg_id", "lo", "hi", (F.col("slice") + F.col("o.dz")).alias("slice"), (F.col("row") + F.col("o.dy")).alias("row"))
    asking = asking.withColumn("tile", F.explode(F.array_distinct(F.array(tile("hi"), F.greatest(tile("lo"), F.lit(0))))))
    even = lambda c: F.col(c) % 2 == 0
    at = lambda c: F.try_element_at("ers", F.col(c) - F.col("tile") * CELLS + 1)
    # column -1 has no edge before it; column width has all of the row's, and the end of a run that reaches it
    last = F.element_at("ers", -1)
    er0 = F.when(F.col("lo") < 0, F.lit(0).cast("long")).when(tile("lo") == F.col("tile"), at("lo"))
    er1 = F.when(tile("hi") == F.col("tile"), F.coalesce(F.try_element_at("ers", F.col("hi") - F.col("tile") * CELLS + 2), last + last % 2))
    seen = asking.join(rows, ["slice", "row", "tile"]).select("seg_id", "slice", "row", er0.alias("er0"), er1.alias("er1"))
    seen = seen.groupBy("seg_id", "slice", "row").agg(F.max("er0").alias("er0"), F.max("er1").alias("er1"))
    first = F.when(even("er0"), F.col("er0") + 1).otherwise(F.col("er0"))
    final = F.when(even("er1"), F.col("er1") - 1).otherwise(F.col("er1"))
    each = seen.withColumn("f", first).withColumn("t", final).where("f <= t").select("seg_id", "slice", "row", F.explode(F.expr("sequence(f, t, 2L)")).alias("er"))
    names = seg.select("slice", "row", (F.col("seg") * 2 + 1).cast("long").alias("er"), F.col("seg_id").alias("b"))
    return each.join(names, ["slice", "row", "er"]).select(F.col("seg_id").alias("a"), "b")


def first_labels(seg: DataFrame) -> DataFrame:
    """seg_id, label: the least seg_id touched in the row above; null where there is none."""
    least = contacts(seg, [ABOVE]).groupBy("a").agg(F.min("b").alias("label"))
    return seg.select("seg_id").join(least.withColumnRenamed("a", "seg_id"), "seg_id", "left")


def new_labels(seg: DataFrame, offsets: Sequence[tuple[int, int]] = OFFSETS) -> DataFrame:
    """seg_id of the runs that touch no earlier run through the offsets."""
    return seg.select("seg_id").join(contacts(seg, offsets).select(F.col("a").alias("seg_id")), "seg_id", "left_anti")


def contact_counts(seg: DataFrame) -> DataFrame:
    """slice, row, dz, dy, n: touching pairs of a row with each neighbour row that it touches."""
    met = touching(seg, seg, OFFSETS, ["slice", "row"], [])
    return met.groupBy(F.col("a_slice").alias("slice"), F.col("a_row").alias("row"), F.col("o.dz").alias("dz"), F.col("o.dy").alias("dy")).agg(F.count("*").alias("n"))


def _lined(placed: DataFrame) -> DataFrame:
    """``placed`` (slice, row, x0, x1) with ``line``: which of the intervals that touching ones of its row coalesce to, from 0."""
    row = Window.partitionBy("slice", "row").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0)
    island = F.sum("start").over(row.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("start", start).withColumn("line", (island - 1).cast("int")).drop("start")


def _placed(seg: DataFrame, keep: list[str]) -> DataFrame:
    """Runs at their own slice and at the next."""
    both = F.explode(F.array("slice", F.col("slice") + 1)).alias("slice")
    return seg.select(both, "row", "x0", "x1", *keep)


def double_lines(seg: DataFrame) -> DataFrame:
    """slice, row, line, x0, x1: each row's runs united with those of the same row one slice back; touching runs coalesce.

    ``line`` numbers the intervals of a row from 0. Rows stand at the later slice; a row of the slice before that has no
    row after it stands there too, as the rows of both slices are united.
    """
    # equal runs of both slices overlap, so whichever comes first, both are in one line
    return _lined(_placed(seg, [])).groupBy("slice", "row", "line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def double_links(seg: DataFrame) -> DataFrame:
    """a, b: links that give the same components as ``contacts``, by double lines.

    A run belongs to the double line that covers it at its own slice and at the next, as the window that finds lines tells; all
    runs of a line are linked to its least, and the least runs of touching lines of neighbouring rows to each other.
    """
    held = _lined(_placed(seg, ["seg_id"]))
    line = Window.partitionBy("slice", "row", "line")
    inside = held.withColumn("least", F.min("seg_id").over(line)).where("seg_id <> least").select(F.col("seg_id").alias("a"), F.col("least").alias("b"))
    named = held.groupBy("slice", "row", "line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("seg_id").alias("least"))
    across = touching(named, named, [ABOVE], ["least"], ["least"]).where("a_least <> b_least")
    return inside.unionByName(across.select(F.greatest("a_least", "b_least").alias("a"), F.least("a_least", "b_least").alias("b")))


def statistics(seg: DataFrame) -> DataFrame:
    """One row: runs, contacts, inherits (runs with a contact), unions (contacts beyond a run's first), new_labels."""
    by_run = contacts(seg).groupBy("a").agg(F.count("*").alias("n"))
    found = by_run.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("contacts"), F.count("*").alias("inherits"))
    every = seg.agg(F.count("*").alias("runs"))
    return every.crossJoin(F.broadcast(found)).select("runs", "contacts", "inherits", (F.col("contacts") - F.col("inherits")).alias("unions"), (F.col("runs") - F.col("inherits")).alias("new_labels"))
