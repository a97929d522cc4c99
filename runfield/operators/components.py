"""Connected components of runs.

Edges whose ends lie in one block of seg_ids (raster order, so mostly near each other) are resolved by union-find inside
one task, of bounded size. What is left is a graph of block roots, joined by edges between blocks; it is contracted in
rounds, as described at ``connected``, until it is small enough for one such task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfield.operators.rle import numbered
from runfield.operators.unify import OFFSETS, touching
from runfield.sources.shared import removed, written

#: Runs of a block.
BLOCK = 1 << 16
#: Edges, of 16 bytes each, that one task resolves at once when a graph has been contracted to them.
FINISH = 1 << 15


def _least(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """For each vertex of these edges, the least vertex that it is connected to."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(names)))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i < j:
            parent[j] = i
        else:
            parent[i] = j
    roots = np.array(parent, np.int64)
    while not np.array_equal(up := roots[roots], roots):
        roots = up
    return pd.DataFrame({"v": names, "root": names[roots]})


def block_roots(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """v, root inside its block, for every vertex of an edge (a, b) with both ends in one block."""
    inner = edges.where(F.floor(F.col("a") / block) == F.floor(F.col("b") / block)).withColumn("block", F.floor(F.col("a") / block))
    return inner.groupBy("block").applyInPandas(lambda rows: _least(rows["a"].to_numpy(), rows["b"].to_numpy()), "v long, root long")


def connected(edges: DataFrame, finish: int = FINISH, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """v, root: for every vertex of an edge (a, b), a <> b, the least vertex that it is connected to.

    In a round, each vertex picks, of itself and its neighbours, the one with the least hash; hashes are other ones in every
    round. Vertices with one pick become one vertex, under the pick's name, and edges are drawn anew between those. A vertex
    and its pick are in one component, and an edge survives unless both ends have one pick, so components stay what they
    are. On average at most three quarters of the vertices are left (half of a chain, in whatever order it is numbered), so
    rounds grow with the logarithm of the number of vertices, not with the length of components, and each costs a fraction
    of the one before it. The least vertex of what each vertex stands for is carried along. A graph of ``finish`` edges or
    fewer is resolved in one task. Then picks are followed back, level by level.

    Edges and picks are written tables before they are joined, so a vertex of very many edges, or a pick of very many
    vertices, is split by a skew join. ``rounds``, if given, gets (edges, edges left) of each round.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left, least, levels = written(ordered(edges), "edges"), None, []
    while (n := left.count()) > finish:
        salt = F.lit(len(levels))
        hashed = lambda c: F.struct(F.xxhash64(salt, F.col(c)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        ends = left.select(F.explode(F.expr("array(struct(a AS v, b AS o), struct(b AS v, a AS o))")).alias("e")).select("e.v", "e.o")
        picks = ends.groupBy("v").agg(F.min(hashed("o")).alias("p")).select("v", F.least("p", hashed("v"))["x"].alias("r"))
        picks = picks.withColumn("m", F.col("v")) if least is None else picks.join(least, "v")
        levels.append(picks := written(picks, "picks"))
        least = picks.groupBy(F.col("r").alias("v")).agg(F.min("m").alias("m"))
        pick = lambda c: picks.select(F.col("v").alias(c), F.col("r").alias(f"{c}r"))  # noqa: E731, B023
        drawn = written(ordered(left.join(pick("a"), "a").join(pick("b"), "b").select(F.col("ar").alias("a"), F.col("br").alias("b"))), "edges")
        removed(left)
        left = drawn
        if rounds is not None:
            rounds.append((n, left.count()))
    found = left.coalesce(1).mapInPandas(_resolved, "v long, root long")
    if least is None:
        return found
    # names of the last level are picks; the least vertex behind each component of them is its root
    found = written(least.join(found, "v", "left").select("v", F.coalesce("root", "v").alias("g"), "m"), "resolved")
    top = found.join(found.groupBy("g").agg(F.min("m").alias("root")), "g").select("v", "root")
    for k, picks in reversed(list(enumerate(levels))):
        top = picks.join(top.withColumnRenamed("v", "r"), "r").select("v", "root")
        if k:
            # components that were done before the next level have no vertex there
            done = levels[k - 1].groupBy(F.col("r").alias("v")).agg(F.min("m").alias("m"))
            top = written(done.join(top, "v", "left").select("v", F.coalesce("root", "m").alias("root")), "named")
    return top


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [(rows["a"].to_numpy(), rows["b"].to_numpy()) for rows in batches]
    if parts:
        yield _least(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def roots(vertices: DataFrame, edges: DataFrame, block: int = BLOCK, finish: int = FINISH, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """``vertices`` (seg_id and any others but root) with ``root``, the least seg_id of its component; edges (a, b) join seg_ids. ``finish``, ``rounds``: see ``connected``."""
    edges = written(edges.select("a", "b"), "contacts")
    local = written(block_roots(edges, block), "block-roots")
    # An edge inside a block is done with; ends of the others go to their block's roots.
    # They are few, and written, so that they are broadcast to the roots, which are not shuffled for them.
    outer = written(edges.where(F.floor(F.col("a") / block) != F.floor(F.col("b") / block)), "outer-edges")
    ends = local.join(outer.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v")
    up = lambda df, c: df.join(ends.select(F.col("v").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    between = written(up(up(outer, "a"), "b").where("a <> b").distinct(), "block-edges")
    found = vertices.join(local.select(F.col("v").alias("seg_id"), "root"), "seg_id", "left").withColumn("root", F.coalesce("root", "seg_id"))
    if between.isEmpty():
        return found
    # written, so that few names of block roots are broadcast and vertices need no further shuffle
    top = written(connected(between, finish, rounds), "block-names")
    return found.join(top.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def labelled(seg: DataFrame, rooted: DataFrame) -> DataFrame:
    """``seg`` with ``root`` and ``label``: components numbered from 1 in raster order of their first runs."""
    seg = written(seg.join(rooted.select("seg_id", "root"), "seg_id"), "rooted")
    first = seg.where("seg_id = root").select("slice", "row", "x0", "root")
    names = numbered(first, ["slice", "row"], ["x0"], F.floor(F.col("row") / 1024), "label").select("root", "label")
    return seg.join(names, "root").select("slice", "row", "seg", "x0", "x1", "seg_id", "root", "label")


def slab_labels(seg: DataFrame, slices: int) -> tuple[DataFrame, DataFrame]:
    """(rooted, boundary): roots over contacts inside slabs of ``slices`` slices; contacts (a, b) between slabs."""
    slab = lambda c: F.floor(F.col(c) / slices)
    met = touching(seg, seg, OFFSETS, ["seg_id", "slice"], ["seg_id", "slice"])
    named = written(met.select(F.col("a_seg_id").alias("a"), F.col("b_seg_id").alias("b"), (slab("a_slice") == slab("b_slice")).alias("inside")), "contacts")
    return roots(seg.select("seg_id"), named.where("inside").select("a", "b")), named.where("not inside").select("a", "b")


def reduced(rooted: DataFrame, boundary: DataFrame) -> DataFrame:
    """seg_id, slab_root, root: slab roots joined over the boundary contacts."""
    rooted = written(rooted.select("seg_id", "root"), "slab-roots")
    end = lambda c: rooted.select(F.col("seg_id").alias(c), F.col("root").alias(f"{c}r"))
    links = boundary.join(end("a"), "a").join(end("b"), "b").select(F.col("ar").alias("a"), F.col("br").alias("b")).distinct()
    vertices = rooted.select(F.col("root").alias("seg_id")).distinct()
    top = roots(vertices, links).select(F.col("seg_id").alias("slab_root"), "root")
    return rooted.withColumnRenamed("root", "slab_root").join(top, "slab_root")
