"""A volume that grows by slabs of slices: each new slab is labelled alone and joined to what is there over one boundary.

Kept in a folder, partitioned by slab:

    runs    slice, row, x0, x1, comp,     comp: the slab's component, its least run's number with the slab before it
            first                         whether it is that run
    faces   row, x0, x1, slice, comp      the runs of the slab's last slice, all that the next slab looks at
    parts   comp, first run, features     partial features of the slab's components
    names   comp, root                    the component of the whole volume: the least comp that it holds

A slab reads its own cells, the face and the names of the slab before it, and, where it joins two components of the volume,
the names of the slabs that the later of them reaches, which are the only ones written anew (by dynamic overwrite of their
partitions). So what is read and written for a slab does not grow with the volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfield.operators import components, features, rle, unify
from runfield.sources.shared import removed, written

#: Runs of a slab take this many bits of a comp.
RUN_BITS = 40
_FEATURES = ", ".join(f"{c} long" for c in features.SUMS) + ", " + ", ".join(f"{c} int" for c in features.LOWS + features.HIGHS + features.FIRST)
_SCHEMAS = {
    "runs": "slice int, row int, x0 int, x1 int, comp long, first boolean, slab int", "faces": "slice int, row int, x0 int, x1 int, comp long, slab int",
    "parts": f"comp long, {_FEATURES}, slab int", "names": "comp long, root long, slab int",
}


class GrowingVolume:
    """Slabs of ``slices`` slices in the folder ``path``, which one writer at a time adds to in ascending order.

    A slab is added again, with the same result, if a writer was lost before it was done: its names are written last.
    """

    def __init__(self, spark: SparkSession, path: str, slices: int):
        self.spark, self.path, self.slices = spark, path.rstrip("/"), slices

    def _slabs(self, name: str) -> list[int]:
        """The slabs that a table has, from the names of its folders."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n.removeprefix("slab=")) for n in names if n.startswith("slab="))

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slab").parquet(f"{self.path}/{name}")

    def read(self, name: str, low: int = 0, high: int | None = None) -> DataFrame:
        """A table's slabs from ``low`` to ``high``, both included; files of others are not even listed."""
        slabs = [s for s in self._slabs(name) if low <= s and (high is None or s <= high)]
        if not slabs:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/slab={s}" for s in slabs))

    def last_slab(self) -> int | None:
        """The last slab that was added; slabs without cells leave nothing."""
        return max(self._slabs("names"), default=None)

    def add(self, slab: int, voxels: DataFrame) -> None:
        """Adds the cells of one slab; cells of other slabs are refused."""
        last = self.last_slab()
        if last is not None and slab < last:
            raise ValueError(f"slab {slab} comes after slab {last} was added")
        low, at = slab * self.slices, F.lit(slab).alias("slab")
        found = written(rle.runs(voxels), "slab-found")
        # of the written runs, whose files tell the least and the greatest slice
        if not found.where(~F.col("slice").between(low, low + self.slices - 1)).isEmpty():
            removed(found)
            raise ValueError(f"cells outside of slab {slab}")
        if found.isEmpty():
            removed(found)
            return
        seg = written(rle.numbered(found, ["slice", "row"], ["x0"], F.floor(F.col("row") / rle.ROWS), "seg_id"), "slab-runs")
        removed(found)
        comp = (F.lit(low_comp(slab)) + F.col("root")).alias("comp")
        rooted = components.roots(seg, unify.contacts(seg))
        self._put(rooted.select("slice", "row", "x0", "x1", comp, (F.col("seg_id") == F.col("root")).alias("first"), at), "runs")
        removed(seg)
        runs = self.read("runs", slab, slab)
        self._put(runs.where(F.col("slice") == low + self.slices - 1).select("slice", "row", "x0", "x1", "comp", at), "faces")
        self._put(features.parts_of_runs(runs).select("*", at), "parts")
        comps = self.read("parts", slab, slab).select("comp")
        face = self.read("faces", slab - 1, slab - 1)
        before = self.read("names", slab - 1, slab - 1).select("comp", "root")
        met = unify.touching(runs.where(F.col("slice") == low), face, unify.OFFSETS, ["comp"], ["comp"])
        links = met.select(F.col("a_comp").alias("new"), F.col("b_comp").alias("comp")).distinct().join(before, "comp")
        joined = written(components.connected(links.select(F.col("new").alias("a"), F.col("root").alias("b"))), "joined")
        self._rename(slab, joined.where(F.col("v") < low_comp(slab)).where("v <> root").select(F.col("v").alias("old"), F.col("root").alias("now")))
        named = comps.join(joined.select(F.col("v").alias("comp"), "root"), "comp", "left")
        self._put(named.select("comp", F.coalesce("root", "comp").alias("root"), at), "names")

    def _rename(self, slab: int, changed: DataFrame) -> None:
        """Names of earlier slabs under their new roots; ``changed``: old, now."""
        least = changed.agg(F.min("old")).first()[0]
        if least is None:
            return
        # a component reaches from the slab of its root to the one before this, without a gap
        held = self.read("names", least >> RUN_BITS, slab - 1)
        touched = [r[0] for r in held.join(changed, held["root"] == changed["old"], "left_semi").select("slab").distinct().collect()]
        whole = held.where(F.col("slab").isin(touched)).join(changed, held["root"] == changed["old"], "left")
        anew = written(whole.select("comp", F.coalesce("now", "root").alias("root"), "slab"), "renamed")
        self._put(anew, "names")
        removed(anew)

    def labelled_runs(self) -> DataFrame:
        """slice, row, x0, x1, root of all runs."""
        return self.read("runs").drop("slab").join(self.read("names").select("comp", "root"), "comp").select("slice", "row", "x0", "x1", "root")

    def features(self) -> DataFrame:
        """Features by label, from the slabs' partial ones."""
        return features.of_parts(self.read("parts").drop("slab"), self.read("names"))


def low_comp(slab: int) -> int:
    """The least number that a comp of the slab could have."""
    return slab << RUN_BITS
