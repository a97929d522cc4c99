"""What each stage from cells to features takes in and gives out, how long it takes and what it shuffles."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runfield.operators import components, features, relabel, rle, unify
from runfield.sources.shared import written


@dataclass
class Stage:
    """One stage: its seconds, the bytes that its shuffles wrote, and counts of what it met."""

    name: str
    seconds: float = 0.0
    shuffle_bytes: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    rounds: list[tuple[int, int]] | None = None

    def rate(self, count: str) -> float:
        return round(self.counts[count] / self.seconds, 1) if self.seconds else 0.0

    def as_dict(self) -> dict:
        found = {"seconds": round(self.seconds, 3), "shuffle_bytes": self.shuffle_bytes, **self.counts, **{f"{c}_per_s": self.rate(c) for c in self.counts}}
        return found | ({"rounds": len(self.rounds)} if self.rounds is not None else {})


class Sampler:
    """Measurements by name, in the order in which they were made; a name that is used again is measured again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stages = spark, {}

    def _shuffled(self) -> int:
        """Bytes that the shuffles of all stages so far wrote, by the application's own status store."""
        sc = self.spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    @contextmanager
    def stage(self, name: str) -> Iterator[Stage]:
        found = self.stages[name] = Stage(name)
        before, start = self._shuffled(), time.perf_counter()
        yield found
        found.seconds = time.perf_counter() - start
        found.shuffle_bytes = self._shuffled() - before

    def kept(self, stage: Stage, df: DataFrame, **counts: Column) -> DataFrame:
        """``df``, written, with the counts of its rows observed as they went by."""
        seen = Observation()
        out = written(df.observe(seen, *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items())), stage.name)
        stage.counts |= {n: int(v or 0) for n, v in seen.get.items()}
        return out


def measured(voxels: DataFrame) -> dict[str, Stage]:
    """The stages encode, contacts, components, labels, relabel and features of a grid, each written before the next begins."""
    sampler = Sampler(voxels.sparkSession)
    rows = F.count(F.lit(1))
    with sampler.stage("encode") as s:
        seg = sampler.kept(s, rle.segments(voxels), runs=rows, cells=F.sum(F.col("x1") - F.col("x0")))
    with sampler.stage("contacts") as s:
        links = sampler.kept(s, unify.contacts(seg), contacts=rows)
        s.counts["runs"] = sampler.stages["encode"].counts["runs"]
    with sampler.stage("components") as s:
        s.rounds = []
        rooted = sampler.kept(s, components.roots(seg.select("seg_id"), links, rounds=s.rounds), runs=rows, components=F.sum((F.col("seg_id") == F.col("root")).cast("long")))
    with sampler.stage("labels") as s:
        labelled = sampler.kept(s, components.labelled(seg, rooted), runs=rows)
    with sampler.stage("relabel") as s:
        sampler.kept(s, relabel.label_cells(labelled), cells=rows)
    with sampler.stage("features") as s:
        sampler.kept(s, features.of_runs(labelled), components=rows)
        s.counts["runs"] = sampler.stages["encode"].counts["runs"]
    return sampler.stages
