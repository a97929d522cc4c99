"""Runs kept in buckets by the row that they are looked for in, so that finding contacts shuffles nothing.

Two tables hold the runs: once as they lie, once for each of the neighbour rows that they look at. Both are bucketed and
sorted by (slice, row, tile) of the row looked at, with as many buckets, so a join of the two reads bucket by bucket. It is
paid for once, when runs are stored; joins with other offsets and statistics over contacts then need no exchange either.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfield.operators.unify import OFFSETS, asked, asking, banded
from runfield.sources.shared import new_path

KEYS = ["s", "r", "tile"]
BUCKETS = 64


class StoredRuns:
    """Runs (slice, row, x0, x1, seg_id) as the tables ``<name>_asking`` and ``<name>_asked`` below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def store(cls, seg: DataFrame, buckets: int = BUCKETS, name: str | None = None) -> StoredRuns:
        spark = seg.sparkSession
        name = name or f"runs_{uuid.uuid4().hex}"
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a name for a table: {name}")
        for kind, rows in (("asking", asking(seg, OFFSETS, ["seg_id"])), ("asked", asked(seg, ["seg_id"]))):
            rows = rows.repartition(buckets, *KEYS)
            rows.write.bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", new_path(spark, kind)).saveAsTable(f"{name}_{kind}")
        return cls(spark, name)

    def contacts(self, offsets: tuple[tuple[int, int], ...] = OFFSETS) -> DataFrame:
        """a, b: seg_ids of touching runs, as ``unify.contacts`` gives them."""
        a, b = (self.spark.table(f"{self.name}_{kind}") for kind in ("asking", "asked"))
        if tuple(offsets) != OFFSETS:
            wanted = [(F.col("o.dz") == dz) & (F.col("o.dy") == dy) for dz, dy in offsets]
            at = wanted[0]
            for w in wanted[1:]:
                at = at | w
            a = a.where(at)
        return banded(a.hint("merge").join(b, KEYS)).select(F.col("a_seg_id").alias("a"), F.col("b_seg_id").alias("b"))

    def drop(self) -> None:
        """Forgets the tables; files stay below the shared folder, as those of other intermediate tables do."""
        for kind in ("asking", "asked"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")
