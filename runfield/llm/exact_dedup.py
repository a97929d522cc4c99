"""Exact duplicates with a heavy-hitter split: frequent texts are settled on the map side, all others by ordinary shuffles.

Texts are equal when they are identical after each run of white space (space, tab, LF, VT, FF, CR) became one space. They
are known by the SHA-256 of that text.

1. One pass over the texts writes (doc_id, row, digest), 48 bytes a row; nothing later reads a text.
2. Misra-Gries: every partition keeps at most ``counters`` digests with counts too low by n / (counters + 1) of its n rows
   at most, and gives out those that are left with more than that. Counts are added up over partitions: a digest found in
   3 n / (counters + 1) of all n rows, and in ``least`` rows or more, is sure to be among the candidates; there are at most
   ``counters`` + 1 of them, as their counts add up to n or less.
3. Candidates are verified: exact counts and the row that stays, by partial aggregation. These winners, at most
   ``counters`` + 1 rows of some 60 bytes, are broadcast, and rows with a frequent digest never meet in a task.
4. Rows of all other digests are shuffled and joined with their group's count and winner in the usual way.

Of equal texts the row of least doc_id stays.

Defined cases: a null text is empty, and all empty texts are equal; a text of white space alone is one space. Rows with a
null doc_id come after all others, and keep_id is null where a group has only such rows. Of rows with one doc_id and equal
text (repeated rows), one stays and the others are dropped; rows of one doc_id with different texts are judged each for
itself. An empty table gives no rows. ``deduplicated`` carries other columns, whatever their names; ``groups`` does not
read them. Long texts are handled by the JVM as any string is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfield.llm.common import id_and_text, tidied
from runfield.sources.shared import written

#: Digests that a partition counts at a time.
COUNTERS = 4096
#: Rarer digests are left to the ordinary shuffle, which they cannot skew.
LEAST = 200
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a number that no other row has), digest (32 bytes), written."""
    hashed = id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"))
    return written(hashed.withColumn("row", F.monotonically_increasing_id()), "digests")


def _lowered(counts: pa.Table, counters: int) -> pa.Table:
    """At most ``counters`` of the counts, each lower by the greatest count that has to go."""
    if counts.num_rows <= counters:
        return counts
    n = counts["n"].to_numpy()
    off = np.partition(n, len(n) - counters - 1)[len(n) - counters - 1]
    counts = counts.filter(pa.array(n > off))
    return counts.set_column(1, "n", pa.array(n[n > off] - off))


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("digest").aggregate([("n", "sum")]).rename_columns(["digest", "n"])


def summaries(table: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, n: what each partition's counters hold at its end, without what is within their error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        rows = 0
        for batch in tidied(batches):
            rows += batch.num_rows
            found = pc.value_counts(batch.column(0))
            held = _lowered(_summed([held, pa.table({"digest": found.field("values"), "n": found.field("counts")})]), counters)
        held = held.filter(pc.greater(held["n"], rows // (counters + 1)))
        yield from held.combine_chunks().to_batches()

    return table.select("digest").mapInArrow(work, "digest binary, n long")


def candidates(table: DataFrame, counters: int = COUNTERS, least: int = LEAST) -> DataFrame:
    """digest: at most ``counters`` + 1 of them, among them each that 3 in ``counters`` rows (and ``least`` or more) have."""
    bar = max(least / 3, table.count() / (counters + 1))
    return summaries(table, counters).groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= bar).select("digest")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")


def _settled(rows: DataFrame, winners: DataFrame) -> DataFrame:
    joined = rows.join(winners, "digest")
    return joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min(_order()).alias("first"), F.count("*").alias("group_size"))


def groups(docs: DataFrame, counters: int = COUNTERS, least: int = LEAST, **columns: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``."""
    table = digests(docs, **columns)
    frequent = F.broadcast(written(candidates(table, counters, least), "frequent"))
    heavy = F.broadcast(written(_winners(table.join(frequent, "digest", "left_semi")), "winners"))
    rest = table.join(heavy.select("digest"), "digest", "left_anti")
    return _settled(table, heavy).unionByName(_settled(rest, _winners(rest)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns."""
    found = written(groups(docs, id_col=id_col, text_col=text_col, **options), "exact-groups")
    free = lambda c: free(f"_{c}") if c in docs.columns else c
    number, digest = free("_number"), free("_digest")
    named = docs.withColumn(number, F.col(id_col).cast("long")).withColumn(digest, F.sha2(normalised(text_col), 256))
    pairs = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("any"), F.count("*").alias("times"))
    gone = written(pairs.where("not any").select(F.col("doc_id").alias(f"{number}g"), F.col("text_sha256").alias(f"{digest}g")), "gone")
    left = named.join(gone, F.col(number).eqNullSafe(F.col(f"{number}g")) & (F.col(digest) == F.col(f"{digest}g")), "left_anti")
    if not pairs.where("any and times > 1").isEmpty():
        left = left.dropDuplicates([number, digest])
    return left.drop(number, digest)
