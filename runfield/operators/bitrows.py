"""Grid rows as words of 64 columns: a BIGINT for each word that has foreground, its lowest bit the first column.

A row of the table holds what 64 rows of cells would; edges come from a shift and an exclusive or with a carry from the
word before, volumes from ``bit_count``. Only words next to each other meet, through a window over a row's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64


def packed(voxels: DataFrame) -> DataFrame:
    """slice, row, word, bits of the words with a foreground cell; equal cells count once."""
    word, bit = F.expr(f"cast(floor(col / {BITS}) as int)"), F.expr(f"shiftleft(1L, cast(pmod(col, {BITS}) as int))")
    return voxels.groupBy("slice", "row", word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def unpacked(words: DataFrame) -> DataFrame:
    """slice, row, col of the foreground."""
    each = words.select("slice", "row", "word", F.explode(_set_bits("bits")).alias("bit"))
    return each.select("slice", "row", (F.col("word") * BITS + F.col("bit")).cast("int").alias("col"))


def _set_bits(bits: str) -> Column:
    """The numbers of the bits that are set, ascending."""
    return F.expr(f"filter(sequence(0, {BITS - 1}), i -> (shiftrightunsigned({bits}, i) & 1L) = 1L)")


def _in_row():
    return Window.partitionBy("slice", "row").orderBy("word")


def edges(words: DataFrame) -> DataFrame:
    """slice, row, word, starts, stops: bits of the first cells of runs, and of the first background cells after runs.

    A run that fills a word to its end, with no word after it, stops in a word that has no foreground; that word is given
    too, with starts 0.
    """
    row = _in_row()
    top = "cast(shiftrightunsigned(bits, 63) as bigint)"
    before = F.when(F.lag("word").over(row) == F.col("word") - 1, F.lag(F.expr(top)).over(row)).otherwise(0)
    open_end = (F.expr(top) == 1) & ~F.lead("word").over(row).eqNullSafe(F.col("word") + 1)
    seen = words.select("slice", "row", "word", "bits", before.alias("carry"), open_end.alias("open"))
    shifted = "(shiftleft(bits, 1) | carry)"
    found = seen.select("slice", "row", "word", F.expr(f"bits & ~{shifted}").alias("starts"), F.expr(f"{shifted} & ~bits").alias("stops"), "open")
    none = F.lit(0).cast("long")
    after = F.struct((F.col("word") + 1).alias("word"), none.alias("starts"), F.lit(1).cast("long").alias("stops"))
    own = F.struct("word", "starts", "stops")
    return found.select("slice", "row", F.explode(F.when(F.col("open"), F.array(own, after)).otherwise(F.array(own))).alias("e")).select("slice", "row", "e.*")


def runs(words: DataFrame) -> DataFrame:
    """slice, row, x0, x1: the runs of ``rle.runs``, without a row for each cell.

    The k-th start of a row belongs to its k-th stop; both are numbered by running counts of bits over words.
    """
    row = _in_row().rowsBetween(Window.unboundedPreceding, -1)
    counted = lambda c: F.coalesce(F.sum(F.bit_count(c)).over(row), F.lit(0))
    marked = edges(words).withColumns({"first_start": counted("starts"), "first_stop": counted("stops")})
    at = lambda bits, first, name: marked.select("slice", "row", "word", F.col(first).alias("n"), F.posexplode(_set_bits(bits)).alias("k", "bit")).select("slice", "row", (F.col("n") + F.col("k")).alias("k"), (F.col("word") * BITS + F.col("bit")).cast("int").alias(name))
    both = at("starts", "first_start", "x0").unionByName(at("stops", "first_stop", "x1"), allowMissingColumns=True)
    return both.groupBy("slice", "row", "k").agg(F.max("x0").alias("x0"), F.max("x1").alias("x1")).drop("k")


def volumes(words: DataFrame) -> DataFrame:
    """slice, row, n: foreground cells by row."""
    return words.groupBy("slice", "row").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Words of the union ("or"), the intersection ("and") or the difference ("xor") of two grids."""
    join = "inner" if how == "and" else "full"
    met = a.select("slice", "row", "word", F.col("bits").alias("p")).join(b.select("slice", "row", "word", F.col("bits").alias("q")), ["slice", "row", "word"], join)
    sign = {"or": "|", "and": "&", "xor": "^"}[how]
    return met.select("slice", "row", "word", F.expr(f"coalesce(p, 0L) {sign} coalesce(q, 0L)").alias("bits")).where("bits <> 0")
