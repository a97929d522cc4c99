"""Scalar helpers as column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def isqrt_below(n: Column) -> Column:
    """The greatest integer whose square is less than n; 0 for n = 0. Exact for all longs: the double root is put right."""
    m = F.greatest(n.cast("long") - 1, F.lit(0).cast("long"))
    near = F.floor(F.sqrt(m.cast("double"))).cast("long")
    # r * r > m, without the product: the quotient is a whole number, at most 2^32, that the division may miss by a fraction
    over = lambda r: (r > 0) & (r > F.round((m - m % F.greatest(r, F.lit(1))) / F.greatest(r, F.lit(1))))
    return F.when(over(near), near - 1).when(~over(near + 1), near + 1).otherwise(near)


def dot(a: Column, b: Column, *more: Column) -> Column:
    """Sum of the products of the arrays, item by item."""
    product = F.zip_with(a, b, lambda x, y: x * y)
    for c in more:
        product = F.zip_with(product, c, lambda x, y: x * y)
    return F.aggregate(product, F.lit(0).cast("long"), lambda s, x: s + x)


def least_positive(*values: Column) -> Column:
    """The least of the non-zero values; 0 if all are."""
    return F.coalesce(F.least(*(F.nullif(v, F.lit(0)) for v in values)), F.lit(0))


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def round_up(n: Column, step: Column) -> Column:
    """The least multiple of ``step`` that is at least n; both positive."""
    least = (n + step - 1).cast("long")
    return least - least % step


def closest(df: DataFrame, value: str, distance: Column, order: str, by: list[str] | None = None) -> DataFrame:
    """For each group, the ``value`` of least distance; the first in ``order`` of a tie. No rows: no groups (null without groups)."""
    return df.groupBy(*(by or [])).agg(F.min_by(value, F.struct(distance, F.col(order))).alias(value))
