"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR_COUNT = "decimal(38,0)"


def pair_count(left_rows: Column, right_rows: Column) -> Column:
    """Product of two row counts; billions of rows on both sides overflow a bigint."""
    return (left_rows.cast("decimal(19,0)") * right_rows.cast("decimal(19,0)")).cast(PAIR_COUNT)


def hash60(value: Column) -> Column:
    """First 60 bits of md5 as a bigint; any engine with md5 can reproduce it."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def log_loss_term(label: Column, probability: Column, eps: float | None = None) -> Column:
    """-(y ln p + (1-y) ln(1-p)) for one row.

    Without `eps` the ends behave like floating-point arithmetic with missing values skipped: a
    certain and right prediction gives 0 * log(0), which is undefined and drops out of a mean
    (NULL here), while a certain and wrong one costs infinity.
    """
    if eps is not None:
        clipped = F.least(F.greatest(probability, F.lit(eps)), F.lit(1 - eps))
        return -(label * F.ln(clipped) + (1 - label) * F.ln(1 - clipped))
    certain = (probability == 0) | (probability == 1)
    return F.when(
        certain,
        F.when(label != probability, F.lit(float("inf"))),
    ).otherwise(-(label * F.ln(probability) + (1 - label) * F.ln(1 - probability)))


def bin_of(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [edge_i, edge_i+1) holding value, clipped into range.

    Compared edge by edge: multiplying and flooring misplaces values such as 0.3.
    """
    last = len(edges) - 2
    expression = F.lit(0)
    for index in range(1, last + 1):
        expression = F.when(value >= F.lit(edges[index]), F.lit(index)).otherwise(expression)
    return F.when(value.isNotNull(), expression)


def even_edges(bins: int) -> list[float]:
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]
