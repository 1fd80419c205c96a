"""Running totals and positions over sorted values without a single-task window.

Values are range-partitioned, into as many ranges as their number asks for.  Totals per range are prefix-summed
(a row per range), and each range is then summed up on its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwright.session import cut_lineage

ROWS_PER_RANGE = 1_000_000


def running_totals(
    values: DataFrame, key: str, totals: Sequence[str], within: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """`values` has one row per distinct `key` (per value of the `within` columns); adds ``before_<t>`` for
    every total: the sum of `t` over all smaller keys (of the same `within`).

    Rows are counted, cut into ranges of about `rows_per_range` by their order, and stored with the number of
    their range.  Keys being distinct, no range outgrows the others, however often a value occurs.
    """
    values = cut_lineage(values)
    ranges = max(1, math.ceil(values.count() / rows_per_range))
    if ranges == 1:
        cut_up = values.withColumn("__range", F.lit(0))
    else:
        dealt = values.repartitionByRange(ranges, *within, key)
        cut_up = cut_lineage(dealt.withColumn("__range", F.spark_partition_id()))
    earlier = W.partitionBy(*within).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    # A row per range, and one more for each value of `within`.
    offsets = (
        cut_up.groupBy(*within, "__range")
        .agg(*[F.sum(t).alias(f"__sum_{t}") for t in totals])
        .select(*within, "__range", *[F.coalesce(F.sum(f"__sum_{t}").over(earlier), F.lit(0)).alias(f"__offset_{t}") for t in totals])
    )
    inside = W.partitionBy(*within, "__range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    summed = cut_up.select("*", *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"__inside_{t}") for t in totals])
    if ranges > 1:
        summed = summed.join(offsets, [*within, "__range"])
    else:  # nothing lies in earlier ranges
        summed = summed.select("*", *[F.lit(0).alias(f"__offset_{t}") for t in totals])
    return summed.select(*values.columns, *[(F.col(f"__offset_{t}") + F.col(f"__inside_{t}")).alias(f"before_{t}") for t in totals])


def numbered(values: DataFrame, key: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Distinct values of `key` with their position in order, from 0, as ``number``."""
    each = values.select(key).distinct().withColumn("__one", F.lit(1).cast("bigint"))
    placed = running_totals(each, key, ["__one"], rows_per_range=rows_per_range)
    return placed.select(key, F.col("before___one").alias("number"))
