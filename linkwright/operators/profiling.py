"""Completeness, value distributions and summaries of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwright.operators.ordering import ROWS_PER_RANGE, running_totals

MAX_PIVOT = 10_000


def completeness(tables: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Share of present values per column and table, in one pass over each table."""
    parts = []
    for name, table in tables.items():
        shares = table.agg(*[F.try_divide(F.count(c), F.count("*")).alias(c) for c in columns])
        parts.append(shares.select(F.lit(name).alias("table_name"), "*").unpivot("table_name", list(columns), "column_name", "share"))
    return reduce(DataFrame.unionByName, parts)


def non_null_counts(table: DataFrame) -> DataFrame:
    counts = table.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in table.columns])
    kinds = F.create_map(*[F.lit(x) for pair in table.dtypes for x in pair])
    long = counts.select(F.lit(0).alias("__one"), "*").unpivot("__one", table.columns, "column_name", "non_null_count")
    return long.select("column_name", "non_null_count", kinds[F.col("column_name")].alias("dtype"))


def value_counts(table: DataFrame, column: str, drop_nulls: bool = True, n: int | None = None) -> DataFrame:
    """(value, count); with `n` only the n most frequent."""
    values = table.filter(F.col(column).isNotNull()) if drop_nulls else table
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return counts if n is None else counts.orderBy(F.desc("count"), "value").limit(n)


def _long(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value as text), one row per cell."""
    as_text = table.select(F.lit(0).alias("__one"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return as_text.unpivot("__one", list(columns), "column_name", "value").drop("__one")


def value_counts_all_columns(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cells = _long(table, columns or table.columns)
    return cells.groupBy("column_name", "value").agg(F.count("*").alias("count"))


def filtered_value_counts(table: DataFrame, condition: str | Column, column: str) -> DataFrame:
    return value_counts(table.filter(condition), column)


def value_shares(table: DataFrame, column: str) -> DataFrame:
    """Count and share of the non-null values."""
    present = table.filter(F.col(column).isNotNull())
    total = present.agg(F.count("*")).scalar()
    return value_counts(present, column).withColumn("share", F.col("count") / total)


def profile_columns(table: DataFrame, columns: Sequence[str], top_n: int = 10, bottom_n: int = 5) -> DataFrame:
    """Most and least frequent values per column.

    Each end is ranked on its own so that Spark cuts the column to `n` rows per map task first; a
    column with as many values as rows never meets in one task.
    """
    counts = value_counts_all_columns(table, columns).filter(F.col("value").isNotNull())

    def end(name: str, n: int, order: Sequence[Column]) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("column_name").orderBy(*order))
        ranked = counts.withColumn("position", rank).filter(F.col("position") <= n)
        return ranked.select("column_name", F.lit(name).alias("end"), "position", "value", "count")

    top = end("top", top_n, [F.desc("count"), F.asc("value")])
    return top.unionByName(end("bottom", bottom_n, [F.asc("count"), F.asc("value")]))


def distribution_percentiles(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column and frequency: values that occur that often and the share of rows held by values
    at least that frequent.  Distinct frequencies of a column number at most sqrt(2 * rows), which
    bounds the window."""
    counts = value_counts_all_columns(table, columns).filter(F.col("value").isNotNull())
    steps = counts.groupBy("column_name", F.col("count").alias("frequency")).agg(F.count("*").alias("values"))
    rows = F.col("frequency") * F.col("values")
    down = W.partitionBy("column_name").orderBy(F.desc("frequency")).rowsBetween(W.unboundedPreceding, 0)
    share = F.sum(rows).over(down) / F.sum(rows).over(W.partitionBy("column_name"))
    return steps.select("column_name", "frequency", "values", share.alias("cumulative_share"))


QUARTILES = (0.25, 0.5, 0.75)


def describe_numeric(table: DataFrame, columns: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum; one row per column.

    Quartiles are exact with linear interpolation.  All columns go through one chain of jobs: counts per
    distinct value, running totals over value ranges, and two aggregates, so no task holds a whole column and
    the table is read once.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    values = table.select(F.inline(cells)).filter(F.col("v").isNotNull())
    counts = values.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    ranked = running_totals(counts, "v", ["n"], ["column_name"], rows_per_range)
    basics = ranked.groupBy("column_name").agg(
        F.sum("n").alias("rows"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    known = ranked.join(F.broadcast(basics), "column_name")  # a row per column
    value, last = F.col("v"), F.col("rows") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), value))

    outputs = [F.sum(F.col("n") * F.pow(value - F.col("mean"), 2)).alias("squares")]
    for q in QUARTILES:
        place = last * F.lit(q)
        outputs += [at(F.floor(place)).alias(f"low{q}"), at(F.ceil(place)).alias(f"high{q}"), F.max(place - F.floor(place)).alias(f"part{q}")]
    summed = known.groupBy("column_name", "rows", "mean", "min", "max").agg(*outputs)
    quartiles = [(F.col(f"`low{q}`") + (F.col(f"`high{q}`") - F.col(f"`low{q}`")) * F.col(f"`part{q}`")).alias(f"p{int(q * 100)}") for q in QUARTILES]
    summed = summed.select(
        "column_name", F.col("rows").alias("count"), "mean", F.sqrt(F.try_divide("squares", last)).alias("std"), "min", *quartiles, "max"
    )
    # a column without values has a row, too
    names = table.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    kept = [F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max"]
    return names.join(summed, "column_name", "left").select("column_name", *kept)


def describe_text(table: DataFrame, column: str) -> DataFrame:
    """Count, distinct values, the most frequent one (first in order among equals) and its count."""
    counts = value_counts(table, column)
    most = F.max("count").alias("freq")
    first_of_most = F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("top")
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"),
        F.count("*").alias("unique"),
        first_of_most,
        most,
    )


def table_shape(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count("*").alias("rows"),
        F.lit(len(table.columns)).alias("columns"),
        F.lit(",".join(table.columns)).alias("column_names"),
        F.lit(",".join(kind for _, kind in table.dtypes)).alias("dtypes"),
    )


def n_unique(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column.

    Cells are reduced to distinct (column, value) first, so each is counted where it hashes to.
    """
    cells = _long(table, columns).filter(F.col("value").isNotNull()).distinct()
    return cells.groupBy("column_name").agg(F.count("*").alias("n_unique"))


def pivot_counts(table: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Row x column counts with empty cells zero; columns are discovered unless given."""
    present = table.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    if values is None:
        found = present.select(column).distinct().orderBy(column).limit(MAX_PIVOT + 1).collect()
        if len(found) > MAX_PIVOT:
            raise ValueError(f"{column} has more than {MAX_PIVOT} values; cell_counts has the long form")
        values = [r[0] for r in found]
    wide = present.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def cell_counts(table: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n): a cross-tabulation in long form, with as many columns as there are values."""
    present = table.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    return present.groupBy(row, column).agg(F.count("*").alias("n"))


def crosstab(table: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    wide = pivot_counts(table, row, column, values)
    return wide.select(row, *[F.col(f"`{c}`").alias(f"{column}_{c}") for c in wide.columns if c != row])


def id_coverage(mentions: DataFrame, assertions: DataFrame) -> DataFrame:
    """Distinct ids among mentions, subjects, objects, and subjects with / or objects.

    Every id is reduced to one row telling where it occurs, and the five sizes are sums over it.
    """

    def seen(frame: DataFrame, column: str, place: str) -> DataFrame:
        return frame.select(
            F.col(column).alias("id"), *[F.lit(int(place == p)).alias(p) for p in ("in_mentions", "as_subject", "as_object")]
        )

    everywhere = (
        seen(mentions, "mention_id", "in_mentions")
        .unionByName(seen(assertions, "subject_id", "as_subject"))
        .unionByName(seen(assertions, "object_id", "as_object"))
        .filter(F.col("id").isNotNull())
    )
    places = everywhere.groupBy("id").agg(*[F.max(p).alias(p) for p in ("in_mentions", "as_subject", "as_object")])
    sizes = places.agg(
        F.sum("in_mentions").alias("mention_ids"),
        F.sum("as_subject").alias("subject_ids"),
        F.sum("as_object").alias("object_ids"),
        F.sum(F.least("as_subject", "as_object")).alias("subject_and_object"),
        F.sum(F.greatest("as_subject", "as_object")).alias("subject_or_object"),
    )
    names = sizes.columns
    return sizes.select(F.lit(0).alias("__one"), "*").unpivot("__one", names, "label", "ids").drop("__one")


def distinct_ids(table: DataFrame, column: str) -> DataFrame:
    return table.select(F.col(column).alias("id")).distinct()
