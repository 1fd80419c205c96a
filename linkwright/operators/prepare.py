"""Cleaning, projecting and filtering record tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filter_sources(records: DataFrame, sources: Sequence[str], column: str = "source") -> DataFrame:
    return records.filter(F.col(column).isin(*sources))


def rename_columns(frame: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return frame.withColumnsRenamed(dict(names))


def dedup_by_key(frame: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first row per key in the stated order, which must be total.

    ``row_number() = 1`` lets Spark cut every key to one row per map task before the shuffle, so a
    key that holds a large share of the table never meets in one task.
    """
    ranked = frame.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.filter("__rank = 1").drop("__rank")


def dedup_report(frame: DataFrame, key: str) -> DataFrame:
    """One row: rows before, rows after, rows dropped, keys seen more than once."""
    per_key = frame.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_before"),
        F.count("*").alias("rows_after"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("rows_dropped"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"),
    )


def drop_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.drop(*columns)


def normalize_upper(frame: DataFrame, column: str) -> DataFrame:
    return frame.withColumn(column, F.upper(F.col(column)))


def split_by_year(frame: DataFrame, left_year: int, right_year: int, column: str = "source_year"):
    return frame.filter(F.col(column) == left_year), frame.filter(F.col(column) == right_year)


def clean_records(
    mentions: DataFrame,
    sources: Sequence[str],
    order: Sequence[str | Column],
    unused: Sequence[str] = (),
    upper: str = "middle_name",
) -> DataFrame:
    """Raw mentions to one cleaned table: sources, key name, duplicates, columns, upper case."""
    kept = filter_sources(mentions, sources)
    kept = rename_columns(kept, {"mention_id": "unique_id"})
    kept = dedup_by_key(kept, "unique_id", order)
    return normalize_upper(drop_columns(kept, unused), upper)


def prepare_records(
    mentions: DataFrame,
    sources: Sequence[str],
    years: tuple[int, int],
    order: Sequence[str | Column],
    unused: Sequence[str] = (),
    upper: str = "middle_name",
) -> tuple[DataFrame, DataFrame]:
    """Raw mentions to the two cleaned sides of the linkage."""
    return split_by_year(clean_records(mentions, sources, order, unused, upper), *years)


def derive_record_ids(frame: DataFrame, line_to_id: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add id columns: ``{line column: (prefix, id column)}``."""
    return frame.withColumns(
        {
            target: F.concat(F.lit(prefix), F.col(f"`{line}`").cast("string"))
            for line, (prefix, target) in line_to_id.items()
        }
    )


def threshold_filter(pairs: DataFrame, threshold: float, column: str = "match_probability") -> DataFrame:
    """Strictly above the threshold."""
    return pairs.filter(F.col(column) > threshold)


def drop_nulls_any(frame: DataFrame) -> DataFrame:
    return frame.na.drop("any")


def drop_nulls_subset(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.na.drop(subset=list(columns))


def filter_isin_binary_label(
    frame: DataFrame,
    column: str = "confidence",
    kept: Sequence[int] = (0, 3),
    positive: int = 3,
    probability: str = "match_probability",
) -> DataFrame:
    """Rows of the extreme grades that have a probability, with a 0/1 label."""
    return (
        frame.filter(F.col(column).isin(*kept))
        .filter(F.col(probability).isNotNull())
        .withColumn("label", (F.col(column) == positive).cast("int"))
    )


def filter_expression(frame: DataFrame, condition: str | Column) -> DataFrame:
    return frame.filter(condition)


def record_card(frame: DataFrame, record_id: str, key: str = "unique_id") -> DataFrame:
    """One record shown vertically as (column_name, value)."""
    picked = frame.filter(F.col(key) == record_id)
    as_text = picked.select(F.col(key).alias("__key"), *[F.col(f"`{c}`").cast("string").alias(c) for c in frame.columns])
    return as_text.unpivot("__key", frame.columns, "column_name", "value").drop("__key")


def project_pair_score(frame: DataFrame) -> DataFrame:
    return frame.select("score", "match_probability")


def preview_rows(frame: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    return frame.orderBy(*order).limit(n)


def project_id_pairs(frame: DataFrame, left: str, right: str, confidence: int | None = None) -> DataFrame:
    if confidence is not None:
        frame = frame.filter(F.col("confidence") == confidence)
    return frame.select(F.col(left).alias("id_l"), F.col(right).alias("id_r"))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
