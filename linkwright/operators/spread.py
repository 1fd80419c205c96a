"""Equi-joins whose heavy keys are spread over many tasks.

A key that holds a large share of both sides would otherwise be joined by one task.  Here the rows
of such a key are laid out on a grid: left rows are cut into `split_l` strips and right rows into
`split_r` strips, each left strip is sent to every right strip, and the strip numbers become part of
the join key.  Every pair still meets exactly once.

All other keys are joined plainly, so adaptive execution may merge and split their partitions.  Heavy keys
are a table of one hash and two numbers per key, joined like any other: none is left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.operators.prepare import all_of
from linkwright.session import cut_lineage

PAIRS_PER_TASK = 2_000_000
ROWS_PER_TASK = 5_000_000
MOST_TASKS = 50_000  # of the heavy keys' shuffle; further strips share tasks


def _key_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def _known(columns: Sequence[str]) -> Column:
    return all_of([F.col(c).isNotNull() for c in columns])


def heavy_blocks(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """(key hash, split_l, split_r, pairs) of the blocks above the pair budget."""
    n_l = left.filter(_known(left_keys)).groupBy(_key_hash(left_keys).alias("__key")).agg(F.count("*").alias("n_l"))
    n_r = right.filter(_known(right_keys)).groupBy(_key_hash(right_keys).alias("__key")).agg(F.count("*").alias("n_r"))
    strip = float(pairs_per_task) ** 0.5

    def strips(rows: str, other: str) -> Column:
        # A short side is left whole and the long side is cut finer.
        whole = F.least(F.col(other).cast("double"), F.lit(strip))
        count = F.ceil(F.col(rows) * whole / F.lit(float(pairs_per_task)))
        return F.greatest(count, F.lit(1)).cast("int")

    return (
        n_l.join(n_r, "__key")
        .withColumn("__pairs", F.col("n_l").cast("double") * F.col("n_r"))
        .filter(F.col("__pairs") > pairs_per_task)
        .select("__key", strips("n_l", "n_r").alias("split_l"), strips("n_r", "n_l").alias("split_r"), "__pairs")
    )


def _lay_out(side: DataFrame, spread_by: str, own: str, other: str, cell: tuple[str, str]) -> DataFrame:
    """Give each row its own strip number and a copy for every strip of the other side."""
    laid = side.withColumn(cell[0], F.pmod(F.xxhash64(F.col(spread_by)), F.col(own).cast("bigint")).cast("int"))
    laid = laid.withColumn(cell[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    return laid.drop("__key", "split_l", "split_r")


def _one_type(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides' keys under their common type: hashes of an int and a bigint differ."""
    for a, b in zip(left_keys, right_keys):
        if left.schema[a].dataType != right.schema[b].dataType:
            common = left.select(F.col(a).alias("k")).limit(0).union(right.select(F.col(b).alias("k")).limit(0)).schema["k"].dataType
            left, right = left.withColumn(a, F.col(a).cast(common)), right.withColumn(b, F.col(b).cast(common))
    return left, right


def spread_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    left_id: str,
    right_id: str,
    condition: Column | None = None,
    pairs_per_task: int = PAIRS_PER_TASK,
    largest: int | None = None,
) -> DataFrame:
    """Inner equi-join of two tables with disjoint column names, heavy keys on a grid.

    `largest` is a known bound on the pairs of any one key, such as the size of left x right; at or
    below the budget no key can be heavy and no key is counted.  Without heavy keys a plain join is
    planned and Spark picks its kind.
    """
    match = all_of([F.col(x) == F.col(y) for x, y in zip(left_keys, right_keys)])
    if condition is not None:
        match = match & condition
    if largest is not None and largest <= pairs_per_task:
        return left.join(right, match)
    left, right = _one_type(left, right, left_keys, right_keys)
    heavy = cut_lineage(heavy_blocks(left, right, left_keys, right_keys, pairs_per_task))
    seen = heavy.agg(F.sum("__pairs")).first()[0]
    if not seen:
        return left.join(right, match)
    heavy = heavy.drop("__pairs")
    a = left.withColumn("__key", _key_hash(left_keys)).join(heavy, "__key", "left")
    b = right.withColumn("__key", _key_hash(right_keys)).join(heavy, "__key", "left")
    light = [side.filter("split_l is null").drop("__key", "split_l", "split_r") for side in (a, b)]
    a = _lay_out(a.filter("split_l is not null"), left_id, "split_l", "split_r", ("__row_l", "__col_l"))
    b = _lay_out(b.filter("split_l is not null"), right_id, "split_r", "split_l", ("__col_r", "__row_r"))
    # A stated number of partitions, for these keys only: a small input with a large output must not be
    # merged into a few tasks by its size.
    tasks = min(MOST_TASKS, max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(seen / pairs_per_task)))
    a = a.repartition(tasks, *left_keys, "__row_l", "__col_l")
    b = b.repartition(tasks, *right_keys, "__row_r", "__col_r").hint("merge")
    cell = (F.col("__row_l") == F.col("__row_r")) & (F.col("__col_l") == F.col("__col_r"))
    spread = a.join(b, match & cell).drop("__row_l", "__col_l", "__row_r", "__col_r")
    return light[0].join(light[1], match).unionByName(spread)


def spread_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    sizes: DataFrame | None = None,
    largest: int | None = None,
    merge: bool = False,
) -> DataFrame:
    """Join facts to a table with one or few rows per key; rows of a heavy key are dealt over copies of
    that key's lookup rows.  `sizes` (keys and ``__n``) saves counting the facts again; `largest` is a
    known bound on the rows of any one key, such as the number of facts.  `merge`: neither side is sent
    whole to every task, for tables that are larger than Spark's estimate (many rows out of one)."""
    if largest is not None and largest <= rows_per_task:
        return facts.join(lookup.hint("merge") if merge else lookup, list(keys), how)
    counted = facts.groupBy(*keys).agg(F.count("*").alias("__n")) if sizes is None else sizes
    heavy = (
        counted.groupBy(_key_hash(keys).alias("__key"))
        .agg(F.sum("__n").alias("__n"))
        .filter(F.col("__n") > rows_per_task)
        .select("__key", F.ceil(F.col("__n") / rows_per_task).cast("int").alias("__copies"))
    )

    def marked(frame: DataFrame) -> DataFrame:
        with_key = frame.withColumn("__key", _key_hash(keys)).join(heavy, "__key", "left")
        return with_key.withColumn("__copies", F.coalesce("__copies", F.lit(1)))

    dealt = marked(facts).withColumn(
        "__deal", F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.col("__copies").cast("bigint")).cast("int")
    )
    copied = marked(lookup).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    dealt, copied = dealt.drop("__key", "__copies"), copied.drop("__key", "__copies")
    return dealt.join(copied.hint("merge") if merge else copied, [*keys, "__deal"], how).drop("__deal")
