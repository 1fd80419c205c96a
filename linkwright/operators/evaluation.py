"""How far links can be trusted, measured against graded truth."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.scalars import bin_of, even_edges, log_loss_term
from linkwright.operators.ordering import running_totals
from linkwright.operators.prepare import drop_nulls_any, filter_isin_binary_label
from linkwright.operators.profiling import value_counts
from linkwright.session import cut_lineage


def truth_left_join(truth: DataFrame, predictions: DataFrame, left: str = "id_1870", right: str = "id_1880") -> DataFrame:
    """Truth with the prediction for each pair, or nulls.

    Predictions are cut to the truth's pairs first by a semi-join, where Spark may broadcast the truth
    if it is small; a left join could not, because the truth is the side that must be kept.
    """
    keys = truth.select(F.col(left).alias("unique_id_l"), F.col(right).alias("unique_id_r"))
    relevant = predictions.join(keys, ["unique_id_l", "unique_id_r"], "left_semi")
    return truth.join(
        relevant, (truth[left] == relevant["unique_id_l"]) & (truth[right] == relevant["unique_id_r"]), "left"
    )


def pair_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (id_l, id_r) present in both."""
    return a.select("id_l", "id_r").intersect(b.select("id_l", "id_r"))


def pair_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (id_l, id_r) of a that b lacks."""
    return a.select("id_l", "id_r").subtract(b.select("id_l", "id_r"))


def mean_prob_by_confidence(joined: DataFrame) -> DataFrame:
    return joined.groupBy("confidence").agg(F.avg("match_probability").alias("match_probability"))


def mean_corroboration_by_confidence(joined: DataFrame) -> DataFrame:
    """Rows with a null anywhere are dropped first."""
    whole = drop_nulls_any(joined)
    return whole.groupBy("confidence").agg(F.avg("relatives_match_probability").alias("relatives_match_probability"))


def _roc_terms(labelled: DataFrame, probability: str) -> DataFrame:
    """Distinct probabilities with positives, negatives and negatives below each."""
    points = labelled.groupBy(F.col(probability).cast("double").alias("p")).agg(
        F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives")
    )
    return running_totals(points, "p", ["negatives"])


def roc_auc(labelled: DataFrame, probability: str = "match_probability") -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; null with one class only."""
    won = F.sum(
        F.col("positives").cast("double") * (F.col("before_negatives") + F.col("negatives") / F.lit(2.0))
    )
    whole = F.sum("positives").cast("double") * F.sum("negatives")
    return _roc_terms(labelled, probability).agg(F.when(whole > 0, won / whole).alias("auc"))


def _brier(probability: str) -> Column:
    return F.avg(F.pow(F.col(probability) - F.col("label"), 2))


def _log_loss(probability: str, eps: float | None) -> Column:
    return F.avg(log_loss_term(F.col("label"), F.col(probability), eps))


def _accuracy(probability: str) -> Column:
    return F.avg(((F.col("label") == 1) == (F.col(probability) >= 0.5)).cast("int"))


def brier_score(labelled: DataFrame, probability: str = "match_probability") -> DataFrame:
    return labelled.agg(_brier(probability).alias("brier"))


def log_loss(labelled: DataFrame, probability: str = "match_probability", eps: float | None = None) -> DataFrame:
    return labelled.agg(_log_loss(probability, eps).alias("log_loss"))


def accuracy_at_half(labelled: DataFrame, probability: str = "match_probability") -> DataFrame:
    return labelled.agg(_accuracy(probability).alias("accuracy"))


def evaluation_counts(joined: DataFrame, kept: Sequence[int] = (0, 3)) -> DataFrame:
    """Rows used and dropped, the dropped ones split into other grades and missing predictions."""
    extreme, scored = F.col("confidence").isin(*kept), F.col("match_probability").isNotNull()
    return joined.agg(
        F.count(F.when(extreme & scored, 1)).alias("used"),
        (F.count("*") - F.count(F.when(extreme & scored, 1))).alias("dropped"),
        F.count(F.when(~extreme, 1)).alias("dropped_other_grade"),
        F.count(F.when(extreme & ~scored, 1)).alias("dropped_unmatched"),
    )


def calibration_table(labelled: DataFrame, bins: int = 10, probability: str = "match_probability") -> DataFrame:
    edges = even_edges(bins)
    return labelled.groupBy(bin_of(F.col(probability), edges).alias("bin")).agg(
        F.avg(probability).alias("mean_pred"), F.avg("label").alias("mean_true"), F.count("*").alias("n")
    )


def recall_at_threshold(joined: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Share of truth pairs found strictly above each threshold, per grade and overall."""
    marked = joined.select(
        F.col("confidence").cast("string").alias("confidence"),
        F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"),
        "match_probability",
    )
    found = F.coalesce(F.col("match_probability") > F.col("threshold"), F.lit(False))
    graded = marked.rollup("threshold", "confidence").agg(
        F.avg(found.cast("int")).alias("match_percentage"),
        F.count("*").alias("truth_pairs"),
        F.grouping_id().alias("__level"),
    )
    return graded.filter("__level < 3").select(
        "threshold",
        F.when(F.col("__level") == 1, F.lit("overall")).otherwise(F.col("confidence")).alias("confidence_level"),
        "match_percentage",
        "truth_pairs",
    )


def confidence_examples(truth: DataFrame, confidence: int, order: Sequence[str], n: int = 3) -> DataFrame:
    return truth.filter(F.col("confidence") == confidence).orderBy(*order).limit(n)


def score_value_counts(truth: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent scores and every grade, with counts."""
    scores = value_counts(truth, "score", n=n).select(F.lit("score").alias("column_name"), "value", "count")
    grades = value_counts(truth, "confidence").select(F.lit("confidence").alias("column_name"), "value", "count")
    return scores.unionByName(grades)


def density_table(
    table: DataFrame, column: str, points: int = 200, reach: float = 3.0, weight: str | None = None
) -> DataFrame:
    """Gaussian kernel density on an even grid running `reach` bandwidths past the extremes.

    Bandwidth is n^(-1/5) times the sample standard deviation.  Equal values are counted once, and
    each adds to every grid point, so the sum is one aggregation without an ordering or a join.
    `weight` names a column with the number of observations a row stands for.
    """
    values = table.select(F.col(column).cast("double").alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("c"))
    values = cut_lineage(values.filter(F.col("v").isNotNull()).groupBy("v").agg(F.sum("c").alias("c")))
    s = values.agg(
        F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")
    ).first()
    n, mean = float(s["n"] or 0), s["mean"]
    squares = values.agg(F.sum(F.col("c") * F.pow(F.col("v") - F.lit(mean), 2))).first()[0] if n > 1 else 0
    if not squares:
        raise ValueError(f"{column} has no spread; its density is not defined")
    width = n**-0.2 * (squares / (n - 1)) ** 0.5
    start = s["low"] - reach * width
    step = (s["high"] + reach * width - start) / (points - 1)
    spots = F.sequence(F.lit(0), F.lit(points - 1))
    counted = values.select("v", "c", F.explode(spots).alias("point"))
    x = F.lit(start) + F.col("point") * F.lit(step)
    kernel = F.col("c") * F.exp(F.lit(-0.5) * F.pow((x - F.col("v")) / F.lit(width), 2))
    scale = n * width * math.sqrt(2 * math.pi)
    return counted.groupBy("point").agg((F.sum(kernel) / F.lit(scale)).alias("density")).select(
        "point", x.alias("x"), "density"
    )


def evaluate(joined: DataFrame, eps: float | None = None) -> DataFrame:
    """AUC, Brier score, log loss, accuracy and row counts in one row.

    Everything but the AUC comes from one pass over the joined truth.
    """
    labelled = filter_isin_binary_label(joined)
    y, p = F.col("label"), F.col("match_probability")
    extreme, scored = F.col("confidence").isin(0, 3), p.isNotNull()
    used = extreme & scored
    flagged = joined.withColumn("label", (F.col("confidence") == 3).cast("int"))
    metrics = flagged.agg(
        F.avg(F.when(used, F.pow(p - y, 2))).alias("brier"),
        F.avg(F.when(used, log_loss_term(y, p, eps))).alias("log_loss"),
        F.avg(F.when(used, ((y == 1) == (p >= 0.5)).cast("int"))).alias("accuracy"),
        F.count(F.when(used, 1)).alias("used"),
        (F.count("*") - F.count(F.when(used, 1))).alias("dropped"),
    )
    auc = roc_auc(labelled).scalar()
    return metrics.select(auc.alias("auc"), "brier", "log_loss", "accuracy", "used", "dropped")
