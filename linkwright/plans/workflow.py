"""The three jobs of a linkage, files in and files out.

    link    mentions            -> predictions
    boost   predictions, edges  -> predictions with corroboration
    assess  boosted, truth      -> quality measures
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from linkwright.operators import evaluation, kinship, prepare, profiling, scoring, training
from linkwright.operators.model import LinkModel, LinkSettings, initial_model
from linkwright.plans import settings as census
from linkwright.plans.store import stored
from linkwright.sources import readers


def load_records(
    spark: SparkSession,
    mentions_path: str,
    sources: Sequence[str],
    years: tuple[int, int],
    unused: Sequence[str] = census.UNUSED,
) -> tuple[DataFrame, DataFrame]:
    """The two cleaned sides; of repeated ids the first in file order is kept."""
    mentions = readers.read_mentions(spark, mentions_path, keep_order=True)
    cleaned = prepare.clean_records(mentions, sources, ["file_order"], [*unused, "file_order"])
    return prepare.split_by_year(stored(spark, cleaned, "records"), *years)


def link(
    spark: SparkSession,
    mentions_path: str,
    output: str,
    sources: Sequence[str],
    years: tuple[int, int],
    settings: LinkSettings = census.SETTINGS,
    threshold: float | None = census.THRESHOLD,
    trained: bool = True,
    format: str = "parquet",
) -> LinkModel:
    """Train (unless told not to), score the blocked pairs and write those at or above the threshold."""
    left, right = load_records(spark, mentions_path, sources, years)
    model = initial_model(settings.comparisons)
    if trained:
        model = training.train(left, right, model, census.DETERMINISTIC, census.TRAINING_BLOCKS, census.RECALL)
    readers.write_predictions(scoring.predict(left, right, settings, model, threshold), output, format)
    return model


def boost(
    spark: SparkSession,
    predictions: DataFrame,
    assertions: DataFrame,
    output: str,
    matches_output: str | None = None,
    format: str = "parquet",
) -> None:
    """Strengthen every pair by how well the two records' relatives match each other."""
    if matches_output:
        readers.write_matches(predictions, matches_output)
    matches = stored(spark, predictions.select("unique_id_l", "unique_id_r", "match_probability"), "matches")
    edges = stored(spark, kinship.symmetric_edges(assertions), "edges")
    readers.write_boosted(kinship.relative_corroboration(matches, edges), output, format)


def assess(
    spark: SparkSession, boosted: DataFrame, truth: DataFrame, prefixes: tuple[str, str], thresholds: Sequence[float] = (0.8, 0.9)
) -> dict[str, DataFrame]:
    """Measures of the links against graded truth, by name."""
    ids = {"1870_line": (prefixes[0], "id_1870"), "1880_line": (prefixes[1], "id_1880")}
    wide = evaluation.truth_left_join(prepare.derive_record_ids(truth, ids), boosted)
    joined = stored(spark, prepare.drop_columns(wide, [*ids, "unique_id_l", "unique_id_r"]), "joined")
    return {
        "metrics": evaluation.evaluate(joined),
        "counts": evaluation.evaluation_counts(joined),
        "calibration": evaluation.calibration_table(prepare.filter_isin_binary_label(joined)),
        "probability_by_confidence": evaluation.mean_prob_by_confidence(joined),
        "corroboration_by_confidence": evaluation.mean_corroboration_by_confidence(joined),
        "recall": evaluation.recall_at_threshold(joined, thresholds),
        "score_and_probability": prepare.project_pair_score(joined),
        "truth_summary": profiling.describe_numeric(truth, ["score", "confidence"]),
        "truth_distinct": profiling.n_unique(truth, ["score", "confidence"]),
        "truth_counts": evaluation.score_value_counts(truth),
        "truth_crosstab": profiling.crosstab(truth, "confidence", "score"),
    }
