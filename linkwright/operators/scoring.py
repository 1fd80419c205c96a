"""Scoring candidate pairs and looking into the scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwright.operators.blocking import PAIRS_PER_TASK, BlockRule, count_comparisons, multi_pass_blocking, self_pairing, sided
from linkwright.operators.comparison import gamma_vectors, input_columns
from linkwright.operators.model import DEFAULT_PRIOR, LinkModel, LinkSettings, initial_model, probability
from linkwright.operators.pruning import MARGIN, passing_pairs, reachable_probabilities
from linkwright.operators.spread import spread_lookup
from linkwright.session import cut_lineage

ID_PAIR = ("unique_id_l", "unique_id_r")
LEADING = 64  # left records taken first
MOST_LEADING = 100_000
TRIED = 6


def candidate_gammas(
    left: DataFrame,
    right: DataFrame,
    settings: LinkSettings,
    pairs_per_task: int = PAIRS_PER_TASK,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Agreement levels of every blocked pair; `carry` names record columns to keep from both sides."""
    columns = [*input_columns(settings.comparisons), *settings.columns, *carry]
    pairs = multi_pass_blocking(left, right, settings.rules, columns, pairs_per_task=pairs_per_task)
    kept = [f"{c}{suffix}" for c in carry for suffix in ("_l", "_r")]
    return gamma_vectors(pairs, settings.comparisons, [*ID_PAIR, "match_key", *kept])


def score_gammas(gammas: DataFrame, model: LinkModel, threshold: float | None = None) -> DataFrame:
    """Add weight and probability; keep probability >= threshold.

    Parameters are literals, so scoring and the cut happen in the stage that produced the pairs.
    """
    scored = gammas.withColumn("match_weight", model.total_weight())
    scored = scored.withColumn("match_probability", probability(F.col("match_weight")))
    return scored if threshold is None else scored.filter(F.col("match_probability") >= threshold)


def wanted_pairs(
    left: DataFrame, right: DataFrame, rules: Sequence[BlockRule], columns: Sequence[str], wanted: DataFrame
) -> DataFrame:
    """Those of the blocked pairs whose (unique_id_l, unique_id_r) `wanted` holds, each tagged with its first rule.

    The records of each wanted pair are looked up and every rule is tried on them: work that grows with `wanted` and
    the records, where forming the blocks first would grow with the square of a block.
    """
    needed = sorted({"unique_id", *columns, *(c for r in rules for c in r.columns())})
    pairs = wanted.select(*ID_PAIR).distinct()
    pairs = spread_lookup(pairs, sided(left, "_l", needed), ["unique_id_l"], ["unique_id_r"])
    pairs = spread_lookup(pairs, sided(right, "_r", needed), ["unique_id_r"], ["unique_id_l"])
    first = F.coalesce(*[F.when(rule.holds(), F.lit(number)) for number, rule in enumerate(rules)])
    return pairs.withColumn("match_key", first).filter(F.col("match_key").isNotNull())


def predict(
    left: DataFrame,
    right: DataFrame,
    settings: LinkSettings,
    model: LinkModel,
    threshold: float | None = 0.2,
    pairs_per_task: int = PAIRS_PER_TASK,
    carry: Sequence[str] = (),
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Scored pairs at or above the threshold.  `carry` names record columns to keep from both sides.

    With a threshold, rules that would offer records very many partners are narrowed to what can
    still pass.  `wanted`: only pairs whose (unique_id_l, unique_id_r) it holds, the same rows that a semi-join of
    all predictions with it would leave.
    """
    columns = [*input_columns(settings.comparisons), *settings.columns, *carry]
    kept = [f"{c}{suffix}" for c in carry for suffix in ("_l", "_r")]
    if wanted is not None:
        pairs = wanted_pairs(left, right, settings.rules, columns, wanted)
        return score_gammas(gamma_vectors(pairs, settings.comparisons, [*ID_PAIR, "match_key", *kept]), model, threshold)
    if threshold is None or not all(rule.keyed for rule in settings.rules):
        return score_gammas(candidate_gammas(left, right, settings, pairs_per_task, carry), model, threshold)
    pairs = passing_pairs(left, right, settings.rules, columns, model, threshold, pairs_per_task)
    return score_gammas(gamma_vectors(pairs, settings.comparisons, [*ID_PAIR, "match_key", *kept]), model, threshold)


def predict_untrained(
    left: DataFrame, right: DataFrame, settings: LinkSettings, threshold: float | None = 0.2, prior: float = DEFAULT_PRIOR
) -> DataFrame:
    """Predictions under initial parameters; under the default prior few pairs or none reach the threshold."""
    return predict(left, right, settings, initial_model(settings.comparisons, prior), threshold)


def leading_predictions(
    left: DataFrame,
    right: DataFrame,
    settings: LinkSettings,
    model: LinkModel,
    threshold: float | None,
    n: int,
    below: float | None = None,
    pairs_per_task: int = PAIRS_PER_TASK,
    records: int = LEADING,
) -> DataFrame:
    """Predictions that hold the first `n` in the order of ids: all of the left records with the smallest ids.

    So many left records are taken, eight times more each time, that their predictions are at least `n`; records
    with larger ids have no pair before these.  Beyond `MOST_LEADING` all are taken.  `below`: only predictions under
    that probability.
    """
    number = left.count()
    while True:
        part = left
        if records < min(number, MOST_LEADING):
            edge = left.select("unique_id").orderBy("unique_id").limit(records).agg(F.max("unique_id")).first()[0]
            part = left.filter(F.col("unique_id").isNull() | (F.col("unique_id") <= F.lit(edge)))
        found = predict(part, right, settings, model, threshold, pairs_per_task)
        found = found if below is None else found.filter(F.col("match_probability") < below)
        if part is left:
            return found
        found = cut_lineage(found)
        if found.count() >= n:
            return found
        records *= 8


def best_predictions(
    left: DataFrame, right: DataFrame, settings: LinkSettings, model: LinkModel, threshold: float, n: int,
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Predictions that hold the `n` best, ties in the order of ids.

    The probabilities that levels can add up to are tried from the top, each with the rules narrowed to it, until `n`
    pairs are found; of pairs that share a probability those leading in the order of ids are enough.  Where few pairs
    are offered, or after `TRIED` probabilities, all predictions at or above the threshold are formed.
    """
    def plain() -> DataFrame:
        return predict(left, right, settings, model, threshold, pairs_per_task)

    reached = reachable_probabilities(settings.rules, model)
    if reached is None or not all(rule.keyed for rule in settings.rules):
        return plain()
    offered = count_comparisons(left, right, settings.rules).agg(F.sum("post_filter")).first()[0]
    if (offered or 0) <= pairs_per_task:
        return plain()
    found, wanted, above = None, n, None
    for chance in [p for p in reached if p >= threshold][:TRIED]:
        if above is not None and above - chance < 4 * MARGIN:
            return plain()  # too close to be told apart
        one = leading_predictions(
            left, right, settings, model, chance - MARGIN, wanted, None if above is None else above - MARGIN, pairs_per_task
        )
        one = cut_lineage(one.orderBy(*ID_PAIR).limit(wanted))
        found = one if found is None else found.unionByName(one)
        wanted, above = wanted - one.count(), chance
        if wanted <= 0:
            return found
    return plain()


def top_scored_pairs(predictions: DataFrame, n: int) -> DataFrame:
    return predictions.orderBy(F.desc("match_probability"), *ID_PAIR).limit(n)


def unlinkables_curve(records: DataFrame, model: LinkModel) -> DataFrame:
    """Share of records that could not reach a weight even against themselves.

    A record's own pattern is all-equal but for missing values, so the curve has at most one point
    per combination of missing columns and the window below sees only those points.
    """
    gammas = gamma_vectors(self_pairing(records, input_columns(model.comparisons)), model.comparisons, [])
    weights = gammas.select(F.round(model.total_weight(), 2).alias("match_weight"))
    points = weights.groupBy("match_weight").agg(F.count("*").alias("records"))
    below = W.orderBy("match_weight").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    return points.select(
        "match_weight",
        "records",
        probability(F.col("match_weight")).alias("match_probability"),
        (F.coalesce(F.sum("records").over(below), F.lit(0)) / F.sum("records").over(everything)).alias("share_below"),
    )


def weight_waterfall_table(
    predictions: DataFrame, model: LinkModel, records: Sequence[str] | None = None, chosen: DataFrame | None = None
) -> DataFrame:
    """Per pair the steps from the prior to the final weight.

    `records`: only pairs that one of these ids is in; `chosen`: only pairs whose (unique_id_l, unique_id_r) it
    holds.  Both choose before anything is unfolded.  The number of steps is fixed, so running totals are sums of columns: no shuffle, no window.
    """
    if records is not None:
        predictions = predictions.filter(F.col(ID_PAIR[0]).isin(*records) | F.col(ID_PAIR[1]).isin(*records))
    if chosen is not None:
        predictions = predictions.join(chosen.select(*ID_PAIR).distinct(), list(ID_PAIR), "left_semi")
    steps = [F.struct(F.lit(0).alias("step"), F.lit("prior").alias("term"), F.lit(None).cast("int").alias("level"),
                      F.lit(model.prior_weight).alias("contribution"), F.lit(model.prior_weight).alias("running_weight"))]
    running = F.lit(model.prior_weight)
    for number, c in enumerate(model.comparisons, 1):
        running = running + model.weight_column(c)
        steps.append(
            F.struct(
                F.lit(number).alias("step"),
                F.lit(c.key).alias("term"),
                F.col(c.gamma).alias("level"),
                model.weight_column(c).alias("contribution"),
                running.alias("running_weight"),
            )
        )
    steps.append(
        F.struct(F.lit(len(steps)).alias("step"), F.lit("final").alias("term"), F.lit(None).cast("int").alias("level"),
                 running.alias("contribution"), running.alias("running_weight"))
    )
    return predictions.select(*ID_PAIR, F.inline(F.array(*steps)))
