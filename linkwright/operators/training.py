"""Estimating the model without labels.

Spark reduces the pairs of a training block to counts per agreement pattern (at most a few hundred
rows); expectation-maximisation then runs over those counts on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.blocking import BlockRule, cartesian_size, count_union, random_pair_sample
from linkwright.operators.comparison import NULL_LEVEL, Comparison, gamma_vectors, input_columns
from linkwright.operators.model import FLOOR, LinkModel, Rates, Session, initial_m
from linkwright.operators.patterns import pattern_counts

MAX_ROUNDS = 25
TOLERANCE = 1e-4


def estimate_prior(left: DataFrame, right: DataFrame, rules: Sequence[BlockRule], recall: float) -> DataFrame:
    """One row: pairs meeting the deterministic rules, all pairs, and the match chance of a random
    pair, pairs / recall / all."""
    if not 0 < recall <= 1:
        raise ValueError("recall must lie in (0, 1]")
    whole = cartesian_size(left, right).select("comparisons").scalar()
    found = count_union(left, right, rules).select(
        F.col("comparisons").alias("rule_pairs"), whole.alias("all_pairs")
    )
    share = F.try_divide(F.col("rule_pairs").cast("double") / F.lit(recall), F.col("all_pairs").cast("double"))
    return found.withColumn("prior", share)


def _prior_value(left: DataFrame, right: DataFrame, rules: Sequence[BlockRule], recall: float) -> float:
    prior = estimate_prior(left, right, rules, recall).first()["prior"]
    if prior is None or not 0 < prior < 1:
        raise ValueError(f"deterministic rules give an unusable prior: {prior}")
    return prior


def _level_shares(counts: dict[int, float], comparison: Comparison) -> dict[int, float]:
    total = sum(n for g, n in counts.items() if g != NULL_LEVEL)
    levels = range(len(comparison.levels), -1, -1)
    return {g: max(counts.get(g, 0) / total if total else 0.0, FLOOR) for g in levels}


def estimate_u(
    left: DataFrame,
    right: DataFrame,
    comparisons: Sequence[Comparison],
    max_pairs: int = 1_000_000,
    method: str = "sampled",
) -> Rates:
    """Level shares among random pairs.  ``sampled`` draws pairs; ``exact`` counts all of left x
    right through value counts, without forming a pair."""
    if method == "exact":
        rates = {}
        for c in comparisons:
            rows = pattern_counts(left, right, [c]).collect()
            rates[c.key] = _level_shares({r[c.gamma]: int(r["pairs"]) for r in rows}, c)
        return rates
    pairs = random_pair_sample(left, right, max_pairs, input_columns(comparisons))
    gammas = [c.gamma for c in comparisons]
    rows = gamma_vectors(pairs, comparisons, []).groupBy(*gammas).agg(F.count("*").alias("pairs")).collect()
    rates = {}
    for c in comparisons:
        counts: dict[int, float] = {}
        for row in rows:
            counts[row[c.gamma]] = counts.get(row[c.gamma], 0) + row["pairs"]
        rates[c.key] = _level_shares(counts, c)
    return rates


def u_table(spark: SparkSession, rates: Rates) -> DataFrame:
    rows = [(name, g, float(value)) for name, levels in rates.items() for g, value in levels.items()]
    return spark.createDataFrame(rows, "comparison string, level int, u double")


def trained_in(block: BlockRule, comparisons: Sequence[Comparison]) -> list[Comparison]:
    """Comparisons a block can teach: those not already decided by its columns."""
    return [c for c in comparisons if c.column not in block.columns()]


def em_session(
    left: DataFrame,
    right: DataFrame,
    model: LinkModel,
    block: BlockRule,
    max_rounds: int = MAX_ROUNDS,
    tolerance: float = TOLERANCE,
) -> Session:
    """Estimate m on the pairs of one block; u stays fixed and the block's own prior is let go."""
    learned = trained_in(block, model.comparisons)
    if not learned:
        raise ValueError("the block decides every comparison; nothing to train")
    rows = pattern_counts(left, right, learned, block).collect()
    patterns = [(tuple(r[c.gamma] for c in learned), int(r["pairs"])) for r in rows]
    block_pairs = sum(n for _, n in patterns)
    if not block_pairs:
        raise ValueError("the training block holds no pairs")
    sizes = cartesian_size(left, right).first()
    prior = min(0.5, model.prior * int(sizes["comparisons"]) / block_pairs)
    return run_em(block.label, learned, patterns, model.u, prior, max_rounds, tolerance)


def run_em(
    name: str,
    comparisons: Sequence[Comparison],
    patterns: Sequence[tuple[tuple[int, ...], int]],
    u: Rates,
    prior: float,
    max_rounds: int = MAX_ROUNDS,
    tolerance: float = TOLERANCE,
) -> Session:
    m: Rates = {c.key: initial_m(c) for c in comparisons}
    history, change, rounds = [], math.inf, 0
    while rounds < max_rounds and not change < tolerance:
        rounds += 1
        mass = {c.key: dict.fromkeys(m[c.key], 0.0) for c in comparisons}
        matched = total = likelihood = 0.0
        for gammas, pairs in patterns:
            match, other = prior, 1 - prior
            for c, g in zip(comparisons, gammas):
                if g != NULL_LEVEL:
                    match *= m[c.key][g]
                    other *= u[c.key][g]
            weight = pairs * match / (match + other)
            likelihood += pairs * math.log(match + other)
            matched += weight
            total += pairs
            for c, g in zip(comparisons, gammas):
                if g != NULL_LEVEL:
                    mass[c.key][g] += weight
        history.append(likelihood)
        change = 0.0
        for c in comparisons:
            known = sum(mass[c.key].values())
            for g, value in mass[c.key].items():
                new = max(value / known if known else m[c.key][g], FLOOR)
                change = max(change, abs(new - m[c.key][g]))
                m[c.key][g] = new
        prior = matched / total
    return Session(name, m, prior, rounds, change, tuple(history))


def session_table(spark: SparkSession, sessions: Sequence[Session]) -> DataFrame:
    """One row per session and level, with how far the session got."""
    rows = [
        (s.name, name, g, float(value), float(s.prior), s.rounds, float(s.last_change))
        for s in sessions
        for name, levels in s.m.items()
        for g, value in levels.items()
    ]
    schema = "session string, comparison string, level int, m double, prior double, rounds int, last_change double"
    return spark.createDataFrame(rows, schema)


def combine_sessions(model: LinkModel, sessions: Sequence[Session]) -> LinkModel:
    """Mean of the sessions' m per level; comparisons no session covered keep what they had."""
    combined: Rates = {}
    for c in model.comparisons:
        seen = [s.m[c.key] for s in sessions if c.key in s.m]
        if seen:
            combined[c.key] = {g: sum(levels[g] for levels in seen) / len(seen) for g in seen[0]}
    return replace(model.with_rates(m=combined), sessions=tuple(sessions))


def train(
    left: DataFrame,
    right: DataFrame,
    model: LinkModel,
    deterministic_rules: Sequence[BlockRule],
    training_blocks: Sequence[BlockRule],
    recall: float = 0.9,
    max_pairs: int = 1_000_000,
    max_rounds: int = MAX_ROUNDS,
    tolerance: float = TOLERANCE,
    u_method: str = "sampled",
) -> LinkModel:
    """Prior, u, one session per block, combined."""
    model = model.with_rates(
        prior=_prior_value(left, right, deterministic_rules, recall),
        u=estimate_u(left, right, model.comparisons, max_pairs, u_method),
    )
    sessions = [em_session(left, right, model, block, max_rounds, tolerance) for block in training_blocks]
    return combine_sessions(model, sessions)
