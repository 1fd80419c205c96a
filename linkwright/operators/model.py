"""The linkage model: a prior and, per comparison level, the chance of that level among matching
(m) and among non-matching (u) pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.blocking import BlockRule
from linkwright.operators.comparison import Comparison

FLOOR = 1e-9
DEFAULT_PRIOR = 1e-4
CLOSEST_M = 0.9

Rates = dict[str, dict[int, float]]


@dataclass(frozen=True)
class LinkSettings:
    """Blocking rules and comparisons; `columns` names inputs that only SQL rules or levels read."""

    rules: tuple[BlockRule, ...]
    comparisons: tuple[Comparison, ...]
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class LinkModel:
    comparisons: tuple[Comparison, ...]
    m: Rates
    u: Rates
    prior: float = DEFAULT_PRIOR
    sessions: tuple["Session", ...] = field(default=(), compare=False)

    def weight(self, comparison: Comparison, gamma: int) -> float:
        return math.log2(max(self.m[comparison.key][gamma], FLOOR) / max(self.u[comparison.key][gamma], FLOOR))

    @property
    def prior_weight(self) -> float:
        return math.log2(self.prior / (1 - self.prior))

    def weight_column(self, comparison: Comparison) -> Column:
        """Weight of the observed level as literals, zero for the null level."""
        chain = None
        for gamma in sorted(self.m[comparison.key], reverse=True):
            value = F.lit(self.weight(comparison, gamma))
            test = F.col(comparison.gamma) == gamma
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return chain.otherwise(F.lit(0.0))

    def total_weight(self) -> Column:
        total = F.lit(self.prior_weight)
        for comparison in self.comparisons:
            total = total + self.weight_column(comparison)
        return total

    def with_rates(self, m: Rates | None = None, u: Rates | None = None, prior: float | None = None) -> "LinkModel":
        return replace(
            self,
            m={**self.m, **(m or {})},
            u={**self.u, **(u or {})},
            prior=self.prior if prior is None else prior,
        )


@dataclass(frozen=True)
class Session:
    """Outcome of one training block."""

    name: str
    m: Rates
    prior: float
    rounds: int
    last_change: float
    log_likelihood: tuple[float, ...]


def probability(weight: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -weight))


def initial_m(comparison: Comparison) -> dict[int, float]:
    """0.9 for the closest level, the remainder shared equally."""
    levels = len(comparison.levels)
    shared = (1 - CLOSEST_M) / levels
    return {g: CLOSEST_M if g == levels else shared for g in range(levels, -1, -1)}


def initial_u(comparison: Comparison) -> dict[int, float]:
    levels = len(comparison.levels) + 1
    return {g: 1 / levels for g in range(levels - 1, -1, -1)}


def initial_model(comparisons: Sequence[Comparison], prior: float = DEFAULT_PRIOR) -> LinkModel:
    return LinkModel(
        tuple(comparisons),
        {c.key: initial_m(c) for c in comparisons},
        {c.key: initial_u(c) for c in comparisons},
        prior,
    )


# -- parameter tables (a few rows per comparison) ---------------------------------------------------


def m_u_table(spark: SparkSession, model: LinkModel) -> DataFrame:
    rows = [
        (c.key, g, label, float(model.m[c.key][g]), float(model.u[c.key][g]))
        for c in model.comparisons
        for g, label in c.level_labels().items()
    ]
    return spark.createDataFrame(rows, "comparison string, level int, label string, m double, u double")


def match_weight_table(spark: SparkSession, model: LinkModel) -> DataFrame:
    rows = [("prior", 0, "prior", float(model.prior_weight))]
    rows += [
        (c.key, g, label, float(model.weight(c, g))) for c in model.comparisons for g, label in c.level_labels().items()
    ]
    return spark.createDataFrame(rows, "comparison string, level int, label string, match_weight double")


def parameter_estimates_table(spark: SparkSession, model: LinkModel) -> DataFrame:
    """What each training session, and the u estimate, said about every level."""
    labels = {c.key: c.level_labels() for c in model.comparisons}
    rows = [
        (session.name, name, g, labels[name][g], "m", float(value))
        for session in model.sessions
        for name, levels in session.m.items()
        for g, value in levels.items()
    ]
    rows += [
        ("random pairs", name, g, labels[name][g], "u", float(value))
        for name, levels in model.u.items()
        for g, value in levels.items()
    ]
    schema = "session string, comparison string, level int, label string, parameter string, estimate double"
    return spark.createDataFrame(rows, schema)
