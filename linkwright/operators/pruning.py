"""Leaving out pairs that cannot reach the threshold before they are formed.

Under a given model a loose rule such as "same race, same gender, born within five years" mostly
produces pairs that no agreement on the remaining comparisons could save, or only a near-equal first
name could.  What a pair must show is read off the model: all combinations of levels a rule allows are
scored (a few hundred), and a level of a comparison is necessary when every combination that passes
has it.  The rule's join is then replaced by narrower equi-joins that together give exactly the pairs
showing a passing level.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.operators.blocking import PAIRS_PER_TASK, BlockRule, block_on, block_pairs, count_rule
from linkwright.operators.comparison import ELSE_LEVEL, NULL_LEVEL, Comparison
from linkwright.operators.model import LinkModel
from linkwright.operators.patterns import close_words, countable
from linkwright.operators.spread import spread_lookup
from linkwright.session import cut_lineage

# A rule is narrowed when it offers the average record more partners than this.
PARTNERS = 50
# Guards the pass/fail decision on combinations against rounding in the last digits.
MARGIN = 1e-9
COMBINATIONS = 100_000


def allowed_levels(rule: BlockRule, comparison: Comparison) -> set[int]:
    """Levels a pair satisfying the rule can show."""
    every = {NULL_LEVEL, *range(len(comparison.levels) + 1)}
    if not countable(comparison):
        return every
    if comparison.column in rule.equal:
        return {len(comparison.levels)}
    tolerance = dict(rule.within).get(comparison.column)
    if tolerance is None or comparison.levels[0].kind != "within":
        return every
    reached = set()
    for gap in range(tolerance + 1):
        hit = next((comparison.gamma_of(x) for x in comparison.levels if gap <= x.amount), ELSE_LEVEL)
        reached.add(hit)
    return reached


def passing_levels(rule: BlockRule, model: LinkModel, threshold: float, missing: frozenset[str] = frozenset()) -> dict[str, set[int]]:
    """Per comparison the levels found among combinations that reach the threshold, given that the `missing`
    comparisons have no value."""
    def worth(comparison: Comparison, level: int) -> float:
        return 0.0 if level == NULL_LEVEL else model.weight(comparison, level)

    choices = {c.key: [NULL_LEVEL] if c.key in missing else sorted(allowed_levels(rule, c)) for c in model.comparisons}
    best = {c.key: max(worth(c, g) for g in choices[c.key]) for c in model.comparisons}
    passing: dict[str, set[int]] = {}
    for c in model.comparisons:
        # beside a level, every other comparison may show its best
        others = model.prior_weight + sum(value for key, value in best.items() if key != c.key)
        chance = {g: 1 / (1 + 2 ** min(-(others + worth(c, g)), 1000)) for g in choices[c.key]}
        passing[c.key] = {g for g, p in chance.items() if p >= threshold - MARGIN}
    return passing


def reachable_probabilities(rules: Sequence[BlockRule], model: LinkModel) -> list[float] | None:
    """The probabilities that pairs of the rules can have, best first; none if the levels combine in too many ways."""
    found: set[float] = set()
    for rule in rules:
        choices = [sorted(allowed_levels(rule, c)) for c in model.comparisons]
        if math.prod(map(len, choices)) > COMBINATIONS:
            return None
        for levels in itertools.product(*choices):
            weight = model.prior_weight
            weight += sum(model.weight(c, g) for c, g in zip(model.comparisons, levels) if g != NULL_LEVEL)
            found.add(1 / (1 + 2 ** min(-weight, 1000)))
    return sorted(found, reverse=True)


@dataclass(frozen=True)
class Narrowing:
    comparison: Comparison
    levels: frozenset[int]


def narrowing(rule: BlockRule, model: LinkModel, threshold: float, missing: frozenset[str] = frozenset()) -> Narrowing | None:
    """The comparison whose agreement the threshold makes necessary, if there is one."""
    passing = passing_levels(rule, model, threshold, missing)
    bound = rule.columns()
    usable = [
        c for c in model.comparisons
        if c.key not in missing and c.column not in bound and countable(c) and ELSE_LEVEL not in passing[c.key]
    ]
    order = ("edit", "equal", "within")
    usable.sort(key=lambda c: order.index(c.levels[0].kind))
    return Narrowing(usable[0], frozenset(passing[usable[0].key])) if usable else None


def _narrow_rules(
    left: DataFrame, right: DataFrame, rule: BlockRule, model: LinkModel, threshold: float, enough: float,
    missing: frozenset[str] = frozenset(),
):
    """Narrower joins (left, right, rule) whose pairs are disjoint and cover the levels needed.

    Where a value may be missing on one side, the next comparison that the threshold makes necessary, given that
    this one says nothing, is asked for in turn, until one gives a key or nothing passes.  A rule that a key or a
    tolerance was added to is narrowed again.  Branches of at most `enough` pairs are joined as they are.
    """

    def again(a: DataFrame, b: DataFrame, rule: BlockRule, missing: frozenset[str] = missing):
        if int(count_rule(a, b, rule).first()["comparisons"]) > enough:
            yield from _narrow_rules(a, b, rule, model, threshold, enough, missing)
        else:
            yield a, b, rule

    passing = passing_levels(rule, model, threshold, missing)
    if not all(passing.values()):
        return  # no combination of levels passes
    need = narrowing(rule, model, threshold, missing)
    if need is None:
        yield left, right, rule
        return
    c = need.comparison
    value = F.col(c.column)
    known_l, known_r = left.filter(value.isNotNull()), right.filter(value.isNotNull())
    close = [x for x in c.levels if x.kind != "prefix" and c.gamma_of(x) in need.levels]
    wide = next((x for x in c.levels if x.kind == "prefix" and c.gamma_of(x) in need.levels), None)
    if NULL_LEVEL in need.levels:
        for a, b in ((left.filter(value.isNull()), right), (known_l, right.filter(value.isNull()))):
            yield from again(a, b, rule, missing | {c.key})
    reach = max((x.amount for x in close), default=None)
    if c.levels[0].kind == "equal" and close:
        yield from again(known_l, known_r, rule.both(block_on(c.column)))
    elif c.levels[0].kind == "within" and close:
        yield from again(known_l, known_r, rule.both(BlockRule(within=((c.column, reach),))))
    elif c.levels[0].kind == "edit":
        if wide is not None:
            start = F.substring(value, 1, wide.amount)
            yield known_l.withColumn("__start", start), known_r.withColumn("__start", start), rule.both(block_on("__start"))
        if close:
            words = close_words(known_l.select(c.column), known_r.select(c.column), reach)
            if wide is not None:
                words = words.filter(F.substring("word_l", 1, wide.amount) != F.substring("word_r", 1, wide.amount))
            links = cut_lineage(words.select(F.col("word_l").alias(c.column), F.col("word_r").alias("__near")))
            near_l = spread_lookup(known_l, links, [c.column], ["unique_id"])
            yield near_l, known_r.withColumn("__near", value), rule.both(block_on("__near"))


def passing_pairs(
    left: DataFrame,
    right: DataFrame,
    rules: Sequence[BlockRule],
    columns: Sequence[str],
    model: LinkModel,
    threshold: float,
    pairs_per_task: int = PAIRS_PER_TASK,
    partners: int = PARTNERS,
) -> DataFrame:
    """Blocked pairs, each once and tagged with its first rule, without some that score below the
    threshold; every pair at or above it is there."""
    needed = sorted({"unique_id", *columns, *(c for r in rules for c in r.columns())})
    n_l, n_r = left.count(), right.count()
    united = None
    for number, rule in enumerate(rules):
        # Group counts tell how many pairs the rule would form, and so whether anything needs care.
        largest = n_l * n_r
        if largest > pairs_per_task:
            largest = int(count_rule(left, right, rule).first()["comparisons"])
        enough = max(pairs_per_task, partners * (n_l + n_r))
        joins = _narrow_rules(left, right, rule, model, threshold, enough) if largest > enough else [(left, right, rule)]
        for a, b, narrow in joins:
            carried = sorted({*needed, *narrow.columns()})
            # Bands hold up to three times the pairs within the tolerance.
            pairs = block_pairs(a, b, narrow, carried, "unique_id", pairs_per_task, 3 * largest)
            for earlier in rules[:number]:
                pairs = pairs.filter(~earlier.holds())
            pairs = pairs.select(*[f"{c}_l" for c in needed], *[f"{c}_r" for c in needed], F.lit(number).alias("match_key"))
            united = pairs if united is None else united.unionByName(pairs)
    if united is None:  # no combination of levels reaches the threshold under any rule
        nothing = block_pairs(left, right, rules[0], needed, largest=0).filter(F.lit(False))
        united = nothing.withColumn("match_key", F.lit(0))
    return united
