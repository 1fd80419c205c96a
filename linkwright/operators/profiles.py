"""One stand-in per distinct profile.

Records of one side that agree on every column the rules and comparisons read have the same partners
and the same scores, so one of them (the smallest id) can stand for all, weighted by their number.
Thousands of identical records then cost one row, instead of thousands times thousands of pairs.

What only needs the number of pairs per agreement pattern forms no pairs of profiles either: see `pattern_totals`.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwright.functions.scalars import PAIR_COUNT, pair_count
from linkwright.operators.blocking import PAIRS_PER_TASK, BlockRule, block_on
from linkwright.operators.comparison import Comparison, input_columns, within
from linkwright.operators.model import LinkModel, LinkSettings
from linkwright.operators.patterns import countable, pattern_counts
from linkwright.operators.scoring import ID_PAIR, LEADING, MOST_LEADING, candidate_gammas, predict, score_gammas
from linkwright.session import cut_lineage

# Rules whose union is counted from the sizes of their overlaps: three rules have four of these.
MOST_RULES = 3


def profile_columns(settings: LinkSettings) -> list[str]:
    ruled = {c for rule in settings.rules for c in rule.columns()}
    return sorted({*input_columns(settings.comparisons), *ruled, *settings.columns})


def with_profile(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``profile``, a 128-bit digest of the columns."""
    return records.select("unique_id", *columns, F.md5(F.to_json(F.struct(*columns))).alias("profile"))


def stand_ins(profiled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(profile, columns..., unique_id, records): added up per map task before the shuffle."""
    return profiled.groupBy("profile", *columns).agg(
        F.min("unique_id").alias("unique_id"), F.count("*").alias("records")
    )


def _stand_in_sides(left: DataFrame, right: DataFrame, settings: LinkSettings) -> list[DataFrame]:
    columns = profile_columns(settings)
    return [cut_lineage(stand_ins(with_profile(side, columns), columns)) for side in (left, right)]


def _weighted(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("pairs", pair_count(F.col("records_l"), F.col("records_r"))).drop("records_l", "records_r")


def profile_gammas(
    left: DataFrame, right: DataFrame, settings: LinkSettings, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """Agreement levels of blocked profile pairs, with the record pairs each stands for."""
    sides = _stand_in_sides(left, right, settings)
    return _weighted(candidate_gammas(*sides, settings, pairs_per_task, ("profile", "records")))


def predict_profiles(
    left: DataFrame,
    right: DataFrame,
    settings: LinkSettings,
    model: LinkModel,
    threshold: float | None = 0.2,
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Predictions in compact form: one row per profile pair and ``pairs``, its record pairs."""
    sides = _stand_in_sides(left, right, settings)
    return _weighted(predict(*sides, settings, model, threshold, pairs_per_task, ("profile", "records")))


def _told_by(rule: BlockRule, comparison: Comparison) -> bool:
    """Whether all pairs of the rule show the comparison's closest level: its values are equal and present."""
    return countable(comparison) and comparison.levels[0].kind != "within" and comparison.column in rule.equal


def _tolerances(rule: BlockRule, comparisons: Sequence[Comparison]) -> tuple[list[Comparison], Column]:
    """Comparisons to count besides, and the test on levels that says that the tolerances are kept."""
    added, test = [], F.lit(True)
    for column, t in rule.within:
        for c in comparisons:
            amounts = [x.amount if x.kind == "within" else None for x in c.levels]
            if c.column == column and t in amounts and None not in amounts and amounts == sorted(set(amounts)):
                test = test & (F.col(c.gamma) >= len(amounts) - amounts.index(t))
                break
        else:
            added.append(Comparison(column, (within(t),), f"__within_{column}"))
            test = test & (F.col(added[-1].gamma) == 1)
    return added, test


def _rule_patterns(left: DataFrame, right: DataFrame, rule: BlockRule, comparisons: Sequence[Comparison]) -> DataFrame:
    """(gamma..., pairs) of all pairs that satisfy one rule by keys."""
    told = [c for c in comparisons if _told_by(rule, c)]
    asked = [c for c in comparisons if c not in told]
    gammas = [c.gamma for c in comparisons]
    for column in {*rule.equal, *(c for c, _ in rule.within)}:
        left, right = (side.filter(F.col(column).isNotNull()) for side in (left, right))
    added, kept = _tolerances(rule, asked)
    counted = None
    if rule.within and not rule.rest and all(countable(c) for c in asked):
        try:
            counted = pattern_counts(left, right, [*asked, *added], block_on(*rule.equal), by_keys=True).filter(kept)
        except ValueError:  # fractions, whose neighbours cannot be listed
            counted = None
    if counted is None:
        counted = pattern_counts(left, right, asked or comparisons, rule)
    counted = counted.withColumns({c.gamma: F.lit(len(c.levels)) for c in told if asked} or {"pairs": F.col("pairs")})
    return counted.groupBy(*gammas).agg(F.sum("pairs").cast(PAIR_COUNT).alias("pairs"))


def pattern_totals(left: DataFrame, right: DataFrame, settings: LinkSettings) -> DataFrame | None:
    """(gamma..., pairs): record pairs per agreement pattern over the union of the rules, or none where these cannot
    be counted without forming pairs.

    Patterns are counted rule by rule.  Pairs of several rules are taken back by the counts of what these rules have in
    common, which is a rule by keys, too.
    """
    rules = settings.rules
    plain = all(r.keyed and not r.rest and r.columns() for r in rules) and not settings.columns
    if not plain or len(rules) > MOST_RULES or not all(countable(c) for c in settings.comparisons):
        return None
    gammas, united = [c.gamma for c in settings.comparisons], None
    for size in range(1, len(rules) + 1):
        for some in itertools.combinations(rules, size):
            one = _rule_patterns(left, right, reduce(BlockRule.both, some), settings.comparisons)
            one = one.withColumn("pairs", (F.col("pairs") * F.lit(-1 if size % 2 == 0 else 1)).cast(PAIR_COUNT))
            united = one if united is None else united.unionByName(one)
    return united.groupBy(*gammas).agg(F.sum("pairs").cast(PAIR_COUNT).alias("pairs")).filter("pairs > 0")


def predict_patterns(
    left: DataFrame, right: DataFrame, settings: LinkSettings, model: LinkModel, threshold: float | None = 0.2
) -> DataFrame:
    """Predictions in their most compact form: one row per agreement pattern and ``pairs``, its record pairs; by
    profile pairs where patterns cannot be counted without these."""
    counted = pattern_totals(left, right, settings)
    if counted is None:
        return predict_profiles(left, right, settings, model, threshold)
    return score_gammas(counted, model, threshold)


def _first_pairs(pairs: DataFrame, pattern: Sequence[str], n: int) -> DataFrame:
    """The first `n` rows of each pattern in the order of ids.  Spark cuts the ranking to `n` rows per map task before
    its shuffle."""
    first = F.row_number().over(W.partitionBy(*pattern).orderBy(*ID_PAIR))
    return pairs.withColumn("__rank", first).filter(F.col("__rank") <= n).drop("__rank")


def _members(side: DataFrame, chosen: DataFrame, columns: Sequence[str], suffix: str, n: int) -> DataFrame:
    """(profile, unique_id): the `n` smallest ids of the chosen profiles."""
    profile, record = f"profile{suffix}", f"unique_id{suffix}"
    wanted = chosen.select(profile).distinct()
    named = with_profile(side, columns).select(F.col("profile").alias(profile), F.col("unique_id").alias(record))
    rank = F.row_number().over(W.partitionBy(profile).orderBy(record))
    return named.join(wanted, profile, "left_semi").withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def pattern_examples(
    left: DataFrame, right: DataFrame, settings: LinkSettings, n: int, pairs_per_task: int = PAIRS_PER_TASK, records: int = LEADING
) -> DataFrame:
    """Record pairs per agreement pattern with the `n` first examples of each, in id order.

    Pairs are counted by keys.  Examples come from the left records with the smallest ids: so many, eight times more
    each time and beyond `MOST_LEADING` all, that a pattern has its examples; those with larger ids have none before these.
    Only pairs of patterns that still lack examples are ranked, so the more pairs are formed, the rarer those ranked.  On
    the right, the first `n` record pairs lie within the first `n` profiles (ordered by their smallest ids) and use the `n`
    smallest ids of each, so no more than that is expanded.
    """
    counts = pattern_totals(left, right, settings)
    if counts is None:
        return _pattern_examples_by_profiles(left, right, settings, n)
    counts = cut_lineage(counts.withColumnRenamed("pairs", "pattern_pairs"))
    pattern, columns = [c.gamma for c in settings.comparisons], profile_columns(settings)
    missing = {tuple(r[g] for g in pattern): min(n, int(r["pattern_pairs"])) for r in counts.collect()}  # a row per pattern
    ordered = cut_lineage(with_profile(left, columns).withColumn("records", F.lit(1)))
    partners = cut_lineage(stand_ins(with_profile(right, columns), columns))
    number, carried, found = ordered.count(), ("profile", "records"), []
    kept = [*pattern, *ID_PAIR, "profile_r", "records_r"]
    while missing:
        part = ordered
        if records < min(number, MOST_LEADING):
            edge = ordered.select("unique_id").orderBy("unique_id").limit(records).agg(F.max("unique_id")).first()[0]
            part = ordered.filter(F.col("unique_id").isNull() | (F.col("unique_id") <= F.lit(edge)))
        pairs = candidate_gammas(part, partners, settings, pairs_per_task, carried).select(*kept)
        asked = F.array(*[F.array(*map(F.lit, levels)) for levels in missing])
        first = cut_lineage(_first_pairs(pairs.filter(F.array_contains(asked, F.array(*pattern))), pattern, n))
        shown = {tuple(r[g] for g in pattern): r["shown"] for r in first.groupBy(*pattern).agg(F.sum("records_r").alias("shown")).collect()}
        done = [levels for levels, least in missing.items() if part is ordered or shown.get(levels, 0) >= least]
        if done:
            ready = F.array(*[F.array(*map(F.lit, levels)) for levels in done])
            found.append(first.filter(F.array_contains(ready, F.array(*pattern))))
        missing = {levels: least for levels, least in missing.items() if levels not in done}
        records *= 8
    if not found:
        return counts.limit(0).select(*pattern, *[F.lit(None).cast("string").alias(x) for x in ID_PAIR], F.lit(0).alias("example"), "pattern_pairs")
    chosen = reduce(DataFrame.unionByName, found)
    spelled = chosen.drop("unique_id_r").join(_members(right, chosen, columns, "_r", n), "profile_r")
    first = F.row_number().over(W.partitionBy(*pattern).orderBy(*ID_PAIR))
    ranked = spelled.select(*pattern, *ID_PAIR).withColumn("example", first).filter(F.col("example") <= n)
    return ranked.join(counts, pattern)


def _pattern_examples_by_profiles(left: DataFrame, right: DataFrame, settings: LinkSettings, n: int) -> DataFrame:
    """The same where patterns cannot be counted by keys: the first `n` record pairs of a pattern lie within its first
    `n` profile pairs."""
    gammas = cut_lineage(profile_gammas(left, right, settings))
    pattern, columns = [c.gamma for c in settings.comparisons], profile_columns(settings)
    counts = gammas.groupBy(*pattern).agg(F.sum("pairs").cast(PAIR_COUNT).alias("pattern_pairs"))
    chosen = cut_lineage(_first_pairs(gammas, pattern, n).select(*pattern, "profile_l", "profile_r"))
    spelled = chosen.join(_members(left, chosen, columns, "_l", n), "profile_l").join(_members(right, chosen, columns, "_r", n), "profile_r")
    first = F.row_number().over(W.partitionBy(*pattern).orderBy(*ID_PAIR))
    ranked = spelled.select(*pattern, *ID_PAIR).withColumn("example", first).filter(F.col("example") <= n)
    return ranked.join(counts, pattern)
