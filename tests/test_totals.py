"""Pairs per agreement pattern over all rules, counted without forming pairs, against pairs one by one."""

from collections import Counter
from dataclasses import replace

import people
import pytest

from linkwright.operators import blocking as B
from linkwright.operators import profiles, scoring
from linkwright.operators.model import LinkSettings
from linkwright.plans import catalog
from test_model import COMPARISONS, SETTINGS, stated

LEFT, RIGHT = people.register("l", 90, 31, hot=0.2), people.register("r", 80, 32, hot=0.2)
NAMES = [c.gamma for c in COMPARISONS]
NEAR = B.BlockRule(("norm_race", "gender"), (("birth_year", 3),))  # no level ends there


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([*LEFT, LEFT[0], (None, *LEFT[1][1:])], people.SCHEMA)
    return left.cache(), spark.createDataFrame(RIGHT, people.SCHEMA).cache()


def one_by_one(sides, settings):
    rows = scoring.candidate_gammas(*sides, settings).select(*NAMES).collect()
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize(
    "rules",
    [
        SETTINGS.rules,
        SETTINGS.rules[:1],
        (SETTINGS.rules[0], NEAR),
        (NEAR, B.BlockRule((), (("birth_year", 1),)), B.block_on("gender", "nysiis_last_name")),
    ],
)
def test_totals_are_those_of_the_pairs(sides, rules):
    settings = LinkSettings(tuple(rules), COMPARISONS)
    got = {tuple(r[n] for n in NAMES): int(r["pairs"]) for r in profiles.pattern_totals(*sides, settings).collect()}
    assert got and got == one_by_one(sides, settings)


def test_fractions_are_counted_by_pairs(spark, sides):
    left, right = (side.selectExpr(*[c for c in side.columns if c != "birth_year"], "birth_year + 0.5D as birth_year") for side in sides)
    got = {tuple(r[n] for n in NAMES): int(r["pairs"]) for r in profiles.pattern_totals(left, right, SETTINGS).collect()}
    assert got == one_by_one((left, right), SETTINGS)


def test_what_cannot_be_counted_is_left_to_pairs(sides):
    rule = replace(SETTINGS.rules[0], rest="l.birth_year < r.birth_year")
    settings = LinkSettings((rule,), COMPARISONS)
    assert profiles.pattern_totals(*sides, settings) is None
    compact = profiles.predict_patterns(*sides, settings, stated(), 0.2).collect()
    assert sum(r["pairs"] for r in compact) == scoring.predict(*sides, settings, stated(), 0.2).count()


def test_the_density_query_forms_no_pairs(spark, sf_dir, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("pairs were formed")

    for name in ("passing_pairs", "multi_pass_blocking"):
        monkeypatch.setattr(scoring, name, refuse)
    assert catalog.QUERIES["H12_density_predictions"](spark, sf_dir).count() == 200


def first_of_each(rows):
    return sorted((*(r[x] for x in r.asDict() if x in NAMES), r["unique_id_l"], r["unique_id_r"], r["example"], int(r["pattern_pairs"])) for r in rows)


@pytest.mark.parametrize("most", [0, 10**5])
def test_examples_from_the_smallest_ids(sides, monkeypatch, most):
    """However many left records are tried before all are taken."""
    left, right = (side.filter("unique_id is not null").dropDuplicates(["unique_id"]) for side in sides)
    monkeypatch.setattr(profiles, "MOST_LEADING", most)
    got = profiles.pattern_examples(left, right, SETTINGS, 3, pairs_per_task=10, records=4)
    want = profiles._pattern_examples_by_profiles(left, right, SETTINGS, 3)
    assert first_of_each(got.collect()) == first_of_each(want.collect())


def test_examples_do_not_need_all_pairs(sides, monkeypatch):
    """Patterns that the left records with the smallest ids show are not looked for among the others."""
    sizes = []
    plain = profiles.candidate_gammas

    def counted(left, *rest):
        sizes.append(left.count())
        return plain(left, *rest)

    monkeypatch.setattr(profiles, "candidate_gammas", counted)
    settings = LinkSettings((B.block_on("gender"),), COMPARISONS[1:2])  # three patterns, all frequent
    assert profiles.pattern_examples(*sides, settings, 2, records=16).count() == 6
    assert sizes and max(sizes) < len(LEFT) / 2
